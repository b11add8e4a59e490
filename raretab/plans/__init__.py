"""raretab.plans."""
