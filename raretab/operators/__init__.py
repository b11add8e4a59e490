"""raretab.operators."""
