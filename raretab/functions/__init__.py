"""raretab.functions."""
