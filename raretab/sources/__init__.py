"""raretab.sources."""
