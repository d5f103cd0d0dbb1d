"""The same statistics on streams."""
