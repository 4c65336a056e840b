"""qforge.sources."""
