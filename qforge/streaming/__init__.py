"""qforge.streaming."""
