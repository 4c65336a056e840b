"""qforge.functions."""
