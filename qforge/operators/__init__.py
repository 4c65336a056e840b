"""qforge.operators."""
