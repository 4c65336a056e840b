"""Registered query plans (``queries()``) and their DuckDB oracles."""
