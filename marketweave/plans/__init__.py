"""Registered queries: one module per operator family, with DuckDB oracles."""
