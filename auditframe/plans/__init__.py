"""Registered queries: one per operator, with an independent DuckDB oracle where SQL can express the operator."""
