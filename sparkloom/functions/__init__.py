"""Column expressions and numeric helpers."""
