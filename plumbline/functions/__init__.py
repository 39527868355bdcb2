"""Column expressions and header helpers."""
