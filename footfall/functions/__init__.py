"""Column expressions and small vectorised helpers."""
