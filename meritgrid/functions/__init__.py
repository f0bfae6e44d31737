"""Column expressions and small helpers that several operators share."""
