"""Column expressions that work inside one row."""
