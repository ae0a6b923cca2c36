"""Column expressions for strings and numbers."""
