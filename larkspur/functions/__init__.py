"""Column expressions and the expression language."""
