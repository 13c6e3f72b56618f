"""Column expressions of the governance operators."""
