"""Column expressions: scalar functions and rules."""
