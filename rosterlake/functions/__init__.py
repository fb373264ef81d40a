"""Column expressions and the salary, leave and statistics functions."""
