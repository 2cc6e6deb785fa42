"""Column expressions: every function takes Columns and returns Columns."""
