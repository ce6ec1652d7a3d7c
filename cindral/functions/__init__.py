"""Column functions: each takes and gives Columns and stays inside whole-stage code generation."""
