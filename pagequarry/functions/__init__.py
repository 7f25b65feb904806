"""Column functions, grouped by subject; each takes and returns Columns."""
