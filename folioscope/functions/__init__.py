"""Column expressions for text, numbers, units, ranges and dates."""
