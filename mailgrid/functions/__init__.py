"""Column expressions: calendar arithmetic, numbers, keys, labels and formats."""
