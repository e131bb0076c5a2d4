"""Column expressions: keys, numbers, labels, hashed noise."""
