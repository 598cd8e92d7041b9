"""Column expressions: numbers, vectors, dates, names and keys."""
