"""Column functions: text cleaners, names and paths."""
