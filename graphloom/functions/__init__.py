"""Column functions: hash-based randomness and group reductions."""
