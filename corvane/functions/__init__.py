"""Column expressions for text, vectors and ranks."""
