"""Column helpers: text, numbers, vectors."""
