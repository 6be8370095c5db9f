"""Column builders: text, similarity."""
