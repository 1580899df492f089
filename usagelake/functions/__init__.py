"""Column builders and reference dimensions."""
