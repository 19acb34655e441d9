"""Column functions on evidence text."""
