"""Column functions: pure expressions, no job of their own."""
