"""Column functions, and what is registered for SQL."""
