"""Column expressions shared by operators and queries."""
