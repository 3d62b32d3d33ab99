"""Column expressions and size models."""
