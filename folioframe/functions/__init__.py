"""Column-level functions: text, scoring and vectors."""
