"""Column expressions and scalable ordered primitives."""
