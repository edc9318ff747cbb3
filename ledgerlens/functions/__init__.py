"""Column expressions and order-based primitives shared by the operators."""
