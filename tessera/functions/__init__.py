"""Column builders over arrays and scalars."""
