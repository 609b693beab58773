"""Column functions over packed arrays and complex numbers."""
