"""Column functions: geometry and elements."""
