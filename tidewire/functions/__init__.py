"""Column functions: everything here is a pure Catalyst expression."""
