"""Column functions and formula conversion."""
