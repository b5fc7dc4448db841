"""Column functions and vectorised text functions."""
