"""Distance functions."""
