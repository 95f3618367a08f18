"""Search operators and indexes over vector columns."""
