"""Streaming maintenance of indexes."""
