"""Vector-augmented SQL analytics on Spark."""
