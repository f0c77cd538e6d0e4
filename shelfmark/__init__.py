"""Storage analytics on Spark."""
