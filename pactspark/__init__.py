"""Contract-governed analytics on Spark."""
