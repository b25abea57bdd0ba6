"""Document-intelligence analytics on Spark."""
