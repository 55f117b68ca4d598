"""codeatlas: code-intelligence analytics on Spark."""
