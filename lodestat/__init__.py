"""lodestat: point-in-time fundamentals analytics on Spark."""
