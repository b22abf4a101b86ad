"""Scene retrieval analytics on Spark."""
