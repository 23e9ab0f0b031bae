"""Training-run analytics on Spark."""
