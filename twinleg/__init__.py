"""Cross-listing premium analytics on Spark."""
