"""tidemark: vessel-track analytics on Spark."""
