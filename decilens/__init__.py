"""Retrieval-bias analytics on Spark."""
