"""Passage retrieval analytics on Spark."""
