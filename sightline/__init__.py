"""Hybrid retrieval and search analytics as Spark plans."""
