"""Retrieval over personal media collections, expressed as Spark DataFrames."""
