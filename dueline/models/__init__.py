"""Spark ML training, scoring and threshold choice."""
