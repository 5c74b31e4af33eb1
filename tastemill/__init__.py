"""Recommendation analytics as plain Spark DataFrame operators."""
