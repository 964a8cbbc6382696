"""Operators that a large training-data pipeline needs, as Spark jobs."""
