"""Operators of a training-data pipeline: ten dealt operators, their queries and SQL."""
