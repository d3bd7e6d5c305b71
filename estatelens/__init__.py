"""Spark-first analytics for property sales: features, proximity joins, price models."""
