"""Spark-first document extraction and training-data engine."""
