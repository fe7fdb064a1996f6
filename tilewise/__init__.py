"""Spark-first analytics over model-inference experiments."""
