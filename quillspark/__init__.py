"""Spark-first retrieval, evaluation and text analytics."""
