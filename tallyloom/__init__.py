"""Spark-first document analytics: text to typed facts, ranking, retrieval and training-data preparation."""
