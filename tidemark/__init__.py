"""Tidemark: a Spark-first engine for auditing sequential trading decisions."""
