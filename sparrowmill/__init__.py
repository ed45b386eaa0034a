"""Spark jobs over star-schema tables, event streams and text corpora."""
