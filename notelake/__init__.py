"""Batch and incremental Spark jobs for knowledge-base data."""
