"""Retail star-schema analytics written as plain PySpark jobs."""
