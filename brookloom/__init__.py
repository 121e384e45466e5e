"""Incremental analytics on Spark."""
