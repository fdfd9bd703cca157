"""Structural-pocket analytics as PySpark DataFrame operations."""
