"""Pore and free-volume analytics as Spark DataFrame operations."""
