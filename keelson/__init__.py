"""Keyed lakehouse tables and analytics on PySpark."""
