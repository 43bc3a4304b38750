"""Prose quality analytics and training-data operators for PySpark."""
