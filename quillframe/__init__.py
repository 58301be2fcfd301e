"""Structured-call data preparation and analytics on PySpark."""
