"""Bulk legal-text analytics as PySpark DataFrame operators."""
