"""Retail behaviour analytics as plain Spark DataFrame transformations."""
