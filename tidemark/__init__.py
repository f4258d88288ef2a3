"""Governed knowledge analytics as Spark DataFrame transformations."""
