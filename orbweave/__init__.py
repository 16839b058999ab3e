"""Spark-first geometric search, clustering and interpolation."""

__version__ = "0.1.0"
