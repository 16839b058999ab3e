"""Operators of a training-data pipeline; nothing outside this package imports it."""
