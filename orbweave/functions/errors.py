"""Errors that this library raises."""


class GeometryError(ValueError):
    """A geometry, a pair of geometries or a parameter that an operation doesn't take."""


class LimitExceeded(ValueError):
    """A query has more results than the caller allowed."""
