"""Spatial predicates over streams of queries, against a static table of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.errors import GeometryError


def within_stream(queries: DataFrame, values: DataFrame, names: Sequence[str], radius: float, id: str = "id") -> DataFrame:
    """(query_id, value_id, distance) for each streamed point and each value within ``radius``; stateless, in append mode.

    Values are entered in their own grid cell and looked up from the cells around each query, so every pair meets in
    one cell.
    """
    if radius <= 0:
        raise GeometryError("the radius must be above 0")
    h = F.lit(radius * (1 + 1e-9))
    keys = [f"__c{i}" for i in range(len(names))]
    v = values.select(F.col(id).alias("value_id"), *(F.col(n).alias(f"__v{n}") for n in names), *(F.floor(F.col(n) / h).alias(k) for n, k in zip(names, keys, strict=True)))
    q = queries.select(F.col(id).alias("query_id"), *(F.col(n).alias(f"__q{n}") for n in names))
    for n, k in zip(names, keys, strict=True):
        cell = F.floor(F.col(f"__q{n}") / h)
        q = q.withColumn(k, F.explode(F.array(cell - 1, cell, cell + 1)))
    square = [(F.col(f"__v{n}") - F.col(f"__q{n}")) * (F.col(f"__v{n}") - F.col(f"__q{n}")) for n in names]
    distance = F.sqrt(sum(square[1:], square[0]))
    return q.join(v, keys).withColumn("distance", distance).where(F.col("distance") <= radius).select("query_id", "value_id", "distance")


def windowed_counts(queries: DataFrame, time: str, cell: float, names: Sequence[str], length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, end, cell_0, ..., n): events in each time window and grid cell; events later than ``late`` are left out."""
    cells = [F.floor(F.col(n) / F.lit(cell)).alias(f"cell_{i}") for i, n in enumerate(names)]
    counted = queries.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *cells).agg(F.count("*").alias("n"))
    return counted.select("w.start", "w.end", *(f"cell_{i}" for i in range(len(names))), "n")
