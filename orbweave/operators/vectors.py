"""Nearest neighbours in many dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block, and blocks of values that each block of queries meets.
QUERY_BLOCK = 2048


def _best(square: np.ndarray, p: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k best values for each query, by (distance, id); infinite beyond the values there are.

    The matrix product cancels for near vectors, so every value that may be among the best within the rounding of
    ``square`` and of ``digits`` is measured again, however many tie.
    """
    k = min(k, len(x))
    error = 4 * np.finfo(float).eps * (x.shape[1] + 4) * ((p**2).sum(1) + (x**2).sum(1).max())
    far = np.sqrt(np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1], 0) + error) + (10.0**-digits if digits is not None else 0)
    keep = square <= (far**2 + error)[:, None] * (1 + 1e-12)
    near, dist = np.zeros((len(p), k), np.int64), np.full((len(p), k), np.inf)
    ends = np.cumsum(keep.sum(1))
    step = max(1, (1 << 22) // max(1, x.shape[1]))  # pairs that are measured at once, or one query's
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        row, col = np.nonzero(keep[at:to])
        exact = np.sqrt(((p[at + row] - x[col]) ** 2).sum(1))
        exact = np.round(exact, digits) if digits is not None else exact
        order = np.lexsort((ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        some = place < k
        near[at + row[some], place[some]], dist[at + row[some], place[some]] = ids[col[some]], exact[some]
        at = to
    return near, dist


def nearest_vectors(queries: DataFrame, values: DataFrame, k: int, digits: int | None = None, id: str = "id", vector: str = "embedding", value_blocks: int | None = None) -> DataFrame:
    """(query_id, value_id, distance, place): the k nearest values of each query, exactly, by Euclidean distance.

    Values are dealt into blocks, and the stated queries meet every block; within a block distances are one matrix
    product, and only the k best of a query leave it. ``digits`` rounds distances before they are ranked.
    """
    spark = queries.sparkSession
    blocks = value_blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = values.select(F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("side"), F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("side"), F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked, best = None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if best is None:
                return
            ids = np.concatenate([a[0] for a in asked])
            near, dist = best
            rows, cols = np.nonzero(np.isfinite(dist))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(near[rows, cols]), pa.array(dist[rows, cols])], ["query_id", "value_id", "distance"])

        for batch in batches:
            blocks_, sides, ids = (batch.column(c).to_numpy() for c in ("block", "side", "id"))
            x = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(float) if len(ids) else np.zeros((0, 1))
            cuts = np.flatnonzero(np.diff(blocks_ * 2 + sides)) + 1
            for part in np.split(np.arange(len(ids)), cuts):
                if not len(part):
                    continue
                if blocks_[part[0]] != block:
                    yield from flush()
                    block, asked, best = blocks_[part[0]], [], None
                if sides[part[0]] == 0:
                    asked.append((ids[part], x[part]))
                elif asked:
                    points = np.concatenate([a[1] for a in asked])
                    near, dist = [], []
                    for at in range(0, len(points), QUERY_BLOCK):
                        p = points[at : at + QUERY_BLOCK]
                        square = (p**2).sum(1)[:, None] - 2 * p @ x[part].T + (x[part] ** 2).sum(1)
                        found = _best(square, p, x[part], ids[part], k, digits)
                        near.append(found[0])
                        dist.append(found[1])
                    near, dist = np.concatenate(near), np.concatenate(dist)
                    if best is not None:
                        near, dist = np.concatenate([best[0], near], 1), np.concatenate([best[1], dist], 1)
                    order = np.lexsort((near, dist), axis=1)[:, :k]
                    best = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
        yield from flush()

    dealt = q.unionByName(v).repartition("block").sortWithinPartitions("block", "side")
    found = dealt.mapInArrow(run, "query_id long, value_id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "value_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
