"""Connected components of an edge table, labelled by the smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.plans.shared import drop_table, materialize, splittable_join

#: Edges that one task may hold; beyond it, star rounds over the whole cluster shrink the table first.
LOCAL_EDGES = 500_000


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order and the smallest node of the component of each."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    s, t = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[s], label[t])
        was = label.copy()
        # Hook the roots of both ends, then jump until every node points at a root.
        np.minimum.at(label, label[s], low)
        np.minimum.at(label, label[t], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(was, label):
            return nodes, nodes[label]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a, b) with a > b: each node's neighbours go to its smallest one."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = splittable_join(near, least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a and b, bigint): label is the smallest node reachable.

    A table of up to ``local_edges`` edges is solved in one task of bounded size. A larger one is contracted by
    alternating large-star and small-star rounds, each written to the shared folder, until only stars are left or it
    has become small. Self-loops keep their node; nulls are dropped.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = materialize(edges.distinct(), "edges")
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    left = edges.where("a <> b")
    while (n := left.count()) > local_edges:
        before, left = left, materialize(_star(_star(left, True), False), "stars")
        drop_table(before)
        # Done when only stars are left: no node that others point to points on itself.
        if splittable_join(left.withColumnRenamed("a", "node"), left.select(F.col("b").alias("node")).distinct(), "node", "left_semi").isEmpty() and left.groupBy("a").count().where("count > 1").isEmpty():
            break
    if n > local_edges:
        stars = left.select(F.col("a").alias("node"), F.col("b").alias("label"))
        out = stars.union(stars.select(F.col("label").alias("node"), "label").distinct())
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if held:
                node, label = local_labels(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(label, pa.int64())], ["node", "label"])

        out = left.select("a", "b").repartition(1).mapInArrow(run, "node long, label long")
    found = materialize(out.union(loops.join(out, "node", "left_anti")), "components")
    for table in (edges, left):
        drop_table(table)
    return found
