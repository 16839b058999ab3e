"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output; its mean repetition rate is that share of the target size divided by
its rows. A document's count is the inverse of the Poisson distribution at a number from 0 to 1 seeded by the hash of
its doc_id, and the document is repeated so often. A mean rate above STEP is the sum of equal parts of at most STEP,
each with a hash of its own, so the table of the distribution stays short. The copies are shuffled by a hash of
(doc_id, copy), and sorted by it within each partition.

Only DataFrame functions run. The counts of rows are combined before the shuffle; only the configured sources and one
row for the rest come to the driver. Thresholds enter the plan as literals, so nothing is joined and a hot source
never meets in one task.

Sources that the weights don't name, and null sources, share REST's weight. Rows that
repeat a doc_id get equal counts. Rows without one draw each for itself if there are several: they are written and
seeded by their places in that table. Either go their own ways in the shuffle. Null and empty texts are repeated like others. Extra columns
are kept, ``copy`` is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.plans.shared import materialize

REST = "*"
#: Production weights: the twenty named sources alike; all others together as one.
WEIGHTS = {f"src{i}": 1.0 for i in range(20)} | {REST: 1.0}
STEP = 8.0
#: Most repeated ids (8 bytes each) that are broadcast; more are joined by a shuffle that can be split.
BROADCAST_IDS = 1_000_000


def group_of(weights: dict[str, float]) -> Column:
    return F.when(F.col("source").isin([k for k in weights if k != REST]), F.col("source")).otherwise(F.lit(REST))


def rates(docs: DataFrame, weights: dict[str, float], target_rows: float | None = None) -> dict[str, float]:
    """Mean repetitions by group; ``target_rows`` is as many as ``docs`` has if not given."""
    counts = {r["g"]: r["n"] for r in docs.groupBy(group_of(weights).alias("g")).agg(F.count("*").alias("n")).collect()}  # at most len(weights) + 1
    total, whole = sum(weights.get(g, 0.0) for g in counts), sum(counts.values()) if target_rows is None else target_rows
    return {g: whole * (weights.get(g, 0.0) / total) / n if total else 0.0 for g, n in sorted(counts.items())}


def thresholds(rate: float) -> list[float]:
    """Cumulative Poisson probabilities of 0, 1, 2, ... up to where they are 1 within 32 bits."""
    out, p, k, total = [], math.exp(-rate), 0, 0.0
    while True:
        total += p
        out.append(total)
        k += 1
        p *= rate / k
        if 1 - total < 1e-10 and k > rate:
            return out


def seeded(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__seed``, the doc_id, and ``__place``, both with the row's own place where several rows have no id; the latter where several share one too."""
    seed = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    repeated = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    n = repeated.count()
    if not n:
        return docs.withColumns({"__seed": seed, "__place": seed})
    ids = repeated.where("doc_id IS NOT NULL")
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    lone, none = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    alone, again = lone.join(ids, "doc_id", "left_anti"), lone.join(ids, "doc_id", "left_semi")
    if repeated.where("doc_id IS NULL").isEmpty():
        alone = alone.unionByName(none)
    else:
        again = again.unionByName(none)
    own = F.concat(seed, F.lit("/"), F.monotonically_increasing_id().cast("string"))
    again = materialize(again.select(docs.columns), "repeated-rows").withColumn("__place", own)
    again = again.withColumn("__seed", F.when(F.col("doc_id").isNull(), F.col("__place")).otherwise(seed))
    return alone.withColumns({"__seed": seed, "__place": seed}).unionByName(again)


def uniform(part: Column) -> Column:
    """A number in [0, 1) of 32 bits from the hash of the row's seed and ``part``."""
    seed = F.concat(F.col("__seed"), F.lit(":"), part.cast("string"))
    return F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def repetitions(means: dict[str, float], weights: dict[str, float]) -> Column:
    group = group_of(weights)
    out = F.lit(0)
    for g, rate in means.items():
        parts = max(1, math.ceil(rate / STEP))
        table = F.array(*map(F.lit, thresholds(rate / parts)))
        # Cumulative probabilities at or below the number are counts that it has passed.
        one = lambda u, table=table: F.size(F.filter(table, lambda c: c <= u))
        n = one(uniform(F.lit(0))) if parts == 1 else F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0), lambda a, i, one=one: a + one(uniform(i)))
        out = F.when(group == g, n).otherwise(out)
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: float | None = None) -> DataFrame:
    """``docs`` with each row repeated, ``copy`` from 1 up, in a global shuffle."""
    weights = weights or WEIGHTS
    docs = docs.drop("copy")
    repeated = seeded(docs).withColumn("__n", repetitions(rates(docs, weights, target_rows), weights)).where(F.col("__n") > 0)
    copies = repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    place = F.xxhash64(F.lit("shuffle"), "__place", "copy")
    return copies.repartition(place).sortWithinPartitions(place).drop("__seed", "__place")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH w(source, weight) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())}),
d AS (SELECT o.*, coalesce(w.source, '{REST}') g FROM documents o LEFT JOIN w ON o.source = w.source AND w.source <> '{REST}'),
n AS (SELECT g, count(*) n, (SELECT count(*) FROM documents) whole FROM d GROUP BY g),
t AS (SELECT n.*, weight / sum(weight) OVER () share FROM n JOIN w ON w.source = n.g),
r AS (SELECT g, whole * share / n rate, greatest(1, ceil(whole * share / n / {STEP}))::INT parts FROM t),
k AS (SELECT g, parts, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) c FROM r, range(60) s(k)),
i AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.g, ('0x' || substr(md5(d.doc_id::VARCHAR || ':' || p), 1, 8))::BIGINT / 4294967296.0::DOUBLE u
      FROM d JOIN r USING (g), range(1000) q(p) WHERE p < r.parts),
c AS (SELECT doc_id, text, lang, source, n_chars, count(k.k) copies FROM i LEFT JOIN k ON i.g = k.g AND k.c <= i.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT "copy" FROM c
"""
