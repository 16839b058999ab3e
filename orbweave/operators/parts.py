"""Balanced parts of space: which part a value lies in, and each part's tight box and number of values.

The borders are quantiles of a bounded sample of centres: strips along the first axis, each cut along the second, and
so on, so parts hold about equally many values however these are spread. Whatever the borders, every value is in one
part, and the boxes are those of the values themselves, so searches over parts are exact. The table of parts is
bounded (MOST rows) and enters plans as a literal; no join of all queries with all parts is made.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions import geometry as G

#: Parts at most, in searches that rank all of them and in those that descend; centres that are sampled for borders.
MOST, MOST_LEAVES, SAMPLED = 512, 4_096, 1 << 16


def cuts(sample: np.ndarray, strips: int) -> list[list[list[float]]]:
    """For each axis the inner borders of every strip cut so far, so that the sample falls into equal shares."""
    groups, levels = [sample], []
    for axis in range(sample.shape[1]):
        borders, inner = [], []
        for g in groups:
            x = np.sort(g[:, axis])
            borders.append([float(x[len(x) * j // strips]) if len(x) else 0.0 for j in range(1, strips)])
            strip = np.searchsorted(borders[-1], g[:, axis], "right")
            inner += [g[strip == j] for j in range(strips)]
        levels.append(borders)
        groups = inner
    return levels


def _up_to(x: Column) -> Callable[[Column], Column]:
    return lambda border: border <= x


class Parts:
    """``df`` cut into parts by ``centre`` (columns), with the boxes of the rows' ``box``; rows without a finite one go."""

    def __init__(self, df: DataFrame, centre: Sequence[Column], box: G.Box, id: Column, most: int = MOST, sampled: int = SAMPLED):
        finite = G._all([(x > -G.INF) & (x < G.INF) for x in (*box.lo, *box.hi)])
        self.df = df.where(finite)
        self.dim, axes = box.dim, len(centre)
        rows = self.df.select(*(c.alias(f"c{i}") for i, c in enumerate(centre)), F.xxhash64(id).alias("h")).orderBy("h", *(f"c{i}" for i in range(axes))).limit(sampled).collect()
        self.strips = max(1, int((most + 0.5) ** (1 / axes)))
        self.cuts = cuts(np.array([r[:axes] for r in rows], float).reshape(-1, axes), self.strips)
        self.assigned = self.df.withColumn("__part", self.of(centre))
        ends = [f(c).alias(f"{n}{i}") for n, f, cs in (("lo", F.min, box.lo), ("hi", F.max, box.hi)) for i, c in enumerate(cs)]
        found = self.assigned.groupBy("__part").agg(F.count("*").alias("n"), *ends).collect()  # at most ``most`` rows
        self.rows = sorted((r["__part"], r["n"], [r[f"lo{i}"] for i in range(self.dim)], [r[f"hi{i}"] for i in range(self.dim)]) for r in found)

    def of(self, at: Sequence[Column]) -> Column:
        """The part in which a place lies."""
        part = F.lit(0)
        for x, borders in zip(at, self.cuts, strict=True):
            inner = F.element_at(F.from_json(F.lit(json.dumps(borders)), "array<array<double>>"), part + 1)
            part = part * self.strips + F.size(F.filter(inner, _up_to(x)))
        return part

    def touching(self, lo: Sequence[Column], hi: Sequence[Column]) -> Column:
        """The parts, as an array, whose share of space has places between ``lo`` and ``hi``."""

        def further(parts: Column, x: Column, y: Column, borders: list[list[float]]) -> Column:
            """Of each strip so far the strips along the next axis."""
            table = F.from_json(F.lit(json.dumps(borders)), "array<array<double>>")
            strip = lambda p, z: p * self.strips + F.size(F.filter(F.element_at(table, p + 1), lambda b: b <= z))
            return F.flatten(F.transform(parts, lambda p: F.sequence(strip(p, x), strip(p, y))))

        out = F.array(F.lit(0))
        for x, y, borders in zip(lo, hi, self.cuts, strict=True):
            out = further(out, x, y, borders)
        return out

    def table(self) -> Column:
        """An array of (part, n, lo, hi)."""
        rows = [{"part": p, "n": n, "lo": lo, "hi": hi} for p, n, lo, hi in self.rows]
        return F.from_json(F.lit(json.dumps(rows)), "array<struct<part:int,n:bigint,lo:array<double>,hi:array<double>>>")

    def box(self, p: Column) -> G.Box:
        return G.Box([p["lo"][i] for i in range(self.dim)], [p["hi"][i] for i in range(self.dim)])

    def _tree(self) -> Column:
        """Nested arrays of (n, lo, hi, kids): strips along the first axis, their strips along the second, ...; leaves have a part."""

        def nodes(depth: int, base: int) -> list[dict]:
            out = []
            for strip in range(self.strips):
                at = base * self.strips + strip
                if depth == len(self.cuts) - 1:
                    if at in leaves:
                        out.append(dict(zip(("part", "n", "lo", "hi"), leaves[at], strict=True)))
                elif kids := nodes(depth + 1, at):
                    ends = {k: [f(x) for x in zip(*(c[k] for c in kids), strict=True)] for k, f in (("lo", min), ("hi", max))}
                    out.append({"n": sum(c["n"] for c in kids), **ends, "kids": kids})
            return out

        leaves = {r[0]: r for r in self.rows}
        kind = "array<struct<part:int,n:bigint,lo:array<double>,hi:array<double>>>"
        for _ in self.cuts[1:]:
            kind = f"array<struct<n:bigint,lo:array<double>,hi:array<double>,kids:{kind}>>"
        return F.from_json(F.lit(json.dumps(nodes(0, 0))), kind)

    def within(self, away: Callable[[G.Box], Column], reach: Column) -> Column:
        """The parts, as an array, whose box is ``away`` by ``reach`` at most; of other strips no part is tried."""
        near = lambda nodes: F.filter(nodes, lambda p: away(self.box(p)) <= reach)
        out = near(self._tree())
        for _ in self.cuts[1:]:
            out = near(F.flatten(F.transform(out, lambda p: p["kids"])))
        return F.transform(out, lambda p: p["part"])

    def good(self, away: Callable[[G.Box], Column], k: Column) -> Column:
        """A near part with at least ``k`` values: the nearest strip that has so many, its nearest strip, ...; null if there is none."""

        def first(nodes: Column) -> Column:
            # ``nodes`` stands here once: what a lambda repeats is computed again for each element.
            return F.array_min(F.transform(nodes, lambda p: F.when(p["n"] >= k, F.struct(away(self.box(p)).alias("d"), p.alias("p")))))["p"]

        out = first(self._tree())
        for _ in self.cuts[1:]:
            out = first(out["kids"])
        return out["part"]

    def nearest(self, away: Callable[[G.Box], Column], m: int) -> Column:
        """The ``m`` parts whose box is ``away`` least."""
        order = F.array_sort(F.transform(self.table(), lambda p: F.struct(away(self.box(p)).alias("d"), p["part"].alias("part"))))
        return F.transform(F.slice(order, 1, m), lambda p: p["part"])

    def all(self) -> Column:
        return F.array(*(F.lit(r[0]) for r in self.rows)).cast("array<int>")

    def meet(self, queries: DataFrame, parts: Column) -> DataFrame:
        """Each query with every value of its parts; an equi-join that adaptive execution can split."""
        return queries.withColumn("__part", F.explode(parts)).join(self.assigned, "__part").drop("__part")


def box_gap(a: G.Box, b: G.Box) -> Column:
    """The distance between two boxes."""
    return G.norm([F.greatest(F.lit(0.0), lo - y, x - hi) for lo, hi, x, y in zip(b.lo, b.hi, a.lo, a.hi, strict=True)])
