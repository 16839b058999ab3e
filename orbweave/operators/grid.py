"""Regular grids over a scene, and which parts of a data set can hold matches for which others."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions import geometry as G
from orbweave.functions.errors import GeometryError


@dataclass(frozen=True)
class CartesianGrid:
    """Cells of width ``h`` on every axis from ``lo`` up to at least ``hi``."""

    lo: tuple[float, ...]
    hi: tuple[float, ...]
    h: tuple[float, ...]

    @staticmethod
    def of(lo: Sequence[float], hi: Sequence[float], h: float | Sequence[float]) -> CartesianGrid:
        h = (float(h),) * len(lo) if isinstance(h, int | float) else tuple(map(float, h))
        grid = CartesianGrid(tuple(map(float, lo)), tuple(map(float, hi)), h)
        grid.check()
        return grid

    def check(self) -> None:
        """Widths are positive, wide enough for the coordinates' precision, and cells can be numbered in 63 bits."""
        if not len(self.lo) == len(self.hi) == len(self.h) or any(b < a for a, b in zip(self.lo, self.hi, strict=True)):
            raise GeometryError("a grid takes as many lower and upper bounds and widths, in order")
        for a, b, h in zip(self.lo, self.hi, self.h, strict=True):
            if h <= 0:
                raise GeometryError("cell widths must be above 0")
            if h < 5 * sys.float_info.epsilon * max(abs(a), abs(b)):
                raise GeometryError("cells are too narrow for the coordinates' precision")
        total = 1
        for n in self.cells:
            total *= n
        if total >= 1 << 63:
            raise GeometryError("the grid has more cells than a BIGINT can number")

    @property
    def cells(self) -> list[int]:
        return [int((b - a) / h) + 1 for a, b, h in zip(self.lo, self.hi, self.h, strict=True)]

    @property
    def extent(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        return self.lo, tuple(a + n * h for a, n, h in zip(self.lo, self.cells, self.h, strict=True))

    def coordinates(self, p: G.Point) -> list[Column]:
        """The cell of a point on each axis; points outside go to the nearest cell."""
        return [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - F.lit(a)) / F.lit(h)))).cast("long") for x, a, h, n in zip(p.at, self.lo, self.h, self.cells, strict=True)]

    def index(self, p: G.Point) -> Column:
        """The number of a point's cell, the first axis running fastest."""
        out, stride = F.lit(0).cast("long"), 1
        for c, n in zip(self.coordinates(p), self.cells, strict=True):
            out, stride = out + c * F.lit(stride).cast("long"), stride * n
        return out

    def box(self, index: Column) -> G.Box:
        """The box of a numbered cell."""
        lo, hi, stride = [], [], 1
        for a, h, n in zip(self.lo, self.h, self.cells, strict=True):
            c = (F.floor(index / F.lit(stride)) % F.lit(n)).cast("double")
            lo.append(F.lit(a) + c * F.lit(h))
            hi.append(F.lit(a) + (c + 1) * F.lit(h))
            stride *= n
        return G.Box(lo, hi)


def near_parts(df: DataFrame, part: str, names: Sequence[str], eps: float) -> DataFrame:
    """(part, other): parts whose boxes come within ``eps`` of each other, so only they can share matches.

    One row for each part is compared with the others'; parts are few against rows.
    """
    b = df.groupBy(part).agg(*(f.alias(n + k) for n in names for f, k in ((F.min(n), "_lo"), (F.max(n), "_hi"))))
    other = b.select(F.col(part).alias("other"), *(F.col(n + k).alias(f"{n}{k}_o") for n in names for k in ("_lo", "_hi")))
    gaps = [F.greatest(F.col(f"{n}_lo") - F.col(f"{n}_hi_o"), F.col(f"{n}_lo_o") - F.col(f"{n}_hi"), F.lit(0.0)) for n in names]
    return b.join(other, G.norm(gaps) <= F.lit(float(eps))).select(F.col(part).alias("part"), "other")
