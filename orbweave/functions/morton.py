"""Morton codes as BIGINT expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbweave.functions.errors import GeometryError
from orbweave.functions.geometry import Box, Point, translate_and_scale


def spread(x: Column, gap: int, bits: int) -> Column:
    """The low ``bits`` bits of ``x`` with ``gap`` zero bits between neighbours.

    By halves: in each round, blocks of bits move apart so that the upper half of every block reaches its place.
    """
    x = x.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    if gap == 0 or bits <= 1:
        return x
    half = 1 << (bits - 1).bit_length() - 1
    while half:
        mask = sum(1 << (i + i // half * half * gap) for i in range(bits))
        mask -= (1 << 64) * (mask >> 63)
        x = x.bitwiseOR(F.shiftleft(x, half * gap)).bitwiseAND(F.lit(mask).cast("long"))
        half //= 2
    return x


def morton(p: Point, scene: Box, bits: int) -> Column:
    """Codes of 32 (as a non-negative BIGINT) or 64 bits: 32 / D or 63 / D bits on each axis, positions outside clamped.

    With one axis the 64-bit code holds 52 bits, as many as a double has.
    """
    if bits not in (32, 64) or not 1 <= p.dim <= 10:
        raise GeometryError("Morton codes have 32 or 64 bits and 1 to 10 axes")
    n = min((bits if bits == 32 else 63) // p.dim, 52)
    top = F.lit(float((1 << n) - 1))
    out = F.lit(0).cast("long")
    for i, x in enumerate(translate_and_scale(p, scene).at):
        cell = F.greatest(F.lit(0.0), F.least(x * F.lit(float(1 << n)), top)).cast("long")
        out = out.bitwiseOR(F.shiftleft(spread(cell, p.dim - 1, n), p.dim - 1 - i))
    return out


def morton32(p: Point, scene: Box) -> Column:
    return morton(p, scene, 32)


def morton64(p: Point, scene: Box) -> Column:
    return morton(p, scene, 64)
