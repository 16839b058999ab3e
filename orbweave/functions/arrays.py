"""The functions that geometries are written in, over columns or, inside :func:`numbers`, over numpy arrays.

A join that compares blocks of rows in a task evaluates the same expressions as columns do, in the same order, on arrays
of pairs. Only finite input is meant for it, as NaN is ordered in Spark. Nulls are a mask beside the values.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import functions as _columns

_ON = False


@contextlib.contextmanager
def numbers() -> Iterator[None]:
    """Within it, literals and functions give :class:`Numbers`."""
    global _ON
    before, _ON = _ON, True
    try:
        with np.errstate(all="ignore"):
            yield
    finally:
        _ON = before


def on() -> bool:
    return _ON


def _joined(a, b):
    return b if a is None else a if b is None else a | b


class Numbers:
    """Values with a mask of those that are null (None for none), as operands of Python's operators."""

    __slots__ = ("v", "null")
    __hash__ = None

    def __init__(self, v, null=None):
        self.v, self.null = v, null

    def _with(self, other, f: Callable) -> Numbers:
        other = _number(other)
        return Numbers(f(self.v, other.v), _joined(self.null, other.null))

    def __add__(self, o):
        return self._with(o, np.add)

    def __radd__(self, o):
        return _number(o)._with(self, np.add)

    def __sub__(self, o):
        return self._with(o, np.subtract)

    def __rsub__(self, o):
        return _number(o)._with(self, np.subtract)

    def __mul__(self, o):
        return self._with(o, np.multiply)

    def __rmul__(self, o):
        return _number(o)._with(self, np.multiply)

    def __truediv__(self, o):
        return self._with(o, np.divide)

    def __neg__(self):
        return Numbers(-self.v, self.null)

    def __lt__(self, o):
        return self._with(o, np.less)

    def __le__(self, o):
        return self._with(o, np.less_equal)

    def __gt__(self, o):
        return self._with(o, np.greater)

    def __ge__(self, o):
        return self._with(o, np.greater_equal)

    def __eq__(self, o):
        return self._with(o, np.equal)

    def __ne__(self, o):
        return self._with(o, np.not_equal)

    def __invert__(self):
        return Numbers(~self.v, self.null)

    def __and__(self, o):
        if self.null is None and o.null is None:
            return Numbers(self.v & o.v)
        no = [~x.v if x.null is None else ~x.v & ~x.null for x in (self, o)]
        return Numbers(self.v & o.v, _joined(self.null, o.null) & ~(no[0] | no[1]))

    def __or__(self, o):
        if self.null is None and o.null is None:
            return Numbers(self.v | o.v)
        yes = [x.v if x.null is None else x.v & ~x.null for x in (self, o)]
        return Numbers(yes[0] | yes[1], _joined(self.null, o.null) & ~(yes[0] | yes[1]))

    def isNull(self):
        return Numbers(np.zeros(np.shape(self.v), bool) if self.null is None else self.null)

    def alias(self, name: str):
        return _Named(name, self)

    def true(self) -> np.ndarray:
        """Where it is true, not false or null."""
        return self.v if self.null is None else self.v & ~self.null


class _Named:
    def __init__(self, name, value):
        self.name, self.value = name, value


class _Struct:
    def __init__(self, fields: dict):
        self.fields = fields

    def getField(self, name: str):
        return self.fields[name]

    def alias(self, name: str):
        return _Named(name, self)


def _number(x) -> Numbers:
    return x if isinstance(x, Numbers) else Numbers(np.float64(np.nan), np.True_) if x is None else Numbers(np.float64(x) if isinstance(x, float) else x)


def _choose(at: np.ndarray, a, b):
    """``a`` where ``at``, else ``b`` (None for null)."""
    if isinstance(a, _Struct) or isinstance(b, _Struct):
        return _Struct({k: _choose(at, a.fields[k], None if b is None else b.fields[k]) for k in a.fields})
    a, b = _number(a), _number(b)
    null = None if a.null is None and b.null is None else np.where(at, False if a.null is None else a.null, False if b.null is None else b.null)
    return Numbers(np.where(at, a.v, b.v), null if null is not None and null.any() else None)


class _When:
    def __init__(self, cases):
        self.cases = cases

    def when(self, condition, value):
        return _When([*self.cases, (condition, plain(value))])

    def otherwise(self, value):
        value = plain(value)
        for condition, x in reversed(self.cases):
            value = _choose(condition.true(), x, value)
        return value

    def __getattr__(self, name):
        return getattr(self.otherwise(None), name)


def plain(x):
    """A choice without ``otherwise`` as numbers; others as they are."""
    return x.otherwise(None) if isinstance(x, _When) else x


def _extreme(f: Callable, xs) -> Numbers:
    """Nulls are passed over."""
    out = plain(xs[0])
    for x in map(plain, xs[1:]):
        if out.null is None and x.null is None:
            out = Numbers(f(out.v, x.v))
        else:
            m, n = (np.False_ if y.null is None else y.null for y in (out, x))
            out = Numbers(np.where(m, x.v, np.where(n, out.v, f(out.v, x.v))), m & n)
    return out


def lit(x):
    return _number(x) if _ON else _columns.lit(x)


def when(condition, value):
    return _When([(condition, plain(value))]) if _ON else _columns.when(condition, value)


def least(*xs):
    return _extreme(np.minimum, xs) if _ON else _columns.least(*xs)


def greatest(*xs):
    return _extreme(np.maximum, xs) if _ON else _columns.greatest(*xs)


def abs(x):  # noqa: A001
    return Numbers(np.abs(x.v), x.null) if _ON else _columns.abs(x)


def sqrt(x):
    return Numbers(np.sqrt(x.v), x.null) if _ON else _columns.sqrt(x)


def signum(x):
    return Numbers(np.sign(x.v), x.null) if _ON else _columns.signum(x)


def try_divide(a, b):
    if not _ON:
        return _columns.try_divide(a, b)
    zero = b.v == 0
    null = _joined(a.null, b.null)
    return Numbers(a.v / np.where(zero, 1.0, b.v), _joined(null, zero)) if np.any(zero) else Numbers(a.v / b.v, null)


def coalesce(*xs):
    if not _ON:
        return _columns.coalesce(*xs)
    out = plain(xs[-1])
    for x in map(plain, reversed(xs[:-1])):
        out = x if x.null is None else _choose(~x.null, Numbers(x.v), out)
    return out


def also(a, b: Callable):
    """``a & b()``; arrays don't look at ``b`` where ``a`` holds nowhere."""
    return a if _ON and not np.any(a.v) and a.null is None else a & b()


def struct(*xs):
    return _Struct({x.name: plain(x.value) for x in xs}) if _ON else _columns.struct(*xs)


def __getattr__(name: str):
    return getattr(_columns, name)
