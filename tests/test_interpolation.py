import math

import numpy as np
import pytest

from orbweave.functions.errors import GeometryError
from orbweave.operators import interpolation as I


def frame(spark, rows, names):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))


def approximate(spark, sources, targets, names, function, degree, k, f):
    s = frame(spark, [(*p, f(*p)) for p in sources], [*names, "f"])
    c = I.mls_coefficients(s, frame(spark, targets, names), names, function, degree, k)
    return [r["f"] for r in I.interpolate(c, s, ["f"]).orderBy("target_id").collect()]


def test_polynomials_are_exact(spark):
    assert approximate(spark, [(0,), (2,), (4,), (6,)], [(1,), (3,), (5,)], ["x"], "wendland0", 1, 2, lambda x: 3) == pytest.approx([3] * 3)
    grid = [(x, y) for x in (-2, 0, 2) for y in (-2, 0, 2)]
    corners = [(x, y) for x in (-1, 1) for y in (-1, 1)]
    assert approximate(spark, grid, corners, ["x", "y"], "wendland2", 2, None, lambda x, y: x * y + 4 * x) == pytest.approx([x * y + 4 * x for x, y in corners], abs=1e-12)


def test_collinear_sources(spark):
    sources = [(x, 0) for x in (-2, 0, 2)] * 3
    assert approximate(spark, sources, [(-1, 0), (1, 0)], ["x", "y"], "wendland2", 2, 9, lambda x, y: 4 * x + 3) == pytest.approx([-1, 7], abs=1e-12)


@pytest.mark.parametrize("level, most", [(9, 2e-7), (11, 1e-8), (13, 2e-10)])
def test_convergence(spark, level, most):
    h = 2 / 2**level
    f = lambda x, y: math.sin(4 * x) + math.sin(2 * y)
    t = np.array([0.3, 0.4])
    near = np.array([(i, j) for i in range(-2, 3) for j in range(-2, 3)]) * h + t + h / 3
    c = I.coefficients(t, near, "wendland0", 3)
    assert abs(c @ np.array([f(*p) for p in near]) - f(*t)) < most * 10


def test_basis_and_functions():
    assert I.monomials(3, 2) == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 0, 0), (1, 1, 0), (0, 2, 0), (1, 0, 1), (0, 1, 1), (0, 0, 2)]
    x = np.arange(15) / 15
    assert I.radial("wendland0", -x) == pytest.approx((1 - x) ** 2)
    assert I.radial("wu4", x) == pytest.approx((1 - x) ** 6 * (6 + 36 * x + 82 * x**2 + 72 * x**3 + 30 * x**4 + 5 * x**5))
    for name in (*I.RADIAL, "buhmann2", "buhmann3", "buhmann4"):
        assert I.radial(name, np.array([1.0, 1.5, -3])) == pytest.approx([0] * 3, abs=1e-9) and (I.radial(name, x) >= 0).all()
    with pytest.raises(GeometryError):
        I.radial("other", x)


def test_batches_equal_single_targets():
    r = np.random.default_rng(2)
    target, sources = r.normal(size=(40, 2)), r.normal(size=(40, 9, 2))
    sources[::5, :, 1] = 0  # on a line, so some terms can't be told apart
    sources[1::7, 1:] = sources[1::7, :1]
    target[::5, 1] = 0
    for degree in (0, 1, 2):
        got = I.batch_coefficients(target, sources, "wendland4", degree)
        for i in range(40):
            assert got[i] == pytest.approx(I.coefficients(target[i], sources[i], "wendland4", degree), abs=1e-6)
