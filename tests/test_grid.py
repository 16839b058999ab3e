import pytest
from pyspark.sql import functions as F

from orbweave.functions.errors import GeometryError
from orbweave.functions.geometry import Point
from orbweave.operators.grid import CartesianGrid, near_parts
from orbweave.sources import files, generators


def test_cells(spark):
    grid = CartesianGrid.of((0, 0), (1, 2), 0.5)
    assert grid.cells == [3, 5] and grid.extent == ((0, 0), (1.5, 2.5))
    df = spark.createDataFrame([(0.0, 0.0, 0), (0.5, 0.0, 1), (1.0, 2.0, 14), (9.0, -9.0, 2)], "x double, y double, want long")
    index = grid.index(Point.of("x", "y"))
    assert all(r["got"] == r["want"] for r in df.select("want", index.alias("got")).collect())
    box = grid.box(F.col("want"))
    assert [list(r) for r in df.where("want = 14").select(*box.lo, *box.hi).collect()] == [[1.0, 2.0, 1.5, 2.5]]
    for bad in (((0,), (1,), 0), ((1,), (0,), 1), ((1e18,), (1e18,), 1e-3), ((0, 0, 0), (1e9, 1e9, 1e9), 1e-2)):
        with pytest.raises(GeometryError):
            CartesianGrid.of(*bad)


def test_parts(spark):
    rows = [(p, float(x)) for p, lo in ((0, 0), (1, 2), (2, 9)) for x in (lo, lo + 1)]
    got = near_parts(spark.createDataFrame(rows, "p long, x double"), "p", ["x"], 1.0)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]


def test_vtk(spark, tmp_path):
    mesh = generators.plane_mesh(spark, 1).withColumn("v", F.col("id") * 0.5)
    files.write_vtk(mesh, str(tmp_path / "m.vtk"), "v")
    lines = (tmp_path / "m.vtk").read_text().splitlines()
    assert lines[4] == "POINTS 6 double" and lines[11] == "POLYGONS 2 8" and lines[-2:] == ["0.0", "0.5"]
