import numpy as np
import pytest

from orbweave.functions.errors import GeometryError
from orbweave.sources import files, generators
from orbweave.streaming.queries import windowed_counts, within_stream


def test_points(spark, tmp_path):
    x = np.random.default_rng(1).random((8, 3)).astype("<f4")
    (tmp_path / "p.bin").write_bytes(np.array([8, 3], "<i4").tobytes() + x.tobytes())
    (tmp_path / "p.txt").write_text("8 3\n" + "\n".join(" ".join(map(str, r)) for r in x.tolist()))
    rows = lambda df: np.array([r[1:] for r in df.orderBy("id").collect()])
    assert np.allclose(rows(files.read_points(spark, str(tmp_path / "p.bin"), binary=True)), x)
    assert np.allclose(rows(files.read_points(spark, str(tmp_path / "p.txt"))), x)
    assert np.allclose(rows(files.read_points(spark, str(tmp_path / "p.bin"), binary=True, max_points=5)), x[:5])
    parts = [files.read_points(spark, str(tmp_path / "p.bin"), binary=True, rank=i, ranks=3) for i in range(3)]
    assert sorted(r["id"] for p in parts for r in p.collect()) == list(range(8))
    with pytest.raises(GeometryError):
        files.read_points(spark, str(tmp_path / "p.txt"), ranks=2)


def test_other_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("4 2\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n1 2 3\n1 2 4\n")
    t = files.read_triangles(spark, str(tmp_path / "t.txt")).orderBy("id").collect()
    assert list(t[1])[1:] == [0, 0, 0, 1, 0, 0, 0, 0, 1]
    (tmp_path / "p.csv").write_text("1,2,3\n4,5,6\n")
    assert [tuple(r) for r in files.read_points_csv(spark, str(tmp_path / "p.csv")).collect()] == [(0, 1, 2, 3), (1, 4, 5, 6)]
    (tmp_path / "e.csv").write_text("0,1,0.5\n")
    assert tuple(files.read_edges_csv(spark, str(tmp_path / "e.csv")).first()) == (0, 1, 0.5)
    labels = spark.createDataFrame([(i, i % 3 - 1) for i in range(10)], "id long, label long")
    files.write_labels(labels, str(tmp_path / "labels.bin"))
    assert np.frombuffer((tmp_path / "labels.bin").read_bytes(), "<i4").tolist() == [10] + [i % 3 - 1 for i in range(10)]
    assert sorted(map(tuple, files.read_labels(spark, str(tmp_path / "labels.bin")).collect())) == [(i, i % 3 - 1) for i in range(10)]
    with pytest.raises(GeometryError):
        files.write_labels(spark.createDataFrame([(0, 1 << 31)], "id long, label long"), str(tmp_path / "large.bin"))
    assert not (tmp_path / "large.bin").exists()


def test_generators(spark):
    for kind in generators.CLOUDS:
        x = np.array([r[1:] for r in generators.point_cloud(spark, kind, 500, 3, 2.0).collect()])
        assert len(x) == 500 and (np.abs(x) <= 2 + 1e-9).all()
        if kind == "hollow_box":
            assert np.allclose(np.abs(x).max(1), 2)
        if kind.endswith("sphere"):
            r = np.linalg.norm(x, axis=1)
            assert (r <= 2 + 1e-9).all() and (kind == "filled_sphere" or np.allclose(r, 2))
    lat = generators.lattice(spark, 4, 2, 2, 3, (2, 1)).collect()
    assert len(lat) == 32 and sorted({r["x"] for r in lat}) == [0, 1, 4, 5, 8, 9, 12, 13]
    s = generators.seed_spreader(spark, 5000, 2, True)
    assert s.count() == 5000 and s.select("id").distinct().count() == 5000
    assert [r[0] for r in generators.iota(spark, 3, 5).collect()] == [5, 6, 7]
    assert np.prod(generators.closest_factors(12, 3)) == 12
    with pytest.raises(GeometryError):
        generators.point_cloud(spark, "other", 1)


def test_sampler_and_meshes(spark):
    ids = [r["id"] for r in generators.sample_ordered(spark.range(100), 10).orderBy("id").collect()]
    state, want = 1337 % 9 + 1, []
    for i in range(100):
        if len(want) < 10:
            state = state * 48271 % 0x7FFFFFFF
            if state % (100 - i) < 10 - len(want):
                want.append(i)
    assert ids == want and len(ids) == 10
    v, f = generators.icosahedron()
    assert len(v) == 12 and len(f) == 20
    assert generators.sphere_mesh(spark, 2, 0.3).count() == 320
    assert generators.plane_mesh(spark, 3).count() == 18


def test_streams(spark, tmp_path):
    values = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "id long, x double, y double")
    schema = "id long, x double, y double, t timestamp"
    spark.createDataFrame([(1, 2.2, 0.0), (2, 9.5, 0.5)], "id long, x double, y double").selectExpr("*", "timestamp'2024-01-01 00:10:00' t").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = within_stream(stream(), values, ("x", "y"), 1.0).writeStream.format("memory").queryName("near").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("select query_id, value_id from near").collect()) == [(1, 2), (1, 3), (2, 9)]
    q = windowed_counts(stream(), "t", 5.0, ("x",)).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["cell_0"], r["n"]) for r in spark.sql("select * from counted").collect()) == [(0, 1), (1, 1)]
    with pytest.raises(GeometryError):
        within_stream(stream(), values, ("x",), 0)


def test_binary_files_are_read_in_ranges(spark, tmp_path):
    x = np.random.default_rng(2).random((1000, 3)).astype("<f4")
    path = str(tmp_path / "p.bin")
    (tmp_path / "p.bin").write_bytes(np.array([1000, 3], "<i4").tobytes() + x.tobytes())
    df = files.read_points(spark, path, binary=True, rows_at_once=150)
    assert df.rdd.getNumPartitions() == 7
    rows = df.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1000)) and np.allclose([r[1:] for r in rows], x)
    assert files.read_points(spark, "file://" + path, binary=True, max_points=301, rank=1, ranks=2, rows_at_once=50).agg({"id": "min"}).first()[0] == 150
    assert files.read_points(spark, path, binary=True, max_points=0).count() == 0


def test_a_sparse_file_of_gigabytes_is_planned_in_many_tasks(spark, tmp_path):
    path = tmp_path / "big.bin"
    n = 450_000_000
    with open(path, "wb") as f:
        f.write(np.array([n, 3], "<i4").tobytes())
        f.truncate(8 + 12 * n)  # 5.4 GB, of which nothing is stored
    df = files.read_points(spark, str(path), binary=True)
    assert df.rdd.getNumPartitions() == -(-n // files.ROWS_AT_ONCE)
    last = files.read_points(spark, str(path), binary=True, rank=n // 1000 - 1, ranks=n // 1000)
    assert last.count() == 1000 and last.agg({"id": "max"}).first()[0] == n - 1


@pytest.mark.parametrize("per_line", [3, 6, 5])
def test_text_is_read_in_splits(spark, tmp_path, per_line):
    """Whole points on each line, or points across lines, in splits of a few hundred bytes."""
    x = np.random.default_rng(3).random((200, 3))
    flat = [repr(float(v)) for v in x.ravel()]
    lines = ["  200", "3", "", *("\t".join(flat[i : i + per_line]) for i in range(0, 600, per_line))]
    (tmp_path / "p.txt").write_text("\n".join(lines) + "\n")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path / "p.txt")).rdd.getNumPartitions() > 4
        rows = files.read_points(spark, str(tmp_path / "p.txt"), max_points=190).orderBy("id").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert [r["id"] for r in rows] == list(range(190)) and np.allclose([r[1:] for r in rows], x[:190])
