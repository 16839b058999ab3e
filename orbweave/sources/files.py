"""Readers and writers of point clouds, meshes, edges and labels.

Text is read by Spark in splits, so any file system that Spark knows serves. Binary files are read in ranges of rows
by a data source that seeks, through the file systems of pyarrow (local or network mounts, S3, GCS, HDFS). No reader
takes a file as a whole or brings its rows to the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from orbweave.functions.errors import GeometryError
from orbweave.plans.shared import splittable_join

AXES = ("x", "y", "z")


def _names(d: int) -> list[str]:
    return list(AXES[:d]) if d <= 3 else [f"c{i}" for i in range(d)]


#: Rows that one task reads of a file of equally long rows.
ROWS_AT_ONCE = 1 << 22


def _opened(path: str) -> pa.NativeFile:
    """A file of a local or shared folder, or of another store that pyarrow knows, for reading at any place."""
    store, at = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return store.open_input_file(at)


class FixedRows(DataSource):
    """Rows of ``width`` little-endian numbers of 4 bytes from byte ``start`` on, ``lo`` to ``hi``, read in ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "fixed_rows"

    def schema(self) -> str:
        return self.options["ddl"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return FixedRowsReader(self.options, schema)


class FixedRowsReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.kind = options["path"], options["kind"]
        self.start, self.width, self.lo, self.hi, self.most = (int(options[k]) for k in ("start", "width", "lo", "hi", "most"))
        self.names, self.whole = schema.names, options["kind"] == "<i4"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((at, min(self.hi, at + self.most))) for at in range(self.lo, self.hi, self.most)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        lo, hi = partition.value
        if lo == hi:
            return
        with _opened(self.path) as f:
            f.seek(self.start + 4 * self.width * lo)
            for at in range(lo, hi, 1 << 16):
                n = min(1 << 16, hi - at)
                x = np.frombuffer(f.read(4 * self.width * n), self.kind).reshape(n, self.width).astype(np.int64 if self.whole else np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *(pa.array(x[:, i]) for i in range(self.width))], self.names)


def _fixed_rows(spark: SparkSession, path: str, ddl: str, kind: str, start: int, width: int, lo: int, hi: int, most: int) -> DataFrame:
    spark.dataSource.register(FixedRows)
    return spark.read.format("fixed_rows").options(ddl=ddl, kind=kind, start=start, width=width, lo=lo, hi=hi, most=most).load(path)


def numbered_words(spark: SparkSession, path: str) -> DataFrame:
    """(at, words) for each line of a text file that has some: its words and the number of words before it.

    The lines of each split of the file are counted by themselves, and the splits' totals run in the order of where
    they begin; only one number for each split comes to the driver.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    totals = sorted((r["block"], r["n"]) for r in lines.groupBy("block").agg(F.sum(F.size("words")).alias("n")).collect())
    before = dict(zip([b for b, _ in totals], np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))
    start = F.element_at(F.from_json(F.lit(json.dumps({str(b): n for b, n in before.items()})), "map<string,bigint>"), F.col("block").cast("string"))
    inside = F.sum(F.size("words")).over(Window.partitionBy("block").orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
    return lines.select((F.coalesce(inside, F.lit(0)) + start).alias("at"), "words")


def _head(words: DataFrame, path: str) -> tuple[int, int]:
    """The first two numbers of a file."""
    first = [w for r in words.where("at < 2").orderBy("at").limit(2).collect() for w in r["words"]]
    if len(first) < 2:
        raise GeometryError(f"no numbers at {path}")
    return int(first[0]), int(first[1])


def _each_word(words: DataFrame) -> DataFrame:
    """(i, word) with i from 0 for the first word after the first two."""
    return words.select("at", F.posexplode("words").alias("p", "word")).select((F.col("at") + F.col("p") - 2).alias("i"), "word").where("i >= 0")


def _in_rows(words: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
    """(id, ...) of (i, word), as many consecutive words a row as there are names."""
    d = len(names)
    return words.groupBy(F.floor(F.col("i") / d).alias("id")).agg(*(F.max(F.when(F.col("i") % d == a, F.col("word").cast(kind))).alias(c) for a, c in enumerate(names)))


def read_points(spark: SparkSession, path: str, binary: bool = False, max_points: int | None = None, rank: int = 0, ranks: int = 1, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """(id, x, y, ...) of a cloud ``[n, d, coordinates...]``: text of numbers, or 4-byte integers and floats.

    Either is read by many tasks: a binary file in ranges of ``rows_at_once`` rows, a text in Spark's splits. Text with
    whole points on each line needs no shuffle. ``max_points`` keeps the first points. Of a binary file, ``rank`` of
    ``ranks`` reads one even slice.
    """
    if ranks > 1 and not binary:
        raise GeometryError("only binary files are read in slices")
    if binary:
        with _opened(path) as f:
            n, d = np.frombuffer(f.read(8), "<i4").tolist()
        n = min(n, max_points) if max_points is not None else n
        ddl = "id long, " + ", ".join(f"{c} double" for c in _names(d))
        return _fixed_rows(spark, path, ddl, "<f4", 8, d, n * rank // ranks, n * (rank + 1) // ranks, rows_at_once)
    words = numbered_words(spark, path)
    n, d = _head(words, path)
    n, names = min(n, max_points) if max_points is not None else n, _names(d)
    body = words.where(F.col("at") + F.size("words") > 2)
    if body.where((F.col("at") < 2) | ((F.col("at") - 2) % d != 0) | (F.size("words") % d != 0)).isEmpty():
        each = body.select(((F.col("at") - 2) / d).cast("long").alias("__first"), "words", F.explode(F.sequence(F.lit(0), (F.size("words") / d).cast("int") - 1)).alias("__p"))
        points = each.select((F.col("__first") + F.col("__p")).alias("id"), *(F.element_at("words", F.col("__p") * d + a + 1).cast("double").alias(c) for a, c in enumerate(names)))
    else:
        points = _in_rows(_each_word(words), names, "double")
    return points.where(F.col("id") < n)


def read_points_csv(spark: SparkSession, path: str, names: Sequence[str] = AXES, header: bool = False) -> DataFrame:
    """Coordinates, a point a line, with the line's ``id`` in file order."""
    from orbweave.operators.spatial import attach_indices

    rows = spark.read.csv(path, schema=", ".join(f"{n} double" for n in names), header=header)
    return attach_indices(rows, "id").select("id", *names)


def read_edges_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(source, target, weight)."""
    return spark.read.csv(path, schema="source long, target long, weight double", header=header)


def read_triangles(spark: SparkSession, path: str) -> DataFrame:
    """(id, ax, ay, az, bx, ..., cz) of a mesh: numbers of points and triangles, the points, then corners counted from 1.

    The text is read in Spark's splits; corners meet their points in a join.
    """
    words = numbered_words(spark, path)
    n, m = _head(words, path)
    each = _each_word(words)
    points = _in_rows(each.where(F.col("i") < 3 * n), AXES, "double")
    corner = each.where((F.col("i") >= 3 * n) & (F.col("i") < 3 * (n + m))).select((F.col("i") - 3 * n).alias("i"), (F.col("word").cast("long") - 1).alias("point"))
    met = splittable_join(corner, points.withColumnRenamed("id", "point"), "point")
    columns = [F.max(F.when(F.col("i") % 3 == k, F.col(c))).alias(f"{v}{c}") for k, v in enumerate("abc") for c in AXES]
    return met.groupBy(F.floor(F.col("i") / 3).alias("id")).agg(*columns)


MESH = [f"{v}{c}" for v in "abc" for c in "xyz"]


def write_labels(labels: DataFrame, path: str, id: str = "id") -> None:
    """Labels in order of id as one binary file ``[n, labels...]`` of 4-byte integers, through the file system of ``path``.

    One file takes one sequential writer: the driver streams the sorted labels part by part. For large clouds write
    Parquet. Labels, or a number of rows, that don't fit into 4 bytes are an error, and then no file is made.
    """
    n, least, most = labels.agg(F.count("*"), F.coalesce(F.min("label"), F.lit(0)), F.coalesce(F.max("label"), F.lit(0))).first()
    if min(least, 0) < -(1 << 31) or max(n, most) >= 1 << 31:
        raise GeometryError("labels and their number must fit into 4 bytes")
    spark = labels.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(np.array([n], "<i4").tobytes()))
        held: list[int] = []
        for r in labels.orderBy(id).select("label").toLocalIterator():
            held.append(r["label"])
            if len(held) == 1 << 16:
                out.write(bytearray(np.array(held, "<i4").tobytes()))
                held = []
        out.write(bytearray(np.array(held, "<i4").tobytes()))
    finally:
        out.close()


def read_labels(spark: SparkSession, path: str, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """(id, label) of a file that :func:`write_labels` made, in ranges of ``rows_at_once`` rows."""
    with _opened(path) as f:
        n = int(np.frombuffer(f.read(4), "<i4")[0])
    return _fixed_rows(spark, path, "id long, label long", "<i4", 4, 1, 0, n, rows_at_once)


def write_vtk(mesh: DataFrame, path: str, values: str | None = None) -> None:
    """A triangle mesh (columns of MESH) as a legacy VTK text file, with ``values`` as data of the triangles.

    One text file takes one writer: the driver streams the rows in order of id, once for each section.
    """
    spark = mesh.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    n = mesh.count()
    rows = lambda *columns: mesh.orderBy("id").select(*columns).toLocalIterator()
    put = lambda text: out.write(bytearray(text.encode()))
    try:
        put(f"# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET POLYDATA\nPOINTS {3 * n} double\n")
        for r in rows(*MESH):
            put("".join(f"{r[i]!r} {r[i + 1]!r} {r[i + 2]!r}\n" for i in (0, 3, 6)))
        put(f"POLYGONS {n} {4 * n}\n" + "".join(f"3 {3 * i} {3 * i + 1} {3 * i + 2}\n" for i in range(n)))
        if values:
            put(f"CELL_DATA {n}\nSCALARS {values} double 1\nLOOKUP_TABLE default\n")
            for r in rows(values):
                put(f"{float(r[0])!r}\n")
    finally:
        out.close()
