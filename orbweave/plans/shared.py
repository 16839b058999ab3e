"""Tables in the folder that the whole cluster shares, and joins that adaptive execution can split."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="orbweave-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where the table of a DataFrame that :func:`materialize` returned lies.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the table that :func:`materialize` returned as ``df``, once nothing will read it again."""
    path = _PATHS.pop(df, None)
    if path is not None:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def splittable_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` whose two inputs are both freshly exchanged.

    The hash of the key is a second join column, so the partitioning that an aggregation left on one side never
    satisfies the join; both inputs then are exchanges of the join itself, which adaptive execution splits where a
    key is hot. Null keys match nothing.
    """
    extra = "__key_hash"
    out = left.withColumn(extra, F.xxhash64(key)).join(right.withColumn(extra, F.xxhash64(key)), [key, extra], how)
    return out.drop(extra)
