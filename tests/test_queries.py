"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from orbweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def plain(v):
    return round(v, 7) + 0.0 if isinstance(v, float) else v


#: Whose operators other tests run on clouds of their own, and which take long.
SLOW = {"cluster_sizes", "dbscan_densebox", "dbscan_star", "friends_of_friends", "reachability_tree", "emst_rounds", "knn_custom_metric", "core_distance"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in df.select(*names).collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())
    assert entry.entry(spark).count() > 0


def test_library_does_not_import_the_pipeline_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/orbweave/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "orbweave.llm" not in open(path).read()
