"""Every registered query of the library against its SQL, or its invariants, on the small tables."""

import math
import os

import duckdb
import pytest

from slabline.plans import catalog_queries, region_queries, trace_queries  # noqa: F401
from slabline.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()


def tidy(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x + 0.0, 9)
    return str(x) if x is not None and not isinstance(x, (bool, int, tuple, list)) else x


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(tidy(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["region", "period", "mean_high", "median_high", "sd_high", "max_high"]
    assert set(SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_corpus_operators():
    """Nothing outside the subpackage imports it, but for the guarded entry."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "slabline")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, n)).read(), n
