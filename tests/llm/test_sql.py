"""The corpus queries that SQL can express, against it."""

import duckdb
import pytest

from slabline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
