"""Percentiles over whole tables, which no single task may gather."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabline.operators import correct, pooled, transects, validate


@pytest.mark.parametrize("n", [1, 2, 7, 20000])
def test_like_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.3, np.round(rng.normal(size=n), 1), np.exp(9 * rng.normal(size=n)))
    q = [0, 0.05, 0.5, 0.65, 0.79, 0.95, 1]
    got = pooled.percentiles(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "value double"), "value", q)
    assert got == pytest.approx(np.quantile(x, q).tolist(), rel=1e-12)


def test_no_values(spark):
    assert pooled.percentiles(spark.createDataFrame([(None,)], "value double"), "value", [0.5]) is None


def test_users_dont_gather(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile", None)
    x = np.random.default_rng(1).normal(size=500)
    cells = spark.createDataFrame([("ice", float(v)) for v in x] + [("firn", 99.0)], "kind string, value double")
    got = {r.quantile: r.cutoff for r in validate.cutoffs(cells, [0.65, 0.7]).collect()}
    assert got == pytest.approx({q: np.quantile(x, q) for q in (0.65, 0.7)})
    rows = [("a", i, x[10 * i : 10 * i + 10].tolist()) for i in range(50)] + [("b", 0, [1.0, 3.0, 2.0])]
    traces = spark.createDataFrame(rows, "track string, trace long, samples array<double>")
    lo, hi = np.quantile(x, [0.05, 0.95])
    assert correct.rescaled(traces, spark.createDataFrame([("b",)], "track string")).first()["samples"] == pytest.approx([lo, hi, (lo + hi) / 2])


def test_quartiles_by_keys(spark):
    """Keys with nulls among them, of one value, of none, and one with most of the rows."""
    rng = np.random.default_rng(7)
    of = {("a", 1): rng.normal(size=9000).round(2), ("a", None): rng.normal(size=7), (None, 1): np.array([3.0]), ("b", 2): np.array([])}
    rows = [(*k, float(v)) for k, x in of.items() for v in x] + [("b", 2, None), ("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, content double")
    got = {(r.k, r.j): r for r in transects.summary(df, ["k", "j"]).collect()}
    assert got.keys() == of.keys() and got["b", 2].n == 0 and got["b", 2].q50 is None
    for k, x in of.items():
        if len(x):
            assert (got[k].q25, got[k].q50, got[k].q75) == pytest.approx(tuple(np.quantile(x, [0.25, 0.5, 0.75])), rel=1e-12) and got[k].n == len(x)
