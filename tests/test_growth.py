"""Steps whose work has to grow no faster than their input, against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from slabline.operators import transects as ts


def test_level_distances_by_bands(spark):
    """Steep profiles, gaps of several levels, ties, one level only, and elevations that are none; samples are
    not multiplied by the levels between neighbours before they are aggregated."""
    rng = random.Random(3)
    rows = [("a", 10.0 * i, rng.choice([0.0, 37.5, 40.0, 60.0, 1012.5, 1237.5, 4000.0, 8999.0])) for i in range(300)]
    rows += [("b", float(i), 20.0 + i) for i in range(20)] + [("c", 5.0, 150.0), ("d", 1.0, -80.0), ("d", 2.0, 20.0), ("d", 3.0, -20.0)]
    odd = [("a", -1.0, x) for x in (None, math.nan, math.inf, -math.inf)] + [("e", 0.0, math.nan), (None, 0.0, 100.0), (None, 1.0, 300.0)]
    df = spark.createDataFrame(rows + odd, "transect string, distance double, elevation double")
    want = set()
    for t in "abcd":
        of = [(d, e) for x, d, e in rows if x == t]
        for k in range(math.ceil(min(e for _, e in of) / 50), math.floor(max(e for _, e in of) / 50) + 1):
            want.add((t, k * 50.0, *min(of, key=lambda p: (abs(p[1] - k * 50), p[0]))))
    got = ts.level_distances(df)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # later steps are printed first


def test_border_is_a_narrow_seam(spark):
    """Of a dense area with a bay, a hole and islands few points go into the hull, and its area stays."""
    import numpy as np

    from slabline.functions import kernels
    from slabline.operators import regions as rg

    rng = np.random.default_rng(5)
    at = rng.random((14_000, 2)) * [500_000, 400_000] - [250_000, 0]
    bay = (np.abs(at[:, 0]) < 60_000) & (at[:, 1] > 150_000)
    hole = np.hypot(at[:, 0] + 160_000, at[:, 1] - 200_000) < 55_000
    at = np.concatenate([at[~bay & ~hole], rng.normal([0, 300_000], 500, (30, 2))])
    d = spark.createDataFrame([("SW", "2010", *map(float, x)) for x in at], "region string, period string, x double, y double")
    assert rg._without_deep(d, ["region", "period"], 2e-5).count() < 0.6 * len(at)
    got = rg.hull_areas(d).first()
    assert got.n == len(at) and got.area == pytest.approx(kernels.alpha_area(at, 2e-5), rel=1e-9)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_firn_by_united_intervals(spark):
    """Repeated, overlapping, empty and touching intervals, a null track and trace, against every interval; no
    trace carries or tries the list of its track's intervals."""
    from slabline.operators import masks

    rng = random.Random(9)
    spans = [(str(rng.randrange(3)), a := rng.randrange(150), a + rng.randrange(-2, 9)) for _ in range(40)] * 5 + [("0", 140, masks.OPEN_END), (None, 0, 99), ("2", 0, 0)]
    s = spark.createDataFrame(spans, "track string, lo long, hi long")
    rows = [(str(k), i, 1.0, 2.0) for k in range(4) for i in range(160)] + [(None, 5, 1.0, 2.0), ("0", None, 1.0, 2.0), ("0", 150, None, 2.0)]
    t = spark.createDataFrame(rows, "track string, trace long, content double, likelihood double")
    hit = lambda r, end: None not in r[:2] and any(k == r[0] and lo <= r[1] < hi + end for k, lo, hi in spans)
    firn, none = masks.with_porous_firn(t, s, "content", "likelihood"), masks.nulled(t, s, "content")
    assert firn.columns == none.columns == t.columns
    assert sorted(map(tuple, firn.collect()), key=repr) == sorted(((*r[:2], 0.0, 0.0) if hit(r, 0) else r for r in rows), key=repr)
    assert sorted(map(tuple, none.collect()), key=repr) == sorted(((*r[:2], None, r[3]) if hit(r, 1) else r for r in rows), key=repr)
    assert all("collect_list" not in optimized(df) for df in (firn, none))


def test_notes_are_parsed_once(spark):
    """Notes that repeat are one before regular expressions read them."""
    from slabline.operators import masks
    from slabline.plans import jobs

    tokens = [("a", "-3", "0"), ("a", "5", "0"), ("a", "7-", "0"), ("b", "2-4", "0"), ("b", "x", "0"), ("b", "1-2", "1")] * 20
    e = spark.createDataFrame(tokens, "track string, token string, list string")
    of = lambda **k: sorted((r.track, r.lo, r.hi) for r in jobs.listed(e, "0", **k).collect())
    assert of(single=False) == [("a", 0, 3), ("a", 7, masks.OPEN_END), ("b", 2, 4)]
    assert of() == sorted([*of(single=False), ("a", 5, 5)])
    for single in (True, False):
        plan = optimized(jobs.listed(e, "0", single=single))
        assert "RLIKE" in plan and plan.rindex("RLIKE") < plan.index("Aggregate")  # later steps are printed first


def test_bounds_of_a_trace_are_found_once(spark):
    from slabline.operators import correct

    t = spark.createDataFrame([("a", 0, [1.0, 2.0, 5.0]), ("b", 0, [4.0, 3.0, 3.5])], "track string, trace long, samples array<double>")
    df = correct.rescaled(t.withColumn("samples", F.transform("samples", lambda v: v + 1)), spark.createDataFrame([("b",)], "track string"), 0, 1)
    assert df.first().samples == pytest.approx([6.0, 2.0, 4.0])
    assert "array_min" in optimized(df) and not re.search(r"lambdafunction\(.*array_min", optimized(df))


def test_few_traces_are_dealt_over_all_partitions(spark):
    from slabline.plans import jobs

    t = spark.createDataFrame([("a", i, [float(i)]) for i in range(500)], "track string, trace long, samples array<double>")
    kept = jobs.kept_apart(t.repartition(1))
    sizes = kept.rdd.glom().map(len).collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(sizes) > 0 and sum(sizes) == 500


def test_held_tables_are_as_large_as_their_files(spark):
    """The guessed size of a self-join is the square of its input's; kept from round to round its digits double,
    until planning takes minutes. Held tables must not hand it on."""
    from slabline.operators import blocks

    df = spark.range(100).withColumn("a", F.col("id") + 1)
    for _ in range(4):
        df = blocks.held(df.join(df.select("id", F.col("a").alias("b")), "id").select("id", "b").withColumnRenamed("b", "a"))
    assert df.count() == 100 and df.columns == ["id", "a"]
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000
    none = blocks.held(df.where("id < 0"))
    assert none.isEmpty() and none.columns == ["id", "a"]


def test_corrected_traces_are_kept_before_they_are_rescaled(spark):
    """The others' percentiles and both parts of the result read the corrected traces, which are fitted once."""
    from slabline.plans import jobs

    rows = [(t, i, [-1.0 - k / 8 - (i * 7 + k) % 3 for k in range(6)]) for t in "ab" for i in range(5)]
    traces = spark.createDataFrame(rows, "track string, trace long, samples array<double>")
    got = jobs.corrected_traces(traces, 0.5, spark.createDataFrame([("b",)], "track string"))
    assert got.count() == 10 and "aggregate" not in optimized(got).lower()
