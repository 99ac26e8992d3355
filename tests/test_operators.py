"""Hand-worked edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from slabline.functions import geo
from slabline.operators import catalog, correct, gpsmatch, identify, masks, track, transects, validate
from slabline.operators import regions as rg
from slabline.operators import traces as tr
from slabline.sources import files


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_tokens_under_both_rules(spark):
    t = spark.createDataFrame([("a", "-3"), ("a", "7-"), ("a", "2-4"), ("a", "5"), ("a", "x")], "track string, token string")
    assert rows(masks.intervals(t), "token", "lo", "hi") == [("-3", 0, 3), ("2-4", 2, 4), ("5", 5, 5), ("7-", 7, masks.OPEN_END)]
    assert rows(masks.intervals(t, single=False), "token") == [("-3",), ("2-4",), ("7-",)]


def test_interval_ends(spark):
    t = spark.createDataFrame([("a", i, 1.0) for i in range(7)] + [("b", 0, 1.0)], "track string, trace long, likelihood double")
    spans = spark.createDataFrame([("a", 2, 4), ("a", 3, 4), ("b", 0, 9)], "track string, lo long, hi long")
    assert rows(masks.masked_out(t, spans), "track", "trace") == [("a", 0), ("a", 1), ("a", 5), ("a", 6)]
    zero = rows(masks.with_porous_firn(t, spans).where("likelihood = 0"), "track", "trace")
    assert zero == [("a", 2), ("a", 3), ("b", 0)]
    back = masks.restored(masks.masked_out(t, spans), t)
    assert back.count() == 8 and back.where("likelihood is null").count() == 4


def test_projection_constants(spark):
    p = spark.createDataFrame([(-45.0, 90.0), (-45.0, 70.0), (-40.0, 72.5)], "lon double, lat double")
    x, y = geo.to_polar(F.col("lon"), F.col("lat"))
    got = p.select(x.alias("x"), y.alias("y")).collect()
    assert got[0].x == pytest.approx(0, abs=1e-6) and got[0].y == pytest.approx(0, abs=1e-6)
    assert got[1].x == pytest.approx(0, abs=1e-6) and got[1].y == pytest.approx(-2187960.0, abs=2000)
    lon, lat = geo.from_polar(F.col("x"), F.col("y"))
    back = p.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).where("lat < 90").collect()
    assert all(r.a == pytest.approx(r.lon, abs=1e-9) and r.b == pytest.approx(r.lat, abs=1e-8) for r in back)
    e, n = geo.to_utm22(F.lit(-51.0), F.lit(70.0))
    r = p.limit(1).select(e.alias("e"), n.alias("n")).first()
    assert r.e == pytest.approx(500000) and r.n == pytest.approx(7766055, abs=600)


def test_single_trace_track_has_no_distance(spark):
    t = spark.createDataFrame([("a", 0, 0.0, 0.0), ("b", 0, 0.0, 0.0), ("b", 1, 3.0, 4.0), ("b", 2, None, 4.0), ("b", 3, 3.0, 5.0)], "track string, trace long, x double, y double")
    assert rows(track.with_distance(t), "track", "trace", "distance") == [("a", 0, 0.0), ("b", 0, 0.0), ("b", 1, 5.0), ("b", 2, 5.0), ("b", 3, 5.0)]
    c = track.with_curvature(t)
    assert c.where("track = 'a' and curvature is null").count() == 1


def test_reversed_line_is_turned(spark):
    t = spark.createDataFrame([("a", 0, -40.0), ("a", 1, -41.0), ("b", 0, -41.0), ("b", 1, -40.0)], "track string, trace long, lon double")
    assert rows(track.eastward(t), "track", "trace", "lon") == [("a", 0, -41.0), ("a", 1, -40.0), ("b", 0, -41.0), ("b", 1, -40.0)]


def test_axis_reset(spark):
    v = 299792458.0 / (1 + 0.734 * 0.873 / 1000) / 2
    cases = {"neg": (2010, -12), "zero": (2011, -10), "late": (2012, 0), "kept": (2010, 0)}
    a = spark.createDataFrame([(k, y, [(i + s) / v for i in range(12)]) for k, (y, s) in cases.items()], "track string, year int, times array<double>")
    first = {r.track: r.depths[0] for r in tr.depth_axis(a).collect()}
    assert first["neg"] == 0 and first["zero"] == pytest.approx(-10) and first["late"] == 0 and first["kept"] == 0


def test_cut_at_array_ends(spark):
    t = spark.createDataFrame([("a", 0, [float(i) for i in range(10)], s) for s in (0, 5, 9)], "track string, trace long, samples array<double>, surface int")
    assert [r.samples[0] for r in tr.cut_at_surface(t, 2, 3).collect()] == [0.0, 3.0, 5.0]


def test_trace_without_ice(spark):
    t = spark.createDataFrame([([0.0, 0.0],), ([0.0, 1.0],), ([None, 1.0],)], "likelihood array<double>")
    got = t.select(identify.ice_content(F.col("likelihood"), 0.5).alias("c"), identify.mean_likelihood(F.col("likelihood")).alias("m")).collect()
    assert [(r.c, r.m) for r in got] == [(0.0, None), (0.5, 1.0), (None, 1.0)]


def test_polygon_edges_and_overlaps(spark):
    sq = lambda x0, x1: rg.rectangle(F.lit(x0), F.lit(0), F.lit(x1), F.lit(2))
    shapes = spark.range(1).select(F.lit(2).alias("id"), F.lit("SW").alias("region"), sq(0, 2).alias("ring")).unionByName(spark.range(1).select(F.lit(1).alias("id"), F.lit("CW").alias("region"), sq(1, 3).alias("ring")))
    p = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.5, 1.0), (3, 9.0, 9.0), (4, 3.0, 1.0)], "k int, x double, y double")
    assert rows(rg.clipped(p, shapes, ["k"]), "k", "id") == [(1, 2), (2, 1)]
    assert rows(rg.with_region(p, shapes, ["k"]), "k", "region") == [(1, "SW"), (2, "SW"), (3, "Out"), (4, "Out")]


def test_first_second_that_repeats_in_gps_only(spark):
    radar = spark.createDataFrame([("a", 5, 0), ("a", 6, 1), ("a", 6, 2), ("a", 8, 3)], "radargram string, second long, index_vector long")
    gps = spark.createDataFrame([(5, 0, 1.0, 1.0), (5, 1, 2.0, 2.0), (6, 2, 3.0, 3.0), (6, 3, 4.0, 4.0), (7, 4, 5.0, 5.0)], "second long, index_gps long, lat double, lon double")
    m = gpsmatch.matched(radar, gps)
    assert rows(m, "index_vector", "index_gps", "lat") == [(0, 1, 2.0), (1, 2, 3.0), (2, 3, 4.0), (3, None, 0.0)]
    q = gpsmatch.quality(m).first()
    assert (q.first_match, q.last_match, q.first_3, q.last_3, q.length_match) == (1, 0, 3, 2, False)


def test_roll_fit_bounds(spark):
    cells = [("free", 0, float(-2 * r * r - 1), float(r)) for r in range(5)] + [("up", 0, float(r * r - 9), float(r)) for r in range(3)] + [("pos", 0, 5.0, float(r)) for r in range(3)] + [("one", 0, -4.0, 0.0)]
    c = spark.createDataFrame(cells, "track string, depth_idx int, value double, roll double")
    got = {r.track: (r.a, r.c) for r in correct.roll_fit(c).collect()}
    assert got["free"] == pytest.approx((-2, -1)) and got["up"] == pytest.approx((0, -22 / 3)) and got["pos"] == (0, 0) and got["one"] == (0, -4)


def test_one_class_has_no_accuracy(spark):
    d = spark.createDataFrame([(1, True, True), (1, True, False), (2, True, True), (2, False, False)], "quantile int, predicted boolean, truth boolean")
    assert rows(validate.confusion(d), "quantile", "overall") == [(1, None), (2, 1.0)]


def test_gaps_and_islands_and_lists(spark, tmp_path):
    f = spark.createDataFrame([("20100101", 1, n) for n in (1, 2, 4, 4, 5)], "date string, line int, number int")
    assert rows(catalog.tracks_of_files(f), "track", "n_files") == [("20100101_01_001_002", 2), ("20100101_01_004_005", 2)]
    (tmp_path / "l").write_text("a -3  7-\nb\n\nc 5\n")
    assert rows(files.read_ragged(spark, str(tmp_path / "l")), "track", "tokens") == [("a", ["-3", "7-"]), ("b", []), ("c", ["5"])]
    (tmp_path / "s").write_text("a 17\nb\n")
    assert rows(files.read_starts(spark, str(tmp_path / "s")), "track", "pixel") == [("a", 17), ("b", None)]
    (tmp_path / "q").write_text("0.65 0.66 \n-0.1 2e-3\n")
    assert rows(files.read_cutoffs(spark, str(tmp_path / "q")), "quantile", "cutoff") == [(0.65, -0.1), (0.66, 0.002)]
    (tmp_path / "w.csv").write_text("Year;AirTemperature(C)\n2001;-3,5\n2002;-999\n")
    assert rows(files.read_weather(spark, str(tmp_path / "w.csv")), "Year", "AirTemperature(C)") == [(2001.0, -3.5), (2002.0, None)]


def test_empty_bins_are_kept(spark):
    p = spark.createDataFrame([("t", 2010, d, v) for d, v in ((10.0, 1.0), (20.0, 3.0), (400.0, 4.0), (1000.0, 8.0))], "transect string, year int, distance double, content double")
    b = transects.binned(p, ["transect", "year"])
    assert rows(b, "bin", "n", "median_value") == [(0, 2, 2.0), (1, 1, 4.0), (2, 0, None), (3, 1, 8.0)]
    e = transects.gap_edges(transects.rolling(b, ["transect", "year"]), ["transect", "year"])
    assert rows(e, "bin", "roll_median_value", "edge") == [(0, None, 2.0), (1, None, 4.0), (2, None, None), (3, None, 8.0)]


def test_outline_codes_and_edge(spark):
    """Colours by their first letters; only the largest column past the edge goes, outline by outline."""
    p = [("a", 0, 1.5, "green"), ("a", 0, 2.5, "green"), ("a", 0, 250.4, "green"), ("a", 1, 3.0, "orange"), ("a", 1, 249.4, "orange"), ("a", 2, 7.0, "purple"), ("a", 2, 251.0, "purple"), ("a", 2, 252.0, "purple"), ("a", 3, 9.0, "red"), ("a", 4, 9.0, "blue"), ("a", 5, None, "red"), ("a", 5, float("nan"), "red")]
    d = spark.createDataFrame(p, "track string, outline int, xcoord double, colour string")
    got = rows(gpsmatch.outline_traces(d, 250), "outline", "trace", "code")
    assert got == sorted([(0, 2, 1), (1, 3, 0), (1, 249, 0), (2, 7, 2), (2, 251, 2), (3, 9, -1)], key=repr)


def test_dense_hulls_keep_their_area(spark):
    import numpy as np

    from slabline.functions import kernels

    rng = np.random.default_rng(2)
    at = rng.random((16_000, 2)) * [500_000, 400_000]
    at = at[np.hypot(at[:, 0] - 420_000, at[:, 1] - 60_000) > 130_000]  # with a bay
    d = spark.createDataFrame([("SW", "2010", *map(float, x)) for x in at], "region string, period string, x double, y double")
    assert rg._without_deep(d, ["region", "period"], 2e-5).count() < 0.9 * len(at)
    assert rg.hull_areas(d).first().area == pytest.approx(kernels.alpha_area(at, 2e-5), rel=1e-9)


def test_hulls_of_tiles(spark):
    import numpy as np

    from slabline.functions import kernels

    rng = np.random.default_rng(4)
    at = rng.random((1500, 2)) * [900_000, 400_000]
    at = at[(at[:, 0] < 300_000) | (at[:, 1] < 150_000)]  # a concave area
    few = [(0.0, 0.0), (400_000.0, 0.0), (0.0, 400_000.0), (399_000.0, 399_000.0)]  # only alpha halved has a shape
    p = [("SW", "2011-2012", *map(float, x)) for x in at[:700]] + [("SW", "2017-2018", *map(float, x)) for x in at[700:]] + [("NO", "2010", *x) for x in few] + [("NE", "2010", 1.0, 1.0), ("NE", "2010", 2.0, 5.0), ("Out", "2010", 1.0, 1.0)]
    d = spark.createDataFrame(p + p[:50], "region string, period string, x double, y double")
    got = {(r.region, r.period): (r.area, r.n) for r in rg.hull_areas(d).collect()}
    assert got["SW", "2011-2012"] == (pytest.approx(kernels.alpha_area(at[:700], 2e-5), rel=1e-9), 700)
    assert got["SW", "2017-2018"] == (pytest.approx(kernels.alpha_area(at, 2e-5), rel=1e-9), len(at))
    assert got["NE", "2010"] == (0.0, 2) and got["NO", "2010"][0] == pytest.approx(kernels.convex_area(np.array(few)), rel=0.01) and len(got) == 4
    thin = {(r.region, r.period): r.area for r in rg.hull_areas(d, thin=5_000.0).collect()}
    assert thin["SW", "2017-2018"] == pytest.approx(got["SW", "2017-2018"][0], rel=0.02)


def test_united_intervals(spark):
    """Overlapping, touching, contained, repeated and swapped intervals, by list; against every trace."""
    rng = random.Random(2)
    spans = [(str(rng.randrange(3)), str(rng.randrange(2)), a := rng.randrange(200), a + rng.randrange(-2, 15)) for _ in range(60)] + [("0", "1", 5, masks.OPEN_END), ("9", "0", 0, 3)]
    df = spark.createDataFrame(spans, "track string, list string, lo long, hi long")
    one = [tuple(r) for r in masks.united(df, "list").select("track", "list", "lo", "hi").collect()]
    for k in {s[:2] for s in spans}:
        mine = sorted(s[2:] for s in one if s[:2] == k)
        assert all(a[1] + 1 < b[0] for a, b in zip(mine, mine[1:], strict=False))
        for t in range(230):
            assert any(lo <= t <= hi for lo, hi in mine) == any(s[:2] == k and s[2] <= t <= s[3] for s in spans)
    traces = spark.createDataFrame([(str(k), t) for k in range(4) for t in range(230)], "track string, trace long")
    share = masks.exclusion_shares(traces, df)
    got = {r.list: (r.n_excluded, r.percent) for r in share.collect()}
    for name in "01":
        n = sum(any(s[:2] == (str(k), name) and s[2] <= t <= s[3] for s in spans) for k in range(4) for t in range(230))
        assert got[name] == (n, pytest.approx(100 * n / 920))
    kept = masks.masked_out(traces, df).count()
    assert kept + masks.excluded(traces, df).count() == 920 and kept == sum(not any(s[0] == str(k) and s[2] <= t <= s[3] for s in spans) for k in range(4) for t in range(230))
