"""The whole flows against their steps done by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabline.functions import kernels as k
from slabline.operators import correct
from slabline.plans import region_queries, trace_queries  # noqa: F401
from slabline.plans import jobs, standins
from slabline.plans.registry import QUERIES


def masked(spark, data):
    from slabline.operators import masks

    spans = masks.intervals(standins.view(spark, data, "exclusions").where("list = '1'"))
    return masks.masked_out(standins.view(spark, data, "traces"), spans)


def test_traces_to_thickness_by_hand(spark, data):
    of = {}
    for r in masked(spark, data).orderBy("track", "trace").collect():
        of.setdefault(r.track, []).append((r.trace, r.samples))
    depth, flat = np.arange(64) * 0.5, {}
    for t, rows in of.items():
        x = np.array([s for _, s in rows])
        x = x - x[:, 0].mean()
        a, b, c = k.fit_decay(depth, np.full(64, len(x)), x.sum(axis=0))
        flat[t] = (((x - c) / a * np.exp(-b * depth) - 1) * np.exp(b * depth))[:, :41]
    cuts = np.quantile(np.concatenate([x.ravel() for x in flat.values()]), jobs.QUANTILES)
    want = {}
    for t, x in flat.items():
        like = k.ice_count(x.T, cuts, least=20).T / 15
        for (trace, _), row in zip(of[t], like, strict=True):
            hit = row[row >= 0.0665]
            want[t, trace] = (len(hit) * 0.5, hit.mean() if len(hit) else None)
    spans = [r for r in standins.view(spark, data, "exclusions").where("list = '0'").collect()]
    firn = {}
    for r in spans:
        lo, dash, hi = r.token.partition("-")
        if dash:
            firn.setdefault(r.track, []).append((int(lo or 0), int(hi or 2**31 - 1)))
    got = QUERIES["flow_traces_to_thickness"](spark, data).collect()
    assert len(got) > 50
    for r in got:
        content, like = want[r.track, r.trace]
        if any(lo <= r.trace < hi for lo, hi in firn.get(r.track, [])):
            content = like = 0
        assert r.content == pytest.approx(content, abs=0.51) and (r.likelihood is None) == (like is None)
    same = np.mean([r.content == pytest.approx(want[r.track, r.trace][0]) for r in got if not any(lo <= r.trace < hi for lo, hi in firn.get(r.track, []))])
    assert same > 0.99  # the fit's last digits may move a sample over a cutoff


def test_radar_to_thickness(spark, data):
    got = QUERIES["flow_radar_to_thickness"](spark, data)
    rows = got.collect()
    assert {r.track for r in rows} == {r.track for r in masked(spark, data).select("track").distinct().collect()} and len(rows) == masked(spark, data).count()
    assert all(0 <= r.content <= 20.5 and (r.likelihood is None or 0 <= r.likelihood <= 1) for r in rows)
    assert any(r.content > 0 for r in rows)
    of = sorted((r.trace, r.distance) for r in rows if r.track == "0")
    assert all(a[1] <= b[1] for a, b in zip(of, of[1:], strict=False))


def test_transect_profiles(spark, data):
    rows = QUERIES["flow_transect_profiles"](spark, data).collect()
    assert rows and all(r.n == 0 or 0 < r.median_value <= 16 for r in rows)
    of = {(r.transect, r.year, r.bin): r for r in rows}
    for (t, y, b), r in of.items():
        three = [of.get((t, y, b + i)) for i in (-1, 0, 1)]
        full = all(x is not None and x.median_value is not None for x in three)
        assert (r.roll_median_value is not None) == full
        if full:
            assert r.roll_median_value == pytest.approx(np.median([x.median_value for x in three]))


def test_depth_fits_by_grid(spark, data):
    """No A, B, C of a fine grid around the fit loses less."""
    x = {}
    for r in standins.view(spark, data, "traces").collect():
        x.setdefault(r.track, []).append(r.samples)
    d = np.arange(64) * 0.5
    for r in QUERIES["r8_depth_fit"](spark, data).collect():
        z = np.array(x[r.track])
        loss = lambda a, b, c: ((z - a * np.exp(b * d) - c) ** 2).sum()
        assert r.b <= 0 and r.c <= 0
        best = loss(r.a, r.b, r.c)
        for b in [-(10.0**e) for e in np.linspace(-4, 1.5, 40)] + [r.b * f for f in (0.9, 0.99, 1.01, 1.1)]:
            g = np.exp(b * d)
            for c in np.minimum(0, r.c + np.linspace(-0.05, 0.05, 21)):
                a = ((z - c) * g).sum() / (len(z) * (g * g).sum())
                assert loss(a, b, c) >= best * (1 - 1e-5)


def test_smoothed_roll_curves(spark):
    d = np.arange(40) * 0.5
    rows = [("t", i, float(-0.02 * np.exp(-0.2 * x)), float(0.5 * np.exp(-0.1 * x) - 3)) for i, x in enumerate(d)]
    fit = spark.createDataFrame(rows, "track string, depth_idx int, a double, c double")
    depths = spark.createDataFrame([("t", i, float(x)) for i, x in enumerate(d)], "track string, depth_idx int, depth double")
    decay = correct.roll_decay(fit, depths)
    r = decay.first()
    assert (r.a_r, r.a_s, r.c_t, r.c_u, r.c_v) == pytest.approx((-0.02, -0.2, 0.5, -0.1, -3), rel=1e-3)
    assert r.a_rvalue == pytest.approx(1) and r.c_pvalue < 1e-12
    t = spark.createDataFrame([("t", 0, [-3.0] * 40, 6.0)], "track string, trace long, samples array<double>, roll_filled double")
    got = correct.roll_corrected(t, correct.roll_curves(decay, F.array(*[F.lit(float(x)) for x in d]))).first().samples
    a, c = -0.02 * np.exp(-0.2 * d), 0.5 * np.exp(-0.1 * d) - 3
    assert got == pytest.approx(list(-3 * c / (a * 36 + c)), rel=1e-3)


def test_roll_ends_are_those_of_the_kept_traces(spark):
    """A masked track's ends are copied within what is left, not from masked neighbours."""
    rolls = [None, 0.01, None, 0.05, None, 0.02, 0.03, None]
    positions = spark.createDataFrame([("t", i, -50 + i / 100, 68.0, r) for i, r in enumerate(rolls)], "track string, trace long, lon double, lat double, roll double")
    at = positions.withColumn("curvature", F.lit(0.0)).where("trace between 2 and 6")
    got = {r.trace: r.roll_filled for r in correct.filled_roll(at).collect()}
    assert got[2] == pytest.approx(np.degrees(0.05)) and got[4] == pytest.approx(np.degrees(0.035))
    traces = spark.createDataFrame([("t", i, [float(-5 - (i * 7 + k) % 3) for k in range(6)]) for i in range(2, 7)], "track string, trace long, samples array<double>")
    rows = jobs.roll_levelled(traces, positions, 0.5).collect()
    assert sorted(r.trace for r in rows) == [2, 3, 4, 5, 6] and all(len(r.samples) == 6 and None not in r.samples for r in rows)


def test_flows_take_any_number_of_samples(spark):
    """Beyond 4,096 samples none is lost."""
    rng = np.random.default_rng(0)
    rows = [("t", i, (-2 * np.exp(-0.0004 * np.arange(5000)) - 1 + 0.01 * rng.standard_normal(5000)).tolist()) for i in range(4)]
    traces = spark.createDataFrame(rows, "track string, trace long, samples array<double>")
    for r in jobs.corrected_traces(traces, 0.5).collect():
        assert len(r.samples) == 5000 and None not in r.samples
    positions = spark.createDataFrame([("t", i, -50 + i / 100, 68.0, 0.01 * i) for i in range(4)], "track string, trace long, lon double, lat double, roll double")
    for r in jobs.roll_levelled(traces, positions, 0.5).collect():
        assert len(r.samples) == 5000 and None not in r.samples


def test_regressions_of_curvature_on_roll(spark):
    """Against a fit by hand per cutoff, with p from the integral of Student's density."""
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(0, 0.03, 400))
    y = 0.01 * x + rng.normal(0, 0.0008, 400)
    rows = [(float(a) * (-1) ** i, float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(None, 1.0), (0.1, None), (float("nan"), 0.0)]
    got = {(r.cutoff, r.side): r for r in correct.roll_curvature(spark.createDataFrame(rows, "roll double, curvature_per_m double")).collect()}
    x, y = np.degrees(x), np.degrees(y)
    want = {(None, "all"): np.ones(400, bool)}
    for cutoff in np.arange(0, x.max(), 0.5):
        want |= {(cutoff, "below"): x < cutoff, (cutoff, "above"): x >= cutoff}
    assert set(got) == {k for k, m in want.items() if m.any()} and len(want) > 10

    def tail(t, df):
        u = np.linspace(0, np.pi / 2, 200_001)[:-1]  # t = sqrt(df) tan u
        d = np.cos(u) ** (df - 1)
        return d[u > np.arctan(t / np.sqrt(df))].sum() / d.sum()

    for k, m in want.items():
        if m.sum() > 2:
            slope, intercept = np.polyfit(x[m], y[m], 1)
            r = np.corrcoef(x[m], y[m])[0, 1]
            g = got[k]
            assert (g.slope, g.intercept, g.r, g.n) == (pytest.approx(slope, rel=1e-6), pytest.approx(intercept, rel=1e-6, abs=1e-9), pytest.approx(r, rel=1e-6), m.sum())
            df = int(m.sum()) - 2
            assert g.p == pytest.approx(tail(abs(r) * np.sqrt(df / (1 - r * r)), df), rel=2e-3, abs=1e-4)
    few = correct.roll_curvature(spark.createDataFrame([(0.1, 1.0)], "roll double, curvature_per_m double")).collect()
    assert all(r.n == 1 and r.slope is None and r.p is None for r in few)
    assert correct.roll_curvature(spark.createDataFrame([], "roll double, curvature_per_m double")).count() == 0
