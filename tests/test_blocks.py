"""Components over blocks of columns against the whole image, and the registered kernels against brute force."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from test_kernels import flooded

from slabline.functions import kernels as k
from slabline.operators import blocks, identify, validate
from slabline.operators import traces as tr
from slabline.plans import jobs, region_queries, standins, trace_queries
from slabline.plans.registry import QUERIES, Inputs


@pytest.fixture(params=[4096, 16])
def block(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", request.param)
    return request.param


def images_of(spark, data):
    """Samples by track as depth x trace matrices."""
    of = defaultdict(list)
    for r in standins.view(spark, data, "traces").orderBy("track", "trace").collect():
        of[r.track].append(r.samples)
    return {t: np.array(x).T for t, x in of.items()}


def test_components_of_blocks(spark, data, block):
    want = []
    for t, values in images_of(spark, data).items():
        for q, cut in trace_queries.CUTS.items():
            seen, sizes = flooded(k.below(values, cut))
            for i, n in enumerate(sizes):
                depth, col = np.nonzero(seen == i + 1)
                want.append((t, q, int((col * 64 + depth).min()), n))
    got = [(r.track, r.quantile, r.label, r.size) for r in QUERIES["i2_i3_components"](spark, data).collect()]
    assert sorted(got) == sorted(want)


def test_counts_of_blocks(spark, data, block):
    cut = np.array(list(trace_queries.CUTS.values()))
    want = {(t, j): c.tolist() for t, v in images_of(spark, data).items() for j, c in enumerate(k.ice_count(v, cut, least=20).T)}
    got = identify.ice_counts(standins.view(spark, data, "traces"), cut.tolist(), least=20).collect()
    assert {(r.track, r.trace): r.counts for r in got} == want


def test_error_grid_by_brute_force(spark, data, block):
    totals = defaultdict(lambda: np.zeros(3))
    for v in images_of(spark, data).values():
        ref = v < -0.1
        for name in ("orig", "S1", "SG1", "SG2"):
            for q, cut in trace_queries.CUTS.items():
                seen, sizes = flooded(k.below(v, cut, name))
                for t in (0, 10, 50, 350):
                    ice = np.isin(seen, [i + 1 for i, n in enumerate(sizes) if n >= t])
                    totals[name, q, t] += [(ice & ~ref).sum(), (ref & ~ice).sum(), ref.size]
    want = {key: (fp / n, fn / n) for key, (fp, fn, n) in totals.items()}
    got = {(r.algorithm, r.quantile, r.threshold): (r.type_1, r.type_2) for r in QUERIES["v6_error_grid"](spark, data).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def plainly_followed(traces, at, radius, search):
    """The surface trace by trace, sample by sample."""
    weights, depth, out = k.step_kernel(radius), len(traces), []
    for column in traces.T:
        def score(place, column=column):
            return sum(w * column[min(max(place + i - radius, 0), depth - 1)] for i, w in enumerate(weights))
        best = max(range(at - search, at + search), key=lambda p: (round(score(min(max(p, -10**6), 10**6)), 9), -p))
        at = min(max(best, 0), depth - 1)
        out.append(at)
    return out


def test_surface_by_brute_force(spark, data, block):
    want = {}
    for t, values in images_of(spark, data).items():
        line = plainly_followed(values, 20, 8, 12)
        want |= {(t, j): s for j, s in enumerate(k.without_jumps(np.array(line)).tolist())}
    got = {(r.track, r.trace): r.surface for r in QUERIES["d11_d12_surface"](spark, data).collect()}
    assert got == want


def test_numbering_without_gaps(spark, block):
    t = spark.createDataFrame([("a", i * 7 % 1000) for i in range(1000) if i % 3] + [("b", 5)], "track string, trace long")
    got = sorted((r.track, r.trace, r.col) for r in identify.dense(t).collect())
    assert [c for t_, _, c in got if t_ == "a"] == list(range(sum(i % 3 > 0 for i in range(1000)))) and got[-1] == ("b", 5, 0)


def test_no_images(spark):
    none = spark.createDataFrame([], "track string, quantile double, col long, ice array<boolean>")
    assert identify.components(none).count() == 0
    truth = spark.createDataFrame([], "track string, col long, reference array<boolean>")
    assert validate.error_grid(none, truth, ["orig"], [0]).count() == 0


def test_entries_from_ten_thousand_maps(spark):
    """Random maps of tracks of 0, 1, 2, 3, 1000 and 10,001 blocks, put together, against one after the other."""
    rng, maps, starts, want = np.random.default_rng(6), [], [], {}
    for t, blocks_ in enumerate((1, 2, 3, 4, 1001, 10_002)):
        at = int(rng.integers(0, 9))
        starts.append((str(t), at))
        for b in range(blocks_):
            want[str(t), b] = at
            if b < blocks_ - 1:
                ends = rng.permutation(8) if b % 50 else rng.integers(0, 8, 8)
                maps.append((str(t), b, ends.tolist()))
                at = int(ends[min(at, 7)])
    df = spark.createDataFrame(pd.DataFrame(maps, columns=["track", "_block", "ends"]), "track string, _block long, ends array<int>")
    at = tr.entered(df, spark.createDataFrame(starts, "track string, start int"), 10_001)
    assert {(r.track, r._block): r.entry for r in at.collect()} == want


def test_one_block_needs_no_map(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a map was made")

    monkeypatch.setattr(k, "surface_steps", never)
    t = spark.createDataFrame([(str(i), j, [0.0] * 20 + [float(i + 1)] * 20) for i in range(2) for j in range(5)], "track string, trace long, samples array<double>")
    got = tr.followed_surface(t, spark.createDataFrame([("0", 18), ("1", 22), ("2", 1)], "track string, start int"), 4, 6).collect()
    assert len(got) == 10 and len({r.surface for r in got}) == 1


def test_hulls_by_mask_by_brute_force(spark, data):
    """Points of each region, period and mask picked one by one, and their triangles' areas added."""
    v = Inputs(spark, data)
    points = jobs.slab_points(v("thickness"), jobs.polygons(v("areas"))).select("region", "period", "x", "y").collect()
    masks = region_queries._masks(v).collect()
    at = {}
    for p in points:
        for m in masks:
            if m.region == p.region and m.ring[0].x < p.x < m.ring[2].x and m.ring[0].y < p.y < m.ring[2].y:
                for period in {p.period} | ({"2017-2018"} if p.period == "2011-2012" else set()):
                    at.setdefault((p.region, period, m["mask"]), set()).add((p.x, p.y))
    want = {}
    for (region, period, _), of in at.items():
        alpha, area = 2e-5, 0.0
        while len(of) > 2 and not (area := k.alpha_area(np.array(sorted(of)), alpha)) and alpha > 1e-12:
            alpha /= 2
        a, n = want.get((region, period), (0.0, 0))
        want[region, period] = a + area, n + len(of)
    got = {(r.region, r.period): (r.area, r.n) for r in QUERIES["g13_mask_areas"](spark, data).collect()}
    assert len({x[2] for x in at}) == 3 and got.keys() == want.keys()
    assert all(got[x] == (pytest.approx(want[x][0], rel=1e-9), want[x][1]) for x in want)
