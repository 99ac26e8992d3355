"""Nearest neighbours by one-bit codes: recall against every pair, bounds, odd vectors."""

import numpy as np
import pytest

from slabline.llm import _common as c
from slabline.llm import vector_search as vs


def by_hand(rows, top=20, step=20):
    fine = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for k, (q, v) in enumerate(fine):
        if q is not None and q % step == 0:
            others = [(i, w) for j, (i, w) in enumerate(fine) if j != k and len(w) == len(v)]
            if others:
                score = vs.products(np.broadcast_to(v, (len(others), len(v))), np.vstack([w for _, w in others]))
                near = sorted((-s, i is None, i or 0) for s, (i, _) in zip(score.tolist(), others, strict=True))
                out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(near[:top])]
    return out


@pytest.mark.parametrize(("dim", "spread", "most", "least"), [(64, 1.0, 16384, 0.99), (200, 0.3, 60, 0.99), (5, 1.0, 16384, 0.9)])
def test_recall_against_every_pair(spark, dim, spread, most, least):
    """Around a few centres and none, with copies, in several slices and blocks of queries."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((6, dim))[rng.integers(0, 6, 3000)] * (spread < 1) + spread * rng.standard_normal((3000, dim))
    x[100:160] = x[100]
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = vs.neighbours(df, "id % 20 = 0", c.Scratch(spark), most=most, first=64).collect()
    want = {}
    for q, _, i, s in by_hand(rows):
        want.setdefault(q, []).append((i, s))
    assert sorted((r.query_id, r["rank"]) for r in got) == sorted((q, k + 1) for q in want for k in range(20))
    hits = sum((r.vec_id, r.score) in want[r.query_id] for r in got)
    assert hits >= least * len(got)


def test_bounds_hold_and_spare_most_pairs():
    """Where rows come in groups; neighbours among independent directions are no closer than the bounds."""
    rng = np.random.default_rng(3)
    centre, turn = rng.standard_normal(128) / 50, vs.rotation(128, 1)
    x = rng.standard_normal((40, 128))[np.arange(4000) % 40] + 0.5 * rng.standard_normal((4000, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of = vs.codes(x, centre, turn)
    q = vs.asked(np.arange(50), x[:50], np.arange(50), centre, turn)
    guess, error = vs.estimates(of, q, slice(None))
    true = x[:50] @ x.T
    assert np.allclose(turn @ turn.T, np.eye(128)) and of.signs.shape == (4000, 2)
    assert (np.abs(guess - true) <= error).mean() > 0.995 and np.abs((guess - true).mean()) < 0.02
    best = vs.Best(np.full(50, np.sort(true, axis=1)[:, -40]), 20)
    ranked = vs.search(x, of, np.arange(4000), np.zeros(4000, bool), np.arange(4000), q, best)
    assert ranked < 0.05 * true.size  # most of a row's own group of 100, little else
    np.fill_diagonal(true, -9)
    assert (best.ids == np.argsort(-true, axis=1)[:, :20]).mean() > 0.99


def test_odd_vectors(spark):
    """Null, empty, zero, with null or non-finite components, of other lengths; ties; repeated rows; null ids."""
    ok = [(i, [float(i % 3), 1.0, -2.0]) for i in range(50)]
    odd = [(60, None), (80, []), (100, [0.0, 0.0, 0.0]), (120, [None, 1.0, 2.0]), (140, [float("nan"), 1.0, 1.0]), (160, [float("inf"), 1.0, 1.0]), (180, [1.0, 2.0]), (200, [3.0, 4.0]), (None, [2.0, 1.0, -2.0]), (0, [0.0, 1.0, -2.0]), (40, [-1.0, -1.0, 5.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in ok + odd], "vec_id long, embedding array<double>, row int, id double").repartition(2)
    for top in (4, 100):
        got = vs.neighbours(df, "id % 20 = 0", c.Scratch(spark), top=top, first=4)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(by_hand(ok + odd, top), key=repr)
    empty = vs.neighbours(df.where("false"), "id % 20 = 0", c.Scratch(spark))
    assert empty.count() == 0
    assert vs.neighbours(df.where("vec_id = 20"), "id % 20 = 0", c.Scratch(spark)).count() == 0


def test_op13_same_as_every_pair(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vs.op13_vector_search(spark, data).collect())
    assert got == sorted((q, r, i, round(s, 9)) for q, r, i, s in by_hand(rows))
