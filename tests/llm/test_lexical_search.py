"""Ranked search: against scoring every pair, bounds and ties on random rows, odd tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from slabline.llm import _common as c
from slabline.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(docs, items, top=10):
    split = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(i, split(t)) for i, t in docs]
    many, length = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in terms:
            if t:
                tf, m = Counter(t), 100 - 90 + 90 * len(t) * many // length
                s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m)) for x in set(split(text)) if x in tf)
                scores += [(-s, i is None, i)] if s > 0 else []
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def found(spark, docs, items, **how):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return ls.ranked(docs, spark.createDataFrame(items, "item_id long, text string"), c.Scratch(spark), **how)


def test_terms():
    assert ls.terms("Ab-cD9 Éa_\x00ñ€X!") == [x.encode() for x in ("ab", "cd9", "Éa", "ñ€x")]
    assert ls.terms(None) == ls.terms(" .\n") == []


@pytest.mark.parametrize("most", [2048, 7])
def test_same_as_every_pair(spark, most):
    """Words of very different frequency, copies (ties), null, empty and long texts, repeated items."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    docs = [(int(i), text(int(rng.integers(1, 60)))) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(60)] + [(3, None), (None, docs[0][1]), (None, ""), (7, docs[7][1]), (2000, text(30_000)), (2001, "w299 " * 9)]
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(25)] + [(25, None), (26, "unheard of"), (27, "W299, w0!"), (1, docs[0][1]), (28, docs[0][1]), (28, docs[0][1]), (None, "w5 w250")]
    got = found(spark, docs, items, most=most, sample=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(by_hand(docs, items), key=repr)


def test_trees_bound_what_they_hold():
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 9, (200, 30)) * (rng.random((200, 30)) < 0.2)
    dense[50:90] = dense[50]
    at = np.concatenate([[0], np.cumsum((dense > 0).sum(axis=1))])
    rows = ls.Rows(at, np.nonzero(dense)[1], dense[dense > 0].astype(float), 30)
    tree, ordered = ls.tree(rows, 8)
    assert (ordered.dense(0, 200) == dense[tree.order]).all() and sorted(tree.order) == list(range(200))
    leaves = tree.left < 0
    assert (tree.hi - tree.lo)[leaves].max() <= 8 and (tree.hi - tree.lo)[leaves].sum() == 200
    for n in range(len(tree.lo)):
        assert (tree.most[n] == dense[tree.order[tree.lo[n] : tree.hi[n]]].max(axis=0)).all()


def test_most_pairs_are_never_scored():
    """Groups of rows without common coordinates: of 4,096 pairs, an item is scored with its group and what
    shares leaves with it."""
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(8), 64)
    cols = group[:, None] * 10 + np.argsort(rng.random((512, 10)), axis=1)[:, :4]
    docs = ls.Rows(np.arange(0, 2049, 4), cols.ravel(), rng.integers(1, 100, 2048).astype(float), 80)
    items = ls.Rows(np.arange(0, 41, 5), (np.arange(8)[:, None] * 10 + np.arange(5)).ravel(), np.ones(40), 80)
    best = ls.Best(np.ones(8), 10)
    scored = ls.dual_search(items, docs, np.zeros(512, bool), np.arange(512), best)
    assert scored <= 2 * 8 * 64
    every = items.dense(0, 8) @ docs.dense(0, 512).T
    for i in range(8):
        want = sorted((-every[i, d], d) for d in range(512))[:10]
        assert [(-s, d) for s, d in zip(best.score[i], best.ids[i], strict=True)] == [x if x[0] < 0 else (1.0, 0) for x in want]


def test_odd_tables(spark):
    assert found(spark, [], [(1, "a b")]).count() == 0
    assert found(spark, [(1, "a b")], []).count() == 0
    assert found(spark, [(1, None), (2, " ")], [(1, "a b"), (2, None)]).count() == 0
    docs = spark.createDataFrame([(1, "one two", 5, "x"), (2, "two", 6, "y")], "doc_id long, text string, id int, cols string")
    items = spark.createDataFrame([(9, "ONE", 1, "z")], "item_id long, text string, _row int, rank string")
    assert [tuple(r)[:3] for r in ls.ranked(docs, items, c.Scratch(spark)).collect()] == [(9, 1, 1)]
