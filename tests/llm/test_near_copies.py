"""The pipeline's near copies against brute force over all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from slabline.llm import near_copies, simhash
from slabline.llm._common import Scratch

WORDS = np.array([a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in ("", "n", "ra", "st")])


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept(rows):
    """The smallest id of each component of pairs of similarity 0.8 or more."""
    of, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(of[i] & of[j]) >= 4 * len(of[i] | of[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (k is None, k or 0))
    return sorted(-1 if none else k for none, k in least.values())


def changed(rng, text, n):
    words = text.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def corpus():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(WORDS, int(rng.integers(20, 300)))) for _ in range(120)]
    texts += [changed(rng, t, max(1, len(t.split()) // 60)) for t in texts for _ in range(2)]
    star = " ".join(rng.choice(WORDS, 60))
    texts += [changed(rng, star, 1) for _ in range(150)]  # similar to star, not to each other
    chain = [" ".join(rng.choice(WORDS, 200))]
    for _ in range(30):
        chain.append(changed(rng, chain[-1], 2))
    texts += [*chain, star, None, "", " \t", "one two", "One  two", "one two three", "a b c d e", "A b c d e", "a b c d f"]
    rows = [(i, texts[i]) for i in rng.permutation(len(texts)).tolist()]
    return [*rows, (None, "nobody has this one"), (None, texts[0]), (None, None)]


@pytest.mark.parametrize("members", [256, 16])
def test_stage_keeps_one_of_each_component(spark, monkeypatch, members):
    monkeypatch.setattr(near_copies, "MEMBERS", members)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == kept(rows)


def test_pair_beyond_two_bits(spark):
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(WORDS, 150))
    other = next(t for _ in range(99) if (simhash.fingerprint(t := changed(rng, text, 3)) ^ simhash.fingerprint(text)).bit_count() > 2)
    docs = spark.createDataFrame([(2, other), (1, text)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [1]


def test_no_rows(spark):
    assert near_copies.near_keep_first(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark)).count() == 0


def test_merges_within_blocks():
    import pandas as pd

    full = list(range(100))
    of = [full, full[:85], full[:70], list(range(1000, 1050))]  # 1 links 0 and 2
    pdf = pd.DataFrame({"_row": [5, 6, 7, 8], "_label": [5, 6, 7, 8], "_main": False, "_set": [np.array(x) for x in of]})
    out = near_copies._merges(pdf)
    assert {frozenset(x) for x in out.to_numpy().tolist()} == {frozenset((5, 6)), frozenset((6, 7))}


def test_ball_hashing_finds_its_share(spark, monkeypatch):
    """Without candidates of MinHash bands, pairs within two bits are found; pairs of equal fingerprints that
    share few different shingles are not near copies."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(WORDS, 400)) for _ in range(12)]
    bits = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    near = [next(x for _ in range(999) if bits(t, x := changed(rng, t, 1)) <= 2) for t in texts]
    refrain = " ".join(rng.choice(WORDS, 9)) + " "
    alike = [refrain * 900 + " ".join(rng.choice(WORDS, 15)) for _ in range(2)]
    assert bits(*alike) == 0
    rows = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(near)), *((200 + i, t) for i, t in enumerate(alike))]
    monkeypatch.setattr(near_copies, "_starred", lambda keys: keys.select(keys["_row"].alias("a"), keys["_row"].alias("b")).limit(0))
    got = near_copies.near_keep_first(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark))
    assert sorted(r.doc_id for r in got.collect()) == [*range(12), 200, 201]
