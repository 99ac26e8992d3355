"""Deduplication operators against brute force."""

import numpy as np
import pytest
import xxhash

from slabline.llm import embedding_dedup as emb
from slabline.llm import exact_dedup, simhash
from slabline.llm._common import Scratch, components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def joined(pairs, nodes):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-50, 150, (120, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(60)]  # a path and a star
    got = components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()
    want = joined(pairs, {n for p in pairs for n in p if p[0] != p[1]})
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def random_texts(rng, n):
    return [" ".join(rng.choice(WORDS, rng.integers(0, 12))) for _ in range(n)]


def test_exact_copies(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FIRST", 2)  # many digits
    rng = np.random.default_rng(3)
    rows = list(enumerate(random_texts(rng, 60)))
    rows += [(100 + i, f" {t}\t\n") for i, t in rows[:20]] + [(200, None), (201, ""), (202, "x" * 3000), (203, "x" * 2999 + "y"), (204, "x" * 3000), (None, "x" * 3000 + "  "), (205, "Ç é"), (206, "Çé")]
    rows += [(300, "twice"), (300, "twice")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, _norm string, kept int")
    got = exact_dedup.exact_classes(docs, Scratch(spark)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split(" ")).translate({c: None for c in b"\t\n\x0b\x0c\r"}), []).append((-len(t or ""), i is None, i or 0, i))
    want = {}
    for g in groups.values():
        for x in g:
            want[x[3]] = (min(g)[3], len(g))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.exact_keep_first(docs, Scratch(spark))
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert kept.where("doc_id = 300").count() == 1 and kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("text, bits", [("", 0), (None, 0), (" \t\n", 0)])
def test_fingerprint_of_nothing(text, bits):
    assert simhash.fingerprint(text) == bits


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_of_a_long_text():
    rng = np.random.default_rng(6)
    text = " ".join(map(str, rng.integers(0, 5000, simhash.BLOCK * 2 + 77)))
    assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def test_long_copies_take_several_digits(spark):
    long = "".join(chr(97 + i % 26) for i in range(200_000))
    rows = [(1, long), (2, long[:-1] + "!"), (3, long[:70_000] + " " + long[70_000:]), (4, "!" + long[1:]), (5, long[:100] + "!" + long[101:])]
    got = exact_dedup.exact_classes(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (4, 1, True), 5: (5, 1, True)}


def test_simhash_classes(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(WORDS, 300)) for _ in range(6)]
    texts = random_texts(rng, 30) + base
    for b in base:
        for _ in range(8):
            w = b.split(" ")
            w[rng.integers(300)] = "other"
            texts.append(" ".join(w))
    texts += [None, "", "ONE", "one", "É x y z", "one two", "Z" * 5000]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, _fp string")
    got = {r.doc_id: r for r in simhash.simhash_classes(docs, Scratch(spark)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in enumerate(fps))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = joined(pairs, range(len(fps)))
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.simhash_keep_first(docs.union(docs.limit(3)), Scratch(spark))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_classes(none, Scratch(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (None, "c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.simhash_classes(odd, Scratch(spark)).collect())
    assert got == [(-1, -1), (-1, 7), (-1, 7), (7, 7)]
    with pytest.raises(ValueError):
        simhash.linked(odd, 3)


@pytest.mark.parametrize("chunk", [4, 512])
def test_embedding_classes(spark, chunk, monkeypatch):
    monkeypatch.setattr(emb, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    vecs = rng.standard_normal((60, 16))
    near = [v + rng.standard_normal(16) * s for v in vecs[:8] for s in (0.01, 0.1, 0.2, 0.25, 0.3, 0.3)]
    rows = [list(map(float, v)) for v in [*vecs, *near, vecs[0], vecs[0] * 3, vecs[1]]]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    data = [(i, v, 0) for i, v in enumerate(rows + bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, w int")
    got = {r.vec_id: r for r in emb.vector_classes(df, Scratch(spark), recall=1 - 1e-9).collect()}
    u = emb.unit(np.array(rows))
    cos = u @ u.T
    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and cos[i, j] >= 0.95]
    want = joined(pairs, range(len(data)))
    assert {i: got[i].component_id for i in got} == want
    assert [got[i].n_links for i in range(len(data))] == [sum(a == i for a, _ in pairs) for i in range(len(data))]
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_embedding_recall():
    rng = np.random.default_rng(1)
    bits, tables = emb.tables_for(50_000)
    a = emb.unit(rng.standard_normal((2000, 64)))
    side = rng.standard_normal((2000, 64))
    side = emb.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    met = (emb.signatures(a, bits, tables, 11) == emb.signatures(b, bits, tables, 11)).any(axis=1)
    assert met.mean() > 0.99


def test_embedding_sql_on_links(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(2)
    v = rng.standard_normal((12, 64)).astype("float32")
    rows = [(i, [float(x) for x in v[i % 12] + (i // 12) * 0.01]) for i in range(36)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    want = sorted(con.sql(emb.OP1_SQL).fetchall())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in emb.vector_classes(df, Scratch(spark)).collect())
    assert got == want and sum(x[1] for x in got) >= 72


def test_embedding_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert emb.vector_classes(none, Scratch(spark)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in emb.vector_classes(odd, Scratch(spark)).collect())
    assert got == [(-1, 0, -1), (-1, 2, 4), (4, 2, 4), (4, 2, 4)]


def test_exact_keep_first_with_any_column_names(spark):
    rows = [(1, "a b", 1, "p", True, 5, "u"), (2, "ab", 2, "q", False, 6, "v"), (3, None, 3, "r", True, 7, "w"), (4, "", 4, "s", None, 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_is_null int, _doc string, _none boolean, _row int, _norm string")
    got = exact_dedup.exact_keep_first(docs, Scratch(spark))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
