"""The corpus pipeline, stage by stage, on planted cases."""

import numpy as np

import corpus_pipeline as p
from slabline.llm import queries, simhash
from slabline.llm._common import Scratch


def planted(spark, at):
    rng = np.random.default_rng(4)
    words = [a + b + "o" for a in "bcdfglmnprst" for b in ("a", "e", "i", "ou", "ant")]
    texts = [" ".join(rng.choice(words, int(rng.integers(30, 200)))) for _ in range(300)]
    toxic = {i for i in range(300) if i % 5 == 3}
    texts = [t + " hideousword" if i in toxic else t for i, t in enumerate(texts)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i].replace(" ", "  "), "en", "s1", 1) for i in range(10) if i not in toxic]
    long_ = [" ".join(rng.choice(words, 900)) for _ in range(5)]
    rows += [(2000 + i, t, "en", "s2", 1) for i, t in enumerate(long_)] + [(2100 + i, t + " so", "en", None, 1) for i, t in enumerate(long_)]
    rows += [(3000, None, "en", "s0", 0), (3001, "", None, "s0", 0), (None, "tato tato", "en", "s0", 3), (3002, "same row", "en", "s3", 3), (3002, "same row", "en", "s3", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return rows, toxic


def test_stages(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows, toxic = planted(spark, at)
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, at)
        if i < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        seen[name] = [r.doc_id for r in docs.collect()]
    assert {name for name, _ in p.STAGES} == set(seen)
    clean = seen["toxicity"]
    assert sum(i in toxic for i in clean) == 0 and len(clean) >= len(rows) - len(toxic) - 2
    exact = seen["exact_dedup"]
    assert exact.count(3002) == 1 and not {i for i in range(10) if i not in toxic} & set(exact)
    assert len({3000, 3001} & set(exact)) == 1 and None in exact
    near = seen["near_dedup"]
    fps = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    assert len(near) <= len(exact) and all(2000 + i in near for i in range(5))
    close = [i for i in range(5) if (fps[2000 + i] ^ fps[2100 + i]).bit_count() <= 2]
    assert close and not any(2100 + i in near for i in close)
    assert set(seen["byte_bpe"]) == set(seen["mixing"]) <= set(near) and len(seen["byte_bpe"]) == len(seen["mixing"])
    assert max(np.unique([i or -1 for i in seen["mixing"]], return_counts=True)[1]) <= 3
    got = sorted(r.doc_id or -1 for r in p.run(spark, at).collect())
    assert got == sorted(i or -1 for i in seen["byte_bpe"])


def test_results_of_two_calls_live_together(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows, _ = planted(spark, at)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for stage in (p.drop_copies, p.drop_near_copies, p.mix_sources):
        first, second = stage(spark, docs, at), stage(spark, docs, at)
        assert second.count() == first.count() > 0


def test_every_query_runs(spark, data):
    for name, f in queries.QUERIES.items():
        df = f(spark, data)
        key = {"op1": "vec_id", "op7": "page_id"}.get(name.split("_")[0], "doc_id")
        table = {"vec_id": "embeddings", "page_id": "pages"}.get(key, "documents")
        assert df.columns[0] == key and df.count() == spark.read.parquet(f"{data}/{table}.parquet").count(), name
    assert Scratch(spark).tables == []
