"""Near copies by the Jaccard similarity of five-word shingles: candidates by ball hashing of SimHash
fingerprints, and by MinHash bands for pairs beyond its radius, verified on the sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from . import simhash

SHINGLE = 5
SEED = 42
#: A pair at the threshold of 4/5 is in no common bucket with probability (1 - 0.8 ** 5) ** 32, 3 in a
#: million; more similar ones with less.
BANDS, ROWS = 32, 5
BLOCK = 1024
#: Rows whose sets are made at once.
CHUNK = 256
#: Members of a bucket's block, and hashes that their sets hold together, about; two blocks are compared
#: in one task.
MEMBERS, HELD = 256, 1 << 18

_RNG = np.random.default_rng(SEED)
_PLACES = _RNG.integers(1 << 63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles.

    Words are those of ``simhash.fingerprint``; fewer than five words are one shingle, also none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    of = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    n = len(of) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for i, factor in enumerate(_PLACES):
        h += of[i : i + n] * factor
        h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h ^ (h >> np.uint64(32)))


def buckets(of: np.ndarray) -> list[int]:
    """The signed key of each band of a set's MinHash signature."""
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(of), BLOCK):
        np.minimum(least, (of[at : at + BLOCK, None] * _FACTORS).min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(bands)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _buckets(texts: pd.Series) -> pd.Series:
    return pd.Series([buckets(shingles(x)) for x in texts], dtype=object)


def _balls(prints: DataFrame, scratch: c.Scratch) -> DataFrame:
    """Pairs (a, b) of rows by operator 3's ball hashing: each row and the least one with its fingerprint,
    and the least rows of fingerprints that ``simhash.linked`` links. ``prints``: _row, _fp, a written table."""
    heads = scratch.keep(prints.groupBy("_fp").agg(F.min("_row").alias("_head")), "heads")
    same = c.join_split(prints, heads, ["_fp"]).where("_row <> _head").select(F.col("_row").alias("a"), F.col("_head").alias("b"))
    a, b = (heads.select(F.col("_fp").alias(x), F.col("_head").alias(f"_{x}")) for x in "ab")
    near = simhash.linked(heads.select("_fp")).join(a, "a").join(b, "b")
    return same.unionByName(near.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")))


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_row and _set, of few rows at once: a set is larger than its text."""
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            yield pd.DataFrame({"_row": part["_row"].to_numpy(), "_set": [shingles(x).view(np.int64) for x in part["_text"]]})


def similar(common: Column | np.ndarray, sizes: Column | np.ndarray):
    """Whether the Jaccard similarity is at least 4/5, in whole numbers; sizes: of both sets together."""
    return 9 * common >= 4 * sizes


def _starred(keys: DataFrame) -> DataFrame:
    """(a, b) of every member and the least one of its bucket."""
    heads = keys.groupBy("_key").agg(F.min("_row").alias("b"), F.count("*").alias("_n")).where("_n > 1")
    return c.join_split(keys, heads, ["_key"]).where("_row <> b").select(F.col("_row").alias("a"), "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sets of too different sizes can't be; only the others
    are fetched."""
    a, b = (sets.select(F.col("_row").alias(x), F.size("_set").alias(f"_n{x}")) for x in "ab")
    pairs = pairs.join(a, "a").join(b, "b").where(5 * F.least("_na", "_nb") >= 4 * F.greatest("_na", "_nb")).select("a", "b")
    a, b = (sets.select(F.col("_row").alias(x), F.col("_set").alias(f"_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return both.where(similar(F.size(F.array_intersect("_a", "_b")), F.size("_a") + F.size("_b"))).select("a", "b")


def _merges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges that join the labels of similar members; members of one label aren't compared. Those with the
    bucket's main label come last, so that the loop is over the others."""
    pdf = pdf.sort_values("_main", kind="stable")
    rows, label = pdf["_row"].to_numpy(), pdf["_label"].to_numpy().copy()
    sizes = np.array([len(x) for x in pdf["_set"]])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names, members = np.unique(np.concatenate(pdf["_set"].to_list()), return_inverse=True)
    has, out = np.zeros(len(names), bool), []
    for i in range(len(rows)):
        if not (label[i + 1 :] != label[i]).any():
            continue
        mine = members[starts[i] : starts[i] + sizes[i]]
        has[mine] = True
        common = np.add.reduceat(has[members], starts, dtype=np.int64)
        has[mine] = False
        for j in np.flatnonzero(similar(common, sizes + sizes[i])):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((rows[i], rows[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _left(keys: DataFrame, sets: DataFrame, roots: DataFrame, scratch: c.Scratch) -> DataFrame:
    """The members of the buckets of three or more that have several labels yet: _key, _row, _label, _main
    (whether it is the bucket's most frequent label), and the numbers of blocks _k of other members and
    _m of main ones. Of buckets with the same members one is left."""
    of_row = sets.select("_row", F.size("_set").alias("_size")).join(roots.withColumnRenamed("node", "_row"), "_row", "left")
    of_row = of_row.select("_row", "_size", F.coalesce("root", "_row").alias("_label"))
    labelled = scratch.keep(keys.join(of_row, "_row"), "labelled")
    marks = [F.bit_xor(F.xxhash64("_row", F.lit(i))) for i in range(2)]
    by_label = labelled.groupBy("_key", "_label").agg(F.count("*").alias("n"), F.sum("_size").alias("s"), *[m.alias(x) for m, x in zip(marks, "xy", strict=True)])
    of = by_label.groupBy("_key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("n", "_label", "s")).alias("top"), F.count("*").alias("labels"))
    of = of.where("labels > 1 and n > 2").groupBy("n", "x", "y").agg(F.min(F.struct("_key", "top", "s")).alias("of"))
    blocks = lambda n, held: F.greatest(F.ceil(n / MEMBERS), F.ceil(held / HELD)).cast("int")
    top = F.col("of.top")
    of = of.select(F.col("of._key").alias("_key"), top["_label"].alias("_top"), blocks(F.col("n") - top["n"], F.col("of.s") - top["s"]).alias("_k"), blocks(top["n"], top["s"]).alias("_m"))
    return c.join_split(labelled, of, ["_key"]).select("_key", "_row", "_label", (F.col("_label") == F.col("_top")).alias("_main"), "_k", "_m")


def _compared(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) of similar members of the buckets, which are compared block by block: blocks of
    other members with each other and with those of main ones. Main ones have one label already."""
    hash_ = F.xxhash64("_row")
    here = F.pmod(hash_, F.when(F.col("_main"), F.col("_m")).otherwise(F.col("_k"))).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = lambda p, q, main: F.struct(p.alias("p"), q.alias("q"), F.lit(main).alias("with_main"))
    of_main = F.transform(up_to("_k"), lambda i: block(i, F.col("_at"), True))
    of_other = F.concat(F.transform(up_to("_k"), lambda i: block(F.least(i, F.col("_at")), F.greatest(i, F.col("_at")), False)), F.transform(up_to("_m"), lambda i: block(F.col("_at"), i, True)))
    at = left.withColumn("_at", here).select("_key", "_row", "_label", "_main", F.explode(F.when(F.col("_main"), of_main).otherwise(of_other)).alias("_block"))
    return at.join(sets, "_row").groupBy("_key", "_block").applyInPandas(_merges, "a long, b long")


def near_components(rows: DataFrame, scratch: c.Scratch) -> DataFrame:
    """(node, root) of the rows that are similar to another one, root being the least row linked.

    ``rows``: _row, _text, a written table. What ball hashing links is compared, and every two rows of a
    bucket, first with the bucket's least row, then, where that leaves several components, with each other.
    """
    prints = scratch.keep(simhash.with_fingerprint(rows, "_text").select("_row", "_fp"), "fingerprints")
    keys = rows.select("_row", F.explode(_buckets(c.text_or_empty("_text"))).alias("_key"))
    keys = scratch.keep(keys, "buckets")
    pairs = scratch.keep(_starred(keys).unionByName(scratch.keep(_balls(prints, scratch), "balls")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("_row")).union(pairs.select(F.col("b").alias("_row"))).distinct()
    texts = c.matching(rows, scratch.keep(ends, "ends"), "_row", "left_semi").select("_row", c.text_or_empty("_text").alias("_text"))
    sets = scratch.keep(texts.mapInPandas(_sets, "_row long, _set array<long>"), "sets")
    edges = scratch.keep(_verified(pairs, sets), "verified")
    roots = c.components(edges, scratch)
    more = scratch.keep(_compared(_left(keys, sets, roots, scratch), sets), "merges")
    return roots if more.isEmpty() else c.components(edges.unionByName(more), scratch)


def near_keep_first(docs: DataFrame, scratch: c.Scratch, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of near copies left: the one with the smallest id (nulls
    last; of repeated ids, any one). Null and empty texts, and texts of fewer than five words, are
    similar to equal ones only. Repeated rows are near copies. All columns stay."""
    mark = len(scratch.tables)
    rows = c.numbered(docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id")), scratch)
    roots = near_components(rows.select("_row", F.col("_doc")[text].alias("_text")), scratch).withColumnRenamed("node", "_row")
    key = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    linked = scratch.keep(c.matching(rows.select("_row", key.alias("_key")), scratch.keep(roots, "roots"), "_row"), "linked")
    heads = linked.groupBy("root").agg(F.min("_key").alias("_head"))
    gone = scratch.keep(linked.select("_row").join(heads.select(F.col("_head.row").alias("_row")), "_row", "left_anti"), "gone")
    scratch.drop_since(mark, "numbered", "gone")
    return c.without(rows, gone, "_row").select("_doc.*")
