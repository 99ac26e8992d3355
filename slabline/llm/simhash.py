"""Near-duplicates by SimHash, joined by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, as a signed integer.

    Words stand between ASCII white space after A-Z are lower-cased; the features are the XXH64 of
    all 3-word shingles, repeats included (fewer words: the whole sequence). A bit is set if it is
    set in over half of them. Null and texts without words have 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(SHINGLE)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones, total = np.zeros(64, np.int64), 0
    while len(block := np.fromiter(islice(hashes, BLOCK), np.uint64)):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "_fp") -> DataFrame:
    """docs with one more column, the signed fingerprint."""
    return docs.withColumn(name, _fingerprints(c.text_or_empty(text)))


def _masks(radius: int) -> list[int]:
    """Signed masks of all sets of at most radius bits."""
    of = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in of]


def linked(fingerprints: DataFrame, radius: int = RADIUS, fp: str = "_fp") -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints within ``radius`` bits of each other.

    Every fingerprint emits all variants within half the radius; two that are within the radius meet
    in a variant. Any two that share one are within the radius, so a chain through each variant's
    fingerprints keeps the components, without their pairs. A variant has at most as many
    fingerprints as there are masks. Colliding pairs are deduplicated and verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    # dealt by number: adaptive execution would size the tasks by what they read, not by what they emit
    tasks = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted = fingerprints.repartition(tasks, fp).select(fp, F.explode(F.array(*[F.col(fp).bitwiseXOR(F.lit(m)) for m in _masks(radius // 2)])).alias("_variant"))
    return c.chained(emitted, "_variant", fp).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def fingerprint_components(rows: DataFrame, scratch: c.Scratch, least: str, radius: int = RADIUS, fp: str = "_fp") -> DataFrame:
    """(fp, component): the least value of column ``least`` in the component of each distinct fingerprint.

    ``rows`` has to be a written table: it is read twice.
    """
    distinct = rows.groupBy(fp).agg(F.min(least).alias("_least"))
    roots = c.components(linked(distinct.select(fp), radius, fp), scratch)
    at = distinct.join(roots.withColumnRenamed("node", fp), fp, "left").withColumn("_root", F.coalesce("root", fp))
    heads = at.groupBy("_root").agg(F.min("_least").alias("component"))
    return c.join_split(at, heads, ["_root"]).select(fp, "component")


def simhash_classes(docs: DataFrame, scratch: c.Scratch, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest id reachable by links between fingerprints of at most ``radius``
    differing bits. Null ids take part but are never smallest, unless a component has no other: then
    component_id is null. Repeated rows give repeated result rows. Other columns are ignored.
    """
    rows = scratch.keep(with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text").select("_id", "_fp"), "fingerprints")
    found = fingerprint_components(rows, scratch, "_id", radius)
    return rows.join(found, "_fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def simhash_keep_first(docs: DataFrame, scratch: c.Scratch, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component left: the one with the smallest id (nulls last; of repeated
    ids, any one)."""
    rows = c.numbered(docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), _fingerprints(c.text_or_empty(text)).alias("_fp")), scratch)
    key = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    found = fingerprint_components(rows.select("_fp", key.alias("_key")), scratch, "_key", radius)
    at = rows.select("_row", "_fp").join(found.select("_fp", F.col("component.row").alias("_head")), "_fp")
    return c.without(rows, scratch.keep(at.where("_row <> _head").select("_row"), "gone"), "_row").select("_doc.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of documents, links at 2 or fewer bits."""
    return simhash_classes(c.read_columns(spark, sf_dir, "documents", "doc_id", "text"), c.Scratch(spark))
