"""Near-duplicates among embeddings: sign hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Least cosine of a link; share of links at exactly that cosine which the tables find.
THRESHOLD, RECALL = 0.95, 0.999
#: Distinct vectors of a bucket that are compared with as many others at once.
CHUNK = 512


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits per table, tables) for n distinct vectors.

    The bits grow with the logarithm of n, so that unrelated vectors rarely share a bucket; the number
    of tables is what ``recall`` then needs.
    """
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2))) + 7))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest component first, so that no square
    overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Per row and table, the signs against ``bits`` random hyperplanes as one integer."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _signed(bits: int, tables: int, seed: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vecs in batches:
            out: list = [None] * len(vecs)
            dims = vecs.map(len).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                got = signatures(unit(np.vstack(vecs.iloc[at].to_numpy())), bits, tables, seed)
                for i, row in zip(at, got, strict=True):
                    out[i] = row
            yield pd.Series(out, dtype=object)

    return signed


def local_components(linked: np.ndarray) -> np.ndarray:
    """The smallest index in each row's component of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def compare(cid: np.ndarray, weight: np.ndarray, side: np.ndarray, unit_: np.ndarray, sigs: np.ndarray, crossed: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per vector of one block: the weight of its links that no earlier table finds, and the smallest
    class in its component here. ``sigs``: of the earlier tables. ``crossed``: only pairs of different
    sides are meant."""
    linked = unit_ @ unit_.T >= threshold
    np.fill_diagonal(linked, False)
    if crossed:
        linked &= side[:, None] != side[None, :]
    a, b = np.nonzero(linked)
    links = np.zeros(len(cid), np.int64)
    for i in range(0, len(a), 1 << 16):
        p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        new = ~(sigs[p] == sigs[q]).any(axis=1)
        np.add.at(links, p[new], weight[q[new]])
    order = np.argsort(cid)
    label = local_components(linked[np.ix_(order, order)])
    least = np.empty_like(cid)
    least[order] = cid[order][label]
    return links, least


def _compared(threshold: float):
    """What a task does with rows of blocks: t, crossed, members. Most blocks are two unrelated vectors,
    so those are compared all at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, crossed, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            all_ = lists.flatten()
            cid, w, side = (all_.field(k).to_numpy(zero_copy_only=False) for k in ("cid", "w", "side"))
            vec, sig = all_.field("vec"), all_.field("sigs")
            at, flat = vec.offsets.to_numpy() - vec.offsets[0].as_py(), vec.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(starts)
            todo = size > 2
            dims = np.diff(at)[starts[:-1]]
            for dim in np.unique(dims[size == 2]):
                pairs = np.flatnonzero((size == 2) & (dims == dim))
                a, b = (unit(flat[at[starts[pairs] + k][:, None] + np.arange(dim)]) for k in (0, 1))
                # with room for rounding, as close ones are decided below like all others
                todo[pairs[(a * b).sum(axis=1) >= threshold - 1e-9]] = True
            out = []
            for i in np.flatnonzero(todo):
                here = slice(starts[i], starts[i + 1])
                n, t = size[i], table[i]
                vecs = flat[at[starts[i]] : at[starts[i + 1]]].reshape(n, -1)
                sigs = sig.slice(starts[i], n).flatten().to_numpy(zero_copy_only=False).reshape(n, t)
                links, least = compare(cid[here], w[here], side[here], unit(vecs), sigs, bool(crossed[i]), threshold)
                some = (links > 0) | (least != cid[here])
                if some.any():
                    out.append((cid[here][some], links[some], least[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["cid", "links", "least"])

    return run


def vector_classes(rows: DataFrame, scratch: c.Scratch, id_col: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """One row per row: id, n_links, component_id, kept.

    Rows link whose vectors, of the same length, have a cosine of ``threshold`` or more in double
    precision; pairs are found by equal signs in one of several tables of random hyperplanes. n_links:
    other rows linked directly. component_id: the smallest id reachable, itself included; null ids
    take part, but are no smallest. kept: the id is its component's. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing. Repeated rows are rows of their own.

    Equal vectors are one class. The classes of a bucket are compared in blocks of bounded size, and a
    block returns sums and labels, not pairs; a pair counts in the first table that has it only. Of
    buckets with the same members, told by their number and 128 bits, the first table's is compared.
    """
    big = F.lit(float("inf"))
    # floats stay floats until they are compared: half the bytes to shuffle
    kind = rows.schema[vec].dataType
    as_is = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = rows.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<float>" if as_is else "array<double>").alias("_vec"))
    fine = F.coalesce(F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("_vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_vec", F.when(fine, F.col("_vec")))
    classes = c.numbered(rows.where("_vec is not null").groupBy("_vec").agg(F.count("*").alias("w"), F.min("_id").alias("least_id")), scratch, "cid")
    bits, tables = tables_for(classes.count(), threshold, recall)
    signed = scratch.keep(classes.select("cid", "w", F.col("_vec").alias("vec"), _signed(bits, tables, seed)("_vec").cast("array<int>" if bits < 32 else "array<bigint>").alias("sigs")), "signed")
    # Only numbers are shuffled to find the buckets with company; vectors go to those alone.
    # a bucket: table and signs as one long, of which the table is the remainder
    spots = signed.select("cid", F.size("vec").alias("dim"), F.posexplode("sigs").alias("t", "sig"))
    spots = spots.select("cid", "dim", (F.col("sig").cast("long") * tables + F.col("t")).alias("bucket"))
    full = spots.groupBy("dim", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    spots = scratch.keep(c.join_split(spots, full, ["dim", "bucket"]), "spots")
    marks = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(x) for i, x in enumerate("xy")]
    first = spots.groupBy("dim", "bucket", "n").agg(*marks).groupBy("dim", "n", "x", "y").agg(F.min_by("bucket", F.pmod("bucket", F.lit(tables))).alias("bucket"))
    t = F.pmod("bucket", F.lit(tables)).cast("int").alias("t")
    spots = c.join_split(spots.drop("n"), first.select("dim", "bucket", "n"), ["dim", "bucket"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    spots = spots.withColumn("chunk", F.pmod(F.xxhash64("cid"), "chunks").cast("int"))
    # Chunk pairs: every chunk meets every other one and itself.
    spots = spots.select("cid", "dim", "bucket", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    spots = spots.select("cid", "dim", "bucket", t, F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), (F.col("chunk") > F.col("other")).alias("side"))
    member = F.struct("cid", "w", "side", "vec", F.slice("sigs", 1, F.col("t")).alias("sigs"))
    blocks = spots.join(signed, "cid").groupBy("dim", "bucket", "t", "lo", "hi").agg(F.collect_list(member).alias("members"))
    blocks = blocks.where(F.size("members") > 1).select("t", (F.col("lo") != F.col("hi")).alias("crossed"), "members")
    found = scratch.keep(blocks.mapInArrow(_compared(threshold), "cid long, links long, least long"), "found")
    roots = c.components(found.select(F.col("cid").alias("a"), F.col("least").alias("b")), scratch).withColumnRenamed("node", "cid")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    at = classes.join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    heads = at.groupBy("root").agg(F.min("least_id").alias("component"))
    at = at.join(heads, "root").select("_vec", "component", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"))
    # rows without a vector match nothing: their second key deals them out by id
    zero = F.lit(0).cast("long")
    out = rows.withColumn("_spread", F.when(F.col("_vec").isNull(), F.xxhash64("_id")).otherwise(zero)).join(at.withColumn("_spread", zero), ["_vec", "_spread"], "left")
    out = out.withColumn("component", F.when(F.col("_vec").isNull(), F.col("_id")).otherwise(F.col("component")))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("_id").eqNullSafe(F.col("component")).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of every row of embeddings."""
    return vector_classes(c.read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding"), c.Scratch(spark))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), n AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n AS a JOIN n AS b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.95 * a.size * b.size
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), k AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT c.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN k ON k.vec_id = c.vec_id
"""
