"""Tracks in blocks of neighbouring columns, so that no task holds a whole track, and components across them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels

#: Columns of a block, and columns on both sides that cleaning may look at: a step looks one further.
BLOCK, HALO = 4096, max(sum(n for _, n in steps) for steps in kernels.VARIANTS.values())
#: What identifies an image: its track, how it was cleaned, and its cutoff.
KEYS = ["track", "name", "quantile"]
_PARTS = "track string, name string, quantile double, _block long, node long, size long, true double, border long, depth int, right boolean"


def _shared(df: DataFrame) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), set for checkpoints."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="slabline-"))
    return sc.getCheckpointDir()


def held(df: DataFrame) -> DataFrame:
    """df computed once, written in the shared folder and read again.

    A checkpoint would keep the planner's guess of its size. That of a join is the product of both
    sides, so in a loop its digits double each round, or worse, until planning takes minutes; a
    written table has the size of its files.
    """
    spark, at = df.sparkSession, f"{_shared(df)}/held-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def held_apart(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder in the partitions that it has. Not for loops (see held)."""
    _shared(df)
    return df.checkpoint()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by keys over as many partitions as shuffles have. Groups of few bytes can be much
    work; adaptive execution, which goes by bytes, would put them all into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(traces: DataFrame, name: str = "col") -> DataFrame:
    """Numbers a track's traces from 0 without gaps, in their order. Stretches of trace numbers are
    counted first, so that a long track is not one task's work."""
    stretch = F.floor(F.col("trace") / BLOCK)
    counts = traces.groupBy("track", stretch.alias("_stretch")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("track").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("track", "_stretch", F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("track", "_stretch").orderBy("trace"))
    rows = traces.withColumn("_stretch", stretch).join(counts, ["track", "_stretch"])
    return rows.withColumn(name, (here - 1 + F.col("_before")).cast("long")).drop("_stretch", "_before")


def dealt(rows: DataFrame, block: int | None = None, halo: int | None = None) -> DataFrame:
    """Rows (track, col, ...) with _block and _inner; those near a border also go to the block beside it,
    with _inner false. ``col`` counts from 0 without gaps."""
    block, halo = block or BLOCK, HALO if halo is None else halo
    at, off = F.floor(F.col("col") / block), F.col("col") % block
    of = lambda b, inner: F.struct(b.cast("long").alias("b"), F.lit(inner).alias("inner"))
    each = F.array(of(at, True), F.when((off < halo) & (at > 0), of(at - 1, False)), F.when(off >= block - halo, of(at + 1, False)))
    return rows.withColumn("_of", F.explode(F.array_compact(each))).withColumns({"_block": F.col("_of.b"), "_inner": F.col("_of.inner")}).drop("_of")


def matrix(pdf: pd.DataFrame, column: str, kind: type = bool) -> np.ndarray:
    """A column of arrays as a depth x trace matrix."""
    return np.array([np.asarray(x, kind) for x in pdf[column]]).T


def nodes_of(image: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of an image's components, and each label's node and size. A node is the smallest number
    col * depths + depth of a component's cells in a block; it tells it from all others of its image."""
    labels, sizes = kernels.label4(image)
    depth, at = np.nonzero(labels)
    node = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(node, labels[depth, at], cols[at].astype(np.int64) * image.shape[0] + depth)
    return labels, node, sizes


def parts(image: np.ndarray, cols: np.ndarray, block: int, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """What one block of ``block`` columns tells of its image: a row per component with its size and weight, and a row per
    cell in a column at the block's border."""
    labels, node, sizes = nodes_of(image, cols)
    true = np.zeros(len(sizes)) if weight is None else np.bincount(labels.ravel(), weights=weight.ravel(), minlength=len(sizes))
    n = len(sizes) - 1
    border = [np.full(n, -1)]
    depth, right, named = [np.full(n, -1)], [np.zeros(n, bool)], [node[1:]]
    for column, side in ((0, False), (len(cols) - 1, True)):
        b = int(cols[column]) + side
        if b % block == 0 and b > 0:
            cells = np.flatnonzero(labels[:, column])
            border.append(np.full(len(cells), b // block))
            depth.append(cells)
            right.append(np.full(len(cells), side))
            named.append(node[labels[cells, column]])
    border, depth, right, named = map(np.concatenate, (border, depth, right, named))
    pad = lambda x: np.concatenate([x, np.zeros(len(border) - n, x.dtype)])
    return {"node": named, "size": pad(sizes[1:]), "true": pad(true[1:]), "border": border, "depth": depth, "right": right}


def labelled(rows: DataFrame, images: Callable[[pd.DataFrame], list[tuple[str, float, np.ndarray, np.ndarray | None]]], by: tuple[str, ...] = ()) -> DataFrame:
    """The parts of all blocks, kept. ``rows``: track, col and what ``images`` needs to make the
    (name, quantile, image, weight) of a block with its halo; ``by``: further columns that blocks
    are told apart by."""

    block = BLOCK

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        inner = pdf["_inner"].to_numpy()
        out = []
        if inner.any():
            cols = pdf["col"].to_numpy()[inner]
            for name, quantile, image, weight in images(pdf):
                of = parts(image[:, inner], cols, block, None if weight is None else weight[:, inner])
                out.append(pd.DataFrame({"track": pdf["track"].iloc[0], "name": name, "quantile": quantile, "_block": pdf["_block"].iloc[0], **of}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in _PARTS.split(", ")])

    return held(spread(dealt(rows), "track", *by, "_block").groupBy("track", *by, "_block").applyInPandas(run, _PARTS))


def roots(found: DataFrame) -> DataFrame | None:
    """(track, name, quantile, node, root) of the components that go across a border; root is the least
    node. None without any. Labels fall to the least one around until nothing changes: alternating
    stars, in a logarithmic number of rounds; there are edges at borders only."""
    cells = found.where("border >= 0")
    left, right = cells.where("right").select(*KEYS, "border", "depth", F.col("node").alias("a")), cells.where("not right").select(*KEYS, "border", "depth", F.col("node").alias("b"))
    edges = left.join(right, [*KEYS, "border", "depth"]).select(*KEYS, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = held(edges), None
    if edges.isEmpty():
        return None
    while True:
        both = edges.unionByName(edges.select(*KEYS, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*KEYS, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, [*KEYS, "a"]).select(*KEYS, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(*KEYS, "a").agg(F.min("b").alias("m"))
        down = large.join(least, [*KEYS, "a"]).where("b <> m").select(*KEYS, F.col("b").alias("a"), F.col("m").alias("b"))
        edges = held(down.unionByName(least.select(*KEYS, "a", F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64(*KEYS, "a", "b"))).first())
        if now == mark:
            break
        mark = now
    tops = edges.select(*KEYS, F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(*KEYS, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops)


def with_roots(found: DataFrame) -> DataFrame:
    """The components of all blocks (track, name, quantile, _block, node, size, true) with root."""
    own = found.where("border < 0").drop("border", "depth", "right")
    of = roots(found)
    if of is None:
        return own.withColumn("root", F.col("node"))
    return own.join(of, [*KEYS, "node"], "left").withColumn("root", F.coalesce("root", "node"))
