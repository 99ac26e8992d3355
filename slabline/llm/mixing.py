"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

#: Repeating weights of the sources in code point order, and how often a document may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Units that one flight moves.
BLOCK = 4096
#: Units that are kept for the landing of a source, besides the two that its last flight leaves.
LAND = 14
EPS = 1e-9


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves inclusion probabilities through the null space of the totals until they are 0 or 1.

    Three units at a time move along the one direction that changes neither their count nor their
    total of x; which way is drawn so that each probability keeps its mean. At most two units, the
    last ones in order, stay between 0 and 1.
    """
    p = p.tolist()
    x = x.tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    active = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    queue, active = active[3:][::-1], active[:3]
    while len(active) == 3 or (len(active) == 2 and x[active[0]] == x[active[1]]):
        xs = [x[i] for i in active]
        if len(active) == 2:
            u = [1.0, -1.0]
        elif xs[0] == xs[1] == xs[2]:
            u = [1.0, -1.0, 0.0]
        else:
            u = [xs[1] - xs[2], xs[2] - xs[0], xs[0] - xs[1]]
            top = max(map(abs, u))
            u = [v / top for v in u]
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(active, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(active, u, strict=True) if v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(active, u, strict=True):
            p[i] += step * v
        for i in active:
            if p[i] <= EPS or p[i] >= 1 - EPS:
                p[i] = float(round(p[i]))
        active = [i for i in active if 0 < p[i] < 1]
        while queue and len(active) < 3:
            active.append(queue.pop())
    return np.array(p)


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rounds the few probabilities still between 0 and 1 so that the totals change least; a document
    too many or too few weighs as much as a hundredth of the mean of x."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = choices - p[open_]
    out[open_] = choices[np.argmin(np.abs(off @ x[open_]) + np.abs(off.sum(axis=1)) * x.mean() / 100)]
    return out


def landed(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A source's last block: units of all sizes, at most LAND of them, are kept out of the flight and form
    the landing problem together with the two that the flight leaves open."""
    held = np.unique(np.geomspace(2, max(len(p), 3), LAND).round().astype(int)) - 1
    held = held[held < len(p)]
    flown = np.setdiff1d(np.arange(len(p)), held)
    out = p.copy()
    out[flown] = flight(p[flown], x[flown], rng)
    return landing(out, x)


def targets(sizes: DataFrame, scratch: c.Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A written table (source, rank, source_size, target), one row per source.

    ``sizes``: source, source_size. A target is weight times a common level, at most ``most`` times
    the source's size; the level is raised for the others until the targets add up to all sizes. Each
    step is one aggregation; a source that is full stays full, so there are few.
    """
    # sorted by ranges, numbered inside each, and the ranges' counts added up: no task sees all sources
    part, here = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = scratch.keep(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))  # one row per range
    sizes = ordered.withColumn("_part", part).join(F.broadcast(parts), "_part").withColumn("_rank", here + F.col("_before")).drop("_id", "_part", "_before")
    rank = F.col("_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("rank", rank).drop("_rank").withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    rows = scratch.keep(rows, "sources")
    level, full_before = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > F.col("cap")
        total, full_size, room, n_full = rows.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if n_full == full_before or not room:
            break
        level, full_before = ((total or 0) - (full_size or 0)) / room, n_full
    return rows.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _mover(seed: int, level: int):
    """What a block's flight does to a pandas frame."""

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "key", "nth"], ascending=[False, True, True], kind="mergesort")
        first = pdf.iloc[0]
        rng = np.random.default_rng([seed, level, int(first["rank"]), int(first["block"])])
        move_on = landed if first["blocks"] == 1 else flight
        p = move_on(pdf["p"].to_numpy(float), pdf["x"].to_numpy(float), rng)
        return pdf[["_row", "rank", "x", "key", "nth"]].assign(p=p)

    return move


def _counted(units: DataFrame) -> DataFrame:
    """units with nth, the place of a row among those of its key, which are equal rows.

    Rows are counted within their part of the table first (the high bits of the row number), so that a
    key with very many rows is no one task's work.
    """
    part = F.shiftright("_row", 33)
    if units.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return units.withColumn("nth", F.lit(1))
    units = units.withColumn("_part", part)
    before = F.sum("n").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = units.groupBy("key", "_part").agg(F.count("*").alias("n")).select("key", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("key", "_part").orderBy("_row"))
    return c.join_split(units.withColumn("_here", here), parts, ["key", "_part"]).withColumn("nth", F.col("_here") + F.col("_before")).drop("_part", "_here", "_before")


def _flights(units: DataFrame, scratch: c.Scratch, seed: int) -> DataFrame:
    """(_row, p) with p 0 or 1 for units (_row, rank, x, key, nth, p) with p in between.

    Flights run in blocks of about BLOCK units of one source; the at most two open units of each block
    go on to the next round, whose blocks hold those of BLOCK / 2 blocks. A source that fits in one
    block is landed. Totals stay the same until then. The order in a block is from large to small, so
    that small units are left to the landing.
    """
    done, level = None, 0
    while True:
        blocks = units.groupBy("rank").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        dealt = c.join_split(units, blocks, ["rank"]).withColumn("block", F.pmod(F.xxhash64("key", "nth", F.lit(level)), "blocks"))
        moved = dealt.groupBy("rank", "block").applyInPandas(_mover(seed, level), "_row long, rank int, x long, key long, nth long, p double")
        moved = scratch.keep(moved, "moved")
        settled = moved.where("p = 0 or p = 1").select("_row", "p")
        done = settled if done is None else done.unionByName(settled)
        units, level = moved.where("p > 0 and p < 1"), level + 1
        if units.isEmpty():
            return done


def mixed(docs: DataFrame, scratch: c.Scratch, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7, carry: bool = False) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, copies, taken, and with ``carry`` the
    row as the struct ``doc``.

    size: words between ASCII white space, null texts have none. A source (null is one, the last) gets
    copies of its documents: the whole part of target / source_size for each, and one more for a
    sample that is balanced on the numbers of documents and of words. A document is never taken more
    than ``most`` times. The draws depend on ids and texts only, so reruns agree however the rows are
    partitioned. Null ids and repeated rows are documents like any others.
    """
    mark, row = len(scratch.tables), {"_doc": F.struct("*")} if carry else {}
    rows = c.numbered(docs.select(F.col(id_col).alias("_id"), F.col(source).cast("string").alias("source"), c.word_count(text).alias("size"), F.xxhash64(id_col, text).alias("key"), *[x.alias(k) for k, x in row.items()]), scratch)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, most)
    # try_divide: a source without words has no factor, and its documents are taken as they are
    factor = F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(1.0)), F.lit(float(most)))
    sources = sources.withColumn("factor", factor).withColumnRenamed("source", "_source")
    sized = rows.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    whole, part = F.floor(F.col("factor") + EPS), F.col("factor") - F.floor(F.col("factor") + EPS)
    units = sized.where(part > EPS).select("_row", F.col("rank").cast("int").alias("rank"), F.col("size").alias("x"), "key", part.alias("p"))
    ones = scratch.keep(_flights(_counted(units), scratch, seed).where("p = 1").select("_row", F.lit(1).alias("_one")), "ones")
    scratch.drop_since(mark, "numbered", "sources", "ones")
    copies = (whole + F.coalesce("_one", F.lit(0))).cast("long")
    return c.matching(sized, ones, "_row", "left").select(
        F.col("_id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(k).alias(k[1:]) for k in row]
    )


def mixture(docs: DataFrame, scratch: c.Scratch, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken."""
    found = mixed(docs, scratch, carry=True, **options).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every row of documents."""
    docs = c.read_columns(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixed(docs, c.Scratch(spark)).select("doc_id", "size", "source_size", "target", "taken")
