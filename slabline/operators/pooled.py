"""Exact percentiles over all rows of a table or of a few keys, without all values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values: so many, each of as many narrower ones.
WIDE = 32


def percentiles(df: DataFrame, value: str, quantiles: list[float]) -> list[float] | None:
    """Interpolated percentiles like ``F.percentile``; None without values.

    Values are counted, then the counts per value range give the range of each rank, and only these
    ranges are sorted. Borders come from a sketch of the distinct values, so a range has about a
    thousandth of them. The driver gets the borders, the ranges' sums and two values per quantile.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")).persist()
    try:
        borders = counts.agg(F.percentile_approx("_v", [i / WIDE**2 for i in range(1, WIDE**2)], 20_000)).first()[0]
        if not borders:
            return None
        borders = [-math.inf, *borders]
        tops = F.array(*map(F.lit, borders[WIDE::WIDE]))
        parts = F.array(*[F.array(*map(F.lit, borders[i + 1 : i + WIDE])) for i in range(0, len(borders), WIDE)])
        below = lambda array: F.size(F.filter(array, lambda b: b < F.col("_v")))
        ranged = counts.withColumn("_wide", below(tops)).withColumn("_range", F.col("_wide") * WIDE + below(F.get(parts, F.col("_wide"))))
        upto, first = 0, []
        for r in sorted(ranged.groupBy("_range").agg(F.sum("_n").alias("n")).collect()):
            first.append((r["_range"], upto))
            upto += r["n"]
        at = [(upto - 1) * q for q in quantiles]
        ranks = sorted({f(x) for x in at for f in (math.floor, math.ceil)})
        wanted = [(*max((s, k) for k, s in first if s <= rank)[::-1], rank) for rank in ranks]
        found = df.sparkSession.createDataFrame(wanted, "_range int, _start long, _rank long")
        inside = ranged.where(F.col("_range").isin(sorted({k for k, _, _ in wanted})))
        inside = inside.withColumn("_to", F.sum("_n").over(Window.partitionBy("_range").orderBy("_v")))
        offset = F.col("_rank") - F.col("_start")
        hit = inside.join(F.broadcast(found), "_range").where((offset < F.col("_to")) & (offset >= F.col("_to") - F.col("_n")))  # two rows per quantile
        of = {r["_rank"]: r["_v"] for r in hit.select("_rank", "_v").collect()}
    finally:
        counts.unpersist()
    return [of[lo] if (lo := math.floor(x)) == (hi := math.ceil(x)) else (hi - x) * of[lo] + (x - lo) * of[hi] for x in at]


def at_ranks(rows: DataFrame, key: str, ranks: DataFrame, ranges: int = 64) -> DataFrame:
    """``ranks`` (key, _rank from 0, ...) with _v, the value of that rank among the key's sorted values.

    ``rows``: key, _v. Values are counted; a sketch cuts each key's into ranges, whose counts tell the
    range of each rank; only those ranges are sorted, each by itself. A key may have most of the rows.
    """
    counts = rows.groupBy(key, "_v").agg(F.count("*").alias("_n"))
    borders = counts.groupBy(key).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 2_000).alias("_borders"))
    inside = F.size(F.filter("_borders", lambda b: b < F.col("_v")))
    # one more key, so that a key with most of the values can be split in the join
    spread = F.hash(key)
    ranged = counts.withColumn("_spread", spread).join(borders.withColumn("_spread", spread), [key, "_spread"]).select(key, "_v", "_n", inside.alias("_range"))
    sums = ranged.groupBy(key, "_range").agg(F.sum("_n").alias("_s"))
    upto = sums.withColumn("_to", F.sum("_s").over(Window.partitionBy(key).orderBy("_range")))  # one row per range
    wanted = ranks.join(upto, key).where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_s"))).withColumn("_offset", F.col("_rank") - (F.col("_to") - F.col("_s")))
    wanted = wanted.drop("_to", "_s")
    held = ranged.join(wanted.select(key, "_range").distinct(), [key, "_range"], "left_semi")
    held = held.withColumn("_to", F.sum("_n").over(Window.partitionBy(key, "_range").orderBy("_v")))
    hit = wanted.join(held, [key, "_range"]).where((F.col("_offset") < F.col("_to")) & (F.col("_offset") >= F.col("_to") - F.col("_n")))
    return hit.drop("_range", "_offset", "_to", "_n")


def keyed_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """_key (a struct of keys) and a column per quantile: interpolated percentiles like ``F.percentile`` of
    each key's values, null ones left out; keys without values are absent. A key may have most of the rows."""
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_v"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in quantiles.items()])).alias("_of")
    at = rows.groupBy("_key").agg(F.count("*").alias("_n")).select("_key", "_n", each).select("_key", F.col("_of.name").alias("_name"), ((F.col("_n") - 1) * F.col("_of.q")).alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    hit = at_ranks(rows, "_key", at.withColumn("_rank", F.explode(F.array_distinct(F.array(low, high)))))
    share = F.when(low == high, 1.0).when(F.col("_rank") == low, high - F.col("_at")).otherwise(F.col("_at") - low)
    return hit.groupBy("_key").agg(*[F.sum(F.when(F.col("_name") == k, F.col("_v") * share)).alias(k) for k in quantiles])
