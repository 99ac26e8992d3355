"""Calibration of cutoffs and validation against reference cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from . import blocks, pooled


def split_by_truth(cells: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Cells with kind ice or firn by a truth mask."""
    return cells.join(truth, on).withColumn("kind", F.when(F.col("truth"), "ice").otherwise("firn")).drop("truth")


def cutoffs(cells: DataFrame, quantiles: list[float], value: str = "value") -> DataFrame:
    """(quantile, cutoff): exact quantiles of the ice values."""
    found = pooled.percentiles(cells.where("kind = 'ice'"), value, quantiles) or []
    return cells.sparkSession.createDataFrame([(float(q), p) for q, p in zip(quantiles, found, strict=False)], "quantile double, cutoff double")


def histogram(df: DataFrame, low: float, high: float, bins: int, value: str = "value", key: str = "kind") -> DataFrame:
    """(key, bin, n, density) with bins from 0; the upper end belongs to the last one. Values outside
    are left out; the densities of a key integrate to 1."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")
    counts = df.where(F.col(value).between(low, high)).groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))
    all_ = F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("density", F.col("n") / (all_ * F.lit((high - low) / bins)))


def confusion(df: DataFrame, key: str = "quantile") -> DataFrame:
    """Counts and accuracies per key of the boolean columns predicted and truth; accuracies are null
    where only one class is predicted."""
    p, t = F.col("predicted"), F.col("truth")
    c = df.groupBy(key).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    both = (F.col("tp") + F.col("fp") > 0) & (F.col("fn") + F.col("tn") > 0)
    rate = lambda a, b: F.when(both, F.try_divide(a, b))
    return c.withColumns({"overall": rate(F.col("tp") + F.col("tn"), F.expr("tp + fp + fn + tn")), "producers": rate(F.col("tp"), F.col("tp") + F.col("fn")), "users": rate(F.col("tp"), F.col("tp") + F.col("fp"))})


def resampled(fine: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, j, fraction, n): share of true fine cells in each coarse cell.

    ``columns``: j and east, ``rows``: i and depth; the axes of one profile, numbered from 0.
    Column j reaches from the position before it to its own, the first from an edge derived from
    midpoints. A row reaches down to the next one.
    """
    w = Window.orderBy("j")  # one profile's axis
    c = columns.withColumns({"_next": F.lead("east").over(w), "_next2": F.lead("east", 2).over(w), "_prev": F.lag("east").over(w)})
    first = (F.col("east") + F.col("_next")) / 2
    second = (F.col("_next") + F.col("_next2")) / 2
    c = c.withColumns({"_lo": F.when(F.col("j") == 0, 2 * first - second).otherwise(F.col("_prev")), "_hi": F.col("east")})
    v = Window.orderBy("i")
    r = rows.withColumns({"_n": F.lead("depth").over(v), "_p": F.lag("depth").over(v)})
    r = r.withColumn("_n", F.coalesce("_n", 2 * F.col("depth") - F.col("_p")))
    at = fine.join(F.broadcast(c.select("j", "_lo", "_hi")), (F.col("fx") >= F.col("_lo")) & (F.col("fx") < F.col("_hi")))  # a profile's axis
    at = at.join(F.broadcast(r.select("i", F.col("depth").alias("_top"), F.col("_n").alias("_bottom"))), (F.col("fz") >= F.col("_top")) & (F.col("fz") < F.col("_bottom")))
    return at.groupBy("i", "j").agg(F.avg(F.col("truth").cast("double")).alias("fraction"), F.count("*").alias("n"))


def error_grid(images: DataFrame, truth: DataFrame, algorithms: list[str], thresholds: list[int]) -> DataFrame:
    """(algorithm, quantile, threshold, type_1, type_2): shares of all cells that are false positives
    and false negatives.

    ``images``: track, quantile, col, ice; ``truth``: track, col, reference (array of booleans). Each
    image is cleaned and labelled once per algorithm, block by block. A threshold only filters component
    sizes, so errors follow from the components' counts of true and of all cells.
    """
    size = lambda c: F.size(F.filter(c, lambda x: x))
    both = images.join(truth, ["track", "col"])

    def cleaned(pdf: pd.DataFrame) -> list[tuple[str, float, np.ndarray, np.ndarray]]:
        image, ref = blocks.matrix(pdf, "ice"), blocks.matrix(pdf, "reference")
        return [(name, float(pdf["quantile"].iloc[0]), kernels.cleaned(image, name), ref) for name in algorithms]

    parts = blocks.with_roots(blocks.labelled(both, cleaned, by=("quantile",)))
    whole = parts.groupBy(*blocks.KEYS, "root").agg(F.sum("size").alias("size"), F.sum("true").alias("true"))
    # a component counts under the largest threshold that it reaches; smaller ones have the sums from there
    reached = F.array_max(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("size") >= t)).alias("threshold")
    kept = whole.select(F.col("name").alias("algorithm"), "quantile", "size", "true", reached).where("threshold is not null")
    kept = kept.groupBy("algorithm", "quantile", "threshold").agg(F.sum(F.col("size") - F.col("true")).alias("_fp"), F.sum("true").alias("_tp"))
    cells = both.groupBy("quantile").agg(F.sum(F.size("reference")).alias("cells"), F.sum(size("reference")).alias("all_true"))
    every = cells.withColumn("algorithm", F.explode(F.array(*[F.lit(x) for x in algorithms]))).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in sorted(set(thresholds))])))
    larger = Window.partitionBy("algorithm", "quantile").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    g = every.join(kept, ["algorithm", "quantile", "threshold"], "left").withColumns({"fp": F.sum(F.coalesce("_fp", F.lit(0.0))).over(larger), "tp": F.sum(F.coalesce("_tp", F.lit(0.0))).over(larger)})
    return g.select("algorithm", "quantile", "threshold", (F.col("fp") / F.col("cells")).alias("type_1"), ((F.col("all_true") - F.col("tp")) / F.col("cells")).alias("type_2"))


def fractional_errors(cells: DataFrame, key: str = "quantile") -> DataFrame:
    """Errors against fractions: 1 - mean fraction where predicted, mean fraction elsewhere, 0 without
    such cells. ``cells``: key, predicted, fraction."""
    p = F.col("predicted")
    return cells.groupBy(key).agg(F.coalesce(1 - F.avg(F.when(p, F.col("fraction"))), F.lit(0.0)).alias("type_1"), F.coalesce(F.avg(F.when(~p, F.col("fraction"))), F.lit(0.0)).alias("type_2"))


def best_settings(grid: DataFrame) -> DataFrame:
    """Per algorithm the quantile and threshold with the least sum of errors (ties: the smallest
    quantile, then threshold), and the range of both errors."""
    total = F.col("type_1") + F.col("type_2")
    pick = F.min(F.struct(F.round(total, 12).alias("total"), "quantile", "threshold")).alias("m")
    g = grid.groupBy("algorithm").agg(pick, F.min("type_1").alias("min_type_1"), F.max("type_1").alias("max_type_1"), F.min("type_2").alias("min_type_2"), F.max("type_2").alias("max_type_2"))
    return g.select("algorithm", "m.total", "m.quantile", "m.threshold", "min_type_1", "max_type_1", "min_type_2", "max_type_2")
