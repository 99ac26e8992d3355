"""From corrected traces to ice likelihood, content and thickness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import blocks
from . import traces as tr

#: Smallest component, depths that are never ice, and the likelihood that counts as ice
#: in the high end and the low end of the content.
CONTINUITY, SKIP, HIGH_END, LOW_END = 350, 2, 0.0665, 1.0


def dense(traces: DataFrame) -> DataFrame:
    """Renumbers a track's kept traces from 0 without gaps (column ``col``): traces on both sides of a
    masked stretch become neighbours."""
    return blocks.numbered(traces)


def below_cutoffs(traces: DataFrame, cutoffs: DataFrame, skip: int = SKIP) -> DataFrame:
    """(track, trace, quantile, ice): per cutoff a boolean array of samples at or below it; the first
    ``skip`` depths are false. ``cutoffs``: quantile, cutoff, a fixed short list."""
    flag = lambda v, i: (i >= skip) & F.coalesce(v <= F.col("cutoff"), F.lit(False))
    return traces.crossJoin(F.broadcast(cutoffs)).select("track", "trace", "quantile", F.transform("samples", flag).alias("ice"))  # 15 rows


def cleaned_cells(images: DataFrame, variant: str = "SG1") -> DataFrame:
    """(track, quantile, col, depth_idx) of the pixels that a cleaning variant leaves.

    ``images``: track, quantile, col, ice; col counts from 0 without gaps.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        inner = pdf["_inner"].to_numpy()
        depth, at = np.nonzero(kernels.cleaned(blocks.matrix(pdf, "ice"), variant)[:, inner])
        return pd.DataFrame({"track": pdf["track"].iloc[0], "quantile": pdf["quantile"].iloc[0], "col": pdf["col"].to_numpy()[inner][at], "depth_idx": depth})

    return blocks.dealt(images).groupBy("track", "quantile", "_block").applyInPandas(run, "track string, quantile double, col long, depth_idx int")


def components(images: DataFrame, variant: str = "SG1") -> DataFrame:
    """(track, quantile, label, size) of the cleaned image's 4-connected components; label is the least
    number col * depths + depth of a component's pixels.

    ``images``: track, quantile, col, ice; col counts from 0 without gaps. Images are labelled block by
    block and joined at the blocks' borders.
    """
    found = blocks.labelled(images, lambda pdf: [(variant, float(pdf["quantile"].iloc[0]), kernels.cleaned(blocks.matrix(pdf, "ice"), variant), None)], by=("quantile",))
    return blocks.with_roots(found).groupBy("track", "quantile", F.col("root").alias("label")).agg(F.sum("size").alias("size"))


def ice_counts(traces: DataFrame, cutoffs: list[float], variant: str = "SG1", least: int = CONTINUITY, skip: int = SKIP) -> DataFrame:
    """(track, trace, counts): per sample, how many cutoffs call it ice after cleaning and the size
    filter; the first ``skip`` depths and missing values are never ice.

    All cutoffs of a block are done in one call, so that its samples are shipped once and one array of
    counts comes back, not one image per cutoff. Blocks are cleaned and labelled twice: first to sum
    the components' sizes over all blocks, then, told which components are large, to count.
    """
    given = np.array(cutoffs, float)

    def images(pdf: pd.DataFrame) -> list[tuple[str, float, np.ndarray, None]]:
        values = tr.image(pdf)
        return [(variant, float(i), kernels.below(values, cutoff, variant, skip), None) for i, cutoff in enumerate(given)]

    def count(pdf: pd.DataFrame, large: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        inner = pdf["_inner"].to_numpy()
        mine = pdf[inner]
        out = np.zeros((len(pdf["samples"].iloc[0]) if len(pdf) else 0, len(mine)), np.int32)
        nodes = {q: x.to_numpy() for q, x in large.groupby("quantile")["node"]}
        if len(mine):
            for _, q, image, _ in images(pdf):
                labels, node, _ = blocks.nodes_of(image[:, inner], mine["col"].to_numpy())
                keep = np.isin(node, nodes.get(q, []))
                keep[0] = False
                out += keep[labels]
        return pd.DataFrame({"track": mine["track"], "trace": mine["trace"], "counts": pd.Series(list(out.T), index=mine.index, dtype=object)})

    rows = dense(traces.select("track", "trace", "samples"))
    parts = blocks.with_roots(blocks.labelled(rows, images))
    sizes = parts.groupBy(*blocks.KEYS, "root").agg(F.sum("size").alias("_all")).where(F.col("_all") >= least)
    large = parts.join(sizes, [*blocks.KEYS, "root"], "left_semi").select("track", "_block", "quantile", "node")
    both = blocks.spread(blocks.dealt(rows), "track", "_block").groupBy("track", "_block").cogroup(blocks.spread(large, "track", "_block").groupBy("track", "_block"))
    return both.applyInPandas(count, "track string, trace long, counts array<int>")


def likelihood(counts: DataFrame, n_cutoffs: int) -> DataFrame:
    """Share of cutoffs that say ice, per sample."""
    return counts.select("track", "trace", F.transform("counts", lambda k: k / n_cutoffs).alias("likelihood"))


def likelihood_of_images(images: DataFrame, n_cutoffs: int) -> DataFrame:
    """The same from separate images (track, trace, quantile, ice), summed position by position."""
    cells = images.select("track", "trace", F.posexplode("ice").alias("depth_idx", "ice"))
    return cells.groupBy("track", "trace", "depth_idx").agg((F.count_if("ice") / n_cutoffs).alias("likelihood"))


def ice_content(like: Column, step: Column | float, limit: float = HIGH_END) -> Column:
    """Metres of ice in a trace: samples at or over the limit times the mean depth step. A null sample
    makes the content null."""
    unknown = F.exists(like, lambda v: v.isNull())
    return F.when(~unknown, F.size(F.filter(like, lambda v: v >= limit)) * (step if isinstance(step, Column) else F.lit(step)))


def mean_likelihood(like: Column, limit: float = HIGH_END) -> Column:
    """Mean over the samples at or over the limit; null without any."""
    hit = F.filter(like, lambda v: v >= limit)
    return F.try_divide(F.aggregate(hit, F.lit(0.0), lambda s, v: s + v), F.size(hit))


def mean_step(axis: Column) -> Column:
    """Mean of consecutive differences of an array: (last - first) / (n - 1)."""
    return F.try_divide(F.get(axis, F.size(axis) - 1) - F.get(axis, F.lit(0)), F.size(axis) - 1)


def thickness(content: DataFrame, positions: DataFrame, low: float | None = 1.0, high: float | None = 16.0) -> DataFrame:
    """Content with coordinates and distance, kept between low and high metres (None: no limit)."""
    rows = content.join(positions, ["track", "trace"])
    if low is not None:
        rows = rows.where(F.col("content") >= low)
    return rows if high is None else rows.where(F.col("content") <= high)


def product(like: DataFrame, positions: DataFrame, depths: DataFrame, below: float = 20.0) -> DataFrame:
    """Likelihood by depth under 20 m with coordinates: one row per trace, arrays of both.

    ``depths``: track, depths; samples past the axis are left out.
    """
    rows = like.join(depths, "track").join(positions.select("track", "trace", "lon", "lat"), ["track", "trace"])
    pairs = F.filter(F.arrays_zip("likelihood", "depths"), lambda p: p["depths"] < below)
    return rows.withColumn("_p", pairs).select("track", "trace", "lon", "lat", F.col("_p.likelihood").alias("likelihood"), F.col("_p.depths").alias("depths"))


def ice_bounds(like: DataFrame, step: float) -> DataFrame:
    """Depths of the first and last sample with likelihood over 0 of each trace; null without ice."""
    flags = F.transform("likelihood", lambda v: v > 0)
    n = F.size(flags)
    top, last = F.array_position(flags, F.lit(True)), F.array_position(F.reverse(flags), F.lit(True))
    return like.withColumns({"top": F.when(top > 0, (top - 1) * F.lit(step)), "bottom": F.when(top > 0, (n - last) * F.lit(step))})


def bounds_summary(bounds: DataFrame, lon_low: float, lon_high: float) -> DataFrame:
    """Mean and population deviation of top and bottom in a longitude range."""
    rows = bounds.where(F.col("lon").between(lon_low, lon_high))
    return rows.groupBy("track").agg(F.avg("top").alias("mean_top"), F.stddev_pop("top").alias("sd_top"), F.avg("bottom").alias("mean_bottom"), F.stddev_pop("bottom").alias("sd_bottom"))


def range_thickness(df: DataFrame, lon_low: float, lon_high: float, value: str = "content") -> DataFrame:
    """Mean and median thickness per track in a longitude range."""
    return df.where(F.col("lon").between(lon_low, lon_high)).groupBy("track").agg(F.avg(value).alias("mean_thickness"), F.median(value).alias("median_thickness"))


def smoothed(df: DataFrame, width: float = 2500.0, value: str = "content") -> DataFrame:
    """Per track and stretch of ``width`` metres: mean, population deviation, count, and the ordered
    line of its points. A stretch holds as many points as fit its length."""
    rows = df.withColumn("bin", F.floor(F.col("distance") / width).cast("long"))
    return rows.groupBy("track", "bin").agg(
        F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("sd_value"), F.count(value).alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("trace", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"),
    )
