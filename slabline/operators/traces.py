"""Time, depth and the samples of traces. A trace is a row with the array ``samples``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import blocks

#: Speed of light, and how density enters the wave speed. The density is in g/cm3
#: although the factor is for kg/m3; the product's depths depend on that.
LIGHT, DENSITY = 299792458.0, 0.873
#: Indices of refraction of air and of pure ice, and its density in kg/m3.
N_AIR, N_ICE, ICE = 1.000293, 1.3078, 917.0
#: Years whose time axis is reset also if it starts late.
RESET_YEARS = (2011, 2012, 2014, 2017, 2018)


def speed(density: Column, kind: str = "modified", factor: float = 0.734) -> Column:
    """Wave speed in firn of a density in kg/m3: standard scales the index of refraction between air
    and pure ice; robin, adjusted and modified are linear in the density."""
    if kind == "standard":
        return F.lit(LIGHT) / (F.lit(N_AIR) + F.lit(N_ICE - N_AIR) * density / F.lit(ICE))
    k = {"robin": 0.851, "adjusted": 0.700, "modified": factor}[kind]
    return F.lit(LIGHT) / (1 + F.lit(k) * density / 1000)


def depth_axis(axis: DataFrame, density: float = DENSITY, late_years: tuple[int, ...] = RESET_YEARS) -> DataFrame:
    """Adds depths: half the way at firn speed, moved to start at 0 where the tenth sample's depth is
    negative, or over 1 in the listed years. ``axis``: track, year, times."""
    raw = F.transform("times", lambda t: t * speed(F.lit(density)) / 2)
    rows = axis.withColumn("_raw", raw).withColumn("_at", F.get("_raw", F.lit(10)))
    moved = (F.col("_at") < 0) | ((F.col("_at") > 1) & F.col("year").isin(list(late_years)))
    first = F.get("_raw", F.lit(0))
    return rows.withColumn("depths", F.when(moved, F.transform("_raw", lambda d: d - first)).otherwise(F.col("_raw"))).drop("_raw", "_at")


def even_times(n: Column, dt: float) -> Column:
    """Times dt, 2 dt, ... of n samples."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: i * F.lit(dt))


def metres_to_samples(above: float, below: float, mean_step: Column) -> tuple[Column, Column]:
    """Samples above and below the surface, rounded half to even; below counts its last one too."""
    return F.bround(F.lit(above) / mean_step).cast("int"), F.bround(F.lit(below) / mean_step).cast("int") + 1


def shallow(traces: DataFrame, count: Column | int) -> DataFrame:
    """Cuts traces to their first samples."""
    return traces.withColumn("samples", F.slice("samples", 1, count))


def axis_clashes(files: DataFrame) -> DataFrame:
    """Per track, how many different time axes its files have. ``files``: track, times."""
    return files.groupBy("track").agg(F.count_distinct(F.xxhash64("times")).alias("n_axes"))


def log10_samples(samples: str = "samples") -> Column:
    """Base-10 logarithm; infinite or undefined becomes null."""
    return F.transform(samples, lambda v: F.when(v > 0, F.log10(v)))


def surface_sample(traces: DataFrame, axis: DataFrame, pick: str = "pick") -> DataFrame:
    """Index of the sample at the pick time, else the nearest (of ties the first).

    ``axis``: track, times; one row per track, joined to the traces without cells being exploded.
    """
    off = F.transform("times", lambda t: F.abs(t - F.col(pick)))
    return traces.join(axis.select("track", "times"), "track").withColumn("surface", F.array_position(off, F.array_min(off)).cast("int") - 1).drop("times")


def first_after(times: str, pick: str) -> Column:
    """Index of the first sample whose time exceeds the pick; null without one."""
    late = F.transform(times, lambda t: t > F.col(pick))
    at = F.array_position(late, F.lit(True))
    return F.when(at > 0, at.cast("int") - 1)


def start_pixel(tracks: DataFrame, suggested: DataFrame) -> DataFrame:
    """The start of the surface: a hand suggestion, else the track's own pick. ``tracks``: track, pick;
    ``suggested``: track, pixel, at most one row per track."""
    return tracks.join(suggested, "track", "left").select("track", F.coalesce("pixel", "pick").alias("start"))


def overridden(surface: DataFrame, manual: DataFrame) -> DataFrame:
    """Hand-picked surfaces replace found ones trace by trace, for tracks that have any."""
    return surface.join(manual.withColumnRenamed("pixel", "_pixel"), ["track", "trace"], "left").withColumn("surface", F.coalesce("_pixel", "surface")).drop("_pixel")


def image(pdf: pd.DataFrame, column: str = "samples") -> np.ndarray:
    """The traces of a frame as a depth x trace matrix; missing samples are NaN."""
    return np.array([np.asarray(x, float) for x in pdf[column]]).T


def entered(maps: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(track, _block, entry): where each block is entered, from the maps of the blocks before it.

    ``maps``: track, _block (from 0 without gaps), ends (for each sample at which the block is entered,
    that at which it is left), of all of a track's blocks but the last; ``starts``: track, start; ``most``:
    the largest number of maps of a track. Maps of neighbours are put together in pairs, these again,
    and so on; then entries are handed down, the left half's being the whole's, the right half's what
    the left one's map makes of it. Twice the logarithm of ``most`` rounds, each over half as many maps.
    """
    levels = [maps]
    while 2 ** len(levels) <= most:
        below = levels[-1]
        right = below.where("_block % 2 = 1").select("track", (F.col("_block") - 1).alias("_block"), F.col("ends").alias("_then"))
        both = below.where("_block % 2 = 0").join(right, ["track", "_block"])
        put = F.transform("ends", lambda x: F.get("_then", x))
        levels.append(blocks.held(both.select("track", F.floor(F.col("_block") / 2).alias("_block"), put.alias("ends"))))
    at = starts.select("track", F.lit(0).cast("long").alias("_block"), F.col("start").cast("int").alias("entry"))
    for maps_ in reversed(levels):
        halves = at.select("track", (2 * F.col("_block")).alias("_block"), "entry")
        out = F.get("ends", F.greatest(F.lit(0), F.least("entry", F.size("ends") - 1)))
        child = lambda block, entry: F.struct(block.alias("_block"), entry.alias("entry"))
        both = F.array_compact(F.array(child(F.col("_block"), F.col("entry")), F.when(F.col("ends").isNotNull(), child(F.col("_block") + 1, out))))
        at = halves.join(maps_, ["track", "_block"], "left").select("track", F.explode(both).alias("_of")).select("track", "_of.*")
    return at


def followed_surface(traces: DataFrame, starts: DataFrame, radius: int = 50, search: int = 150, smooth: bool = True) -> DataFrame:
    """(track, trace, surface): the surface followed from each track's start. ``starts``: track, start.

    Each pick depends on the one before, so a block of traces that another follows is first followed from
    every sample where it could be entered. These maps, one small row per block, are put together in
    pairs (``entered``), and then every block is followed from where it is entered; tracks of one block
    need no map. Samples are never gathered by track; false jumps are removed from the line of a track,
    one number per trace.
    """

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.arange(len(pdf["samples"].iloc[0]))
        for step in kernels.surface_steps(image(pdf.sort_values("col")), radius, search):
            at = step[at]
        return pd.DataFrame({"track": [pdf["track"].iloc[0]], "_block": [pdf["_block"].iloc[0]], "ends": [at.astype(np.int32)]})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        line = kernels.follow_surface(image(pdf), int(pdf["entry"].iloc[0]), radius, search)
        return pd.DataFrame({"track": pdf["track"], "trace": pdf["trace"], "surface": line})

    def even(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trace")
        return pd.DataFrame({"track": pdf["track"], "trace": pdf["trace"], "surface": kernels.without_jumps(pdf["surface"].to_numpy())})

    starts = starts.select("track", "start")
    rows = blocks.numbered(traces.join(starts.select("track"), "track", "left_semi").select("track", "trace", "samples"))
    rows = blocks.dealt(rows, halo=0).drop("_inner")
    last = blocks.held(traces.select("track", "trace").groupBy("track").agg(F.floor((F.count("*") - 1) / blocks.BLOCK).alias("_last")))
    most = last.agg(F.max("_last")).first()[0] or 0
    if most:
        followed = blocks.spread(rows.join(last.where("_last > 0"), "track").where("_block < _last").drop("_last"), "track", "_block")
        maps = blocks.held(followed.groupBy("track", "_block").applyInPandas(ends, "track string, _block long, ends array<int>"))
        at = entered(maps, starts, most)
    else:
        at = starts.select("track", F.lit(0).cast("long").alias("_block"), F.col("start").cast("int").alias("entry"))
    out = blocks.spread(rows.join(at, ["track", "_block"]), "track", "_block")
    out = out.groupBy("track", "_block").applyInPandas(follow, "track string, trace long, surface int")
    return out.groupBy("track").applyInPandas(even, "track string, trace long, surface int") if smooth else out


def cut_at_surface(traces: DataFrame, above: Column | int, below: Column | int) -> DataFrame:
    """Samples from ``above`` before the surface to ``below`` after it, moved inside the array where
    they would leave it."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (above, below))
    room = F.size("samples") - (a + b)
    first = F.greatest(F.lit(0), F.least(F.col("surface") - a, room))
    return traces.withColumn("samples", F.slice("samples", first + 1, a + b))


def mean_by_depth(traces: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Mean sample per track and depth, of all traces or of those from low to high."""
    rows = traces if low is None else traces.where(F.col("trace").between(low, high))
    cells = rows.select("track", F.posexplode("samples").alias("depth_idx", "value"))
    return cells.groupBy("track", "depth_idx").agg(F.avg("value").alias("mean_value"))


def cells(traces: DataFrame) -> DataFrame:
    """One row per sample: track, trace, depth_idx, value."""
    return traces.select("track", "trace", F.posexplode("samples").alias("depth_idx", "value"))
