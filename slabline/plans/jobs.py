"""The survey's four flows as whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, correct, gpsmatch, identify, masks, pooled, track
from ..operators import regions as rg
from ..operators import traces as tr
from ..operators import transects as ts

#: The quantiles at which signals are cut.
QUANTILES = tuple(q / 100 for q in range(65, 80))


def polygons(areas: DataFrame) -> DataFrame:
    """(id, region, ring) of rectangles given by their corners."""
    ring = rg.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return areas.select("id", "region", ring.alias("ring"))


def named_points(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points with the region that holds them, else Out."""
    return rg.with_region(points, shapes, ["track", "trace"], "lon", "lat")


def slab_points(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points of 1 to 16 m of ice with region, period and projected position."""
    ice = points.where(F.col("content").between(1, 16))
    return track.with_polar(rg.by_period(named_points(ice, shapes)))


def elevation_limits(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Summary of the slabs' highest elevations by region and period."""
    return rg.region_summary(rg.own_slice_limits(slab_points(points, shapes)))


def gridded_limits(points: DataFrame, sheet: DataFrame, shapes: DataFrame, dem: DataFrame, x0: float, y0: float, size: float) -> DataFrame:
    """Summary of the slabs' highest elevations by region and period, of points within the ice sheet's
    polygons (``sheet``: id, region, ring), with elevations from a grid in place of their own.

    ``points``: track, trace, lon, lat, content, year; the grid's cells are ``size`` degrees wide, rows
    count down from latitude y0, columns right from longitude x0. Points without a cell have no elevation.
    """
    ice = points.where(F.col("content").between(1, 16)).drop("elevation")
    inside = rg.clipped(ice, sheet, ["track", "trace"], "lon", "lat").drop("id", "region")
    at = rg.with_elevation(named_points(inside, shapes), dem, x0, y0, size, "lon", "lat").withColumnRenamed("dem", "elevation")
    return rg.region_summary(rg.own_slice_limits(track.with_polar(rg.by_period(at))))


def lens_points(radar: DataFrame, gps: DataFrame, names: DataFrame, limits: DataFrame, outlines: DataFrame, width: int, shapes: DataFrame) -> DataFrame:
    """(track, outline, trace, lat, lon, region) of the confident ice of 2002-2003.

    Radargrams on the candidate list, damaged ones cut, get positions by whole seconds; digitised
    outlines meet them by trace. ``radar``: radargram, second, index_vector; ``gps``: second, index_gps,
    lat, lon (degrees west); ``names``: radargram; ``limits``: radargram, n; ``outlines``: track (a
    radargram), outline, xcoord, colour. Traces without a position stay, with nulls and region Out.
    """
    located = gpsmatch.matched(gpsmatch.limited(gpsmatch.candidates(radar, names), limits), gps)
    at = track.clean_gps(located).select(F.col("radargram").alias("track"), F.col("index_vector").alias("trace"), "lat", "lon")
    seen = gpsmatch.confident(gpsmatch.outline_traces(outlines, width)).select("track", "outline", "trace")
    return rg.with_region(seen.join(at, ["track", "trace"]), shapes, ["track", "outline", "trace"], "lon", "lat")


def listed(exclusions: DataFrame, name: str, single: bool = True) -> DataFrame:
    """(track, token, lo, hi): the intervals of one list. Notes that repeat are one before any is parsed."""
    return masks.intervals(exclusions.where(F.col("list") == name).select("track", "token").distinct(), single=single)


def kept_apart(traces: DataFrame) -> DataFrame:
    """Traces computed once, kept, and dealt over all partitions: a trace is few bytes and much work, and
    several fits read it."""
    return blocks.held_apart(blocks.spread(traces, "track", "trace"))


def roll_levelled(traces: DataFrame, positions: DataFrame, step: float) -> DataFrame:
    """Traces corrected for aircraft roll: fits per depth, smoothed over depth, and applied with a roll
    without gaps. ``positions``: track, trace, lon, lat, roll in radians; ``step``: metres between samples.
    Ends and gaps of the roll are those of the given traces, so that masked ones have no part in it."""
    at = track.with_curvature(track.with_polar(positions.select("track", "trace", "lon", "lat", "roll")))
    at = at.join(traces.select("track", "trace"), ["track", "trace"])
    rolls = correct.filled_roll(at).select("track", "trace", "roll_seen", "roll_filled")
    rows = traces.join(rolls, ["track", "trace"])
    cells = rows.select("track", F.col("roll_seen").alias("roll"), F.posexplode("samples").alias("depth_idx", "value"))
    fit = correct.roll_fit(cells)
    decay = correct.roll_decay(fit, fit.select("track", "depth_idx", (F.col("depth_idx") * F.lit(step)).alias("depth")))
    deepest = fit.groupBy("track").agg(F.max("depth_idx").alias("_deepest"))
    curves = correct.roll_curves(decay.join(deepest, "track"), F.transform(F.sequence(F.lit(0), F.col("_deepest")), lambda i: i * F.lit(step)))
    return correct.roll_corrected(rows, curves).drop("roll_seen", "roll_filled")


def corrected_traces(kept: DataFrame, step: float, flagged: DataFrame | None = None) -> DataFrame:
    """Traces less their track's surface value, freed from their decay with depth; flagged tracks are
    rescaled to the range of the others. ``flagged``: track."""
    flat = correct.minus_surface(kept)
    sums = correct.depth_sums(flat)
    # one row per track, used by the quantiles and by the images: kept, so that it is fitted once
    fit = blocks.held(correct.depth_fit(sums, sums.select("track", "depth_idx", (F.col("depth_idx") * F.lit(step)).alias("depth"))))
    out = correct.depth_corrected(flat, fit, F.transform("samples", lambda _, i: i * F.lit(step)))
    if flagged is None:
        return out
    out = kept_apart(out)  # the others' percentiles read all of it
    scaled = correct.rescaled(out, flagged)
    return out.join(flagged.select("track"), "track", "left_anti").unionByName(scaled)


def ice_thickness(flat: DataFrame, exclusions: DataFrame, positions: DataFrame, step: float, continuity: int) -> DataFrame:
    """(track, trace, content, likelihood, lon, lat, distance) of corrected traces: cutoffs from all
    their samples, ice images, likelihood, porous firn, content, position."""
    flat = kept_apart(flat.select("track", "trace", "samples"))
    values = tr.cells(flat).where("value is not null and not isnan(value)")
    cut = pooled.percentiles(values, "value", QUANTILES)
    like = identify.likelihood(identify.ice_counts(flat, cut or [], least=continuity), len(QUANTILES))
    firn = listed(exclusions, "0", single=False)
    content = like.withColumns({"content": identify.ice_content(F.col("likelihood"), step), "mean_likelihood": identify.mean_likelihood(F.col("likelihood"))})
    content = masks.with_porous_firn(content.drop("likelihood"), firn, "content", "mean_likelihood")
    # a track's distances need all its positions, but tracks without traces have no part in the result
    flown = positions.join(flat.select("track").distinct(), "track", "left_semi")
    where = track.with_distance(track.with_polar(flown)).select("track", "trace", "lon", "lat", "distance")
    return identify.thickness(content, where, None, None).withColumnRenamed("mean_likelihood", "likelihood")


def traces_to_thickness(traces: DataFrame, exclusions: DataFrame, positions: DataFrame, step: float = 0.5, continuity: int = 20, shallow: int = 41) -> DataFrame:
    """(track, trace, content, likelihood, lon, lat, distance) from traces that are cut at the surface and
    levelled for roll.

    Order: mask, surface value, depth fit and correction, cutoffs from the corrected signal, ice
    images, likelihood, porous firn, content, position. Arrays stay whole but for the depth sums and
    the quantiles; blocks of neighbouring traces are the unit of the image work.
    """
    kept = kept_apart(masks.masked_out(traces, listed(exclusions, "1")))
    flat = tr.shallow(corrected_traces(kept, step), shallow)
    return ice_thickness(flat, exclusions, positions, step, continuity)


def radar_to_thickness(
    traces: DataFrame, starts: DataFrame, exclusions: DataFrame, positions: DataFrame, flagged: DataFrame | None = None, step: float = 0.5, samples: int = 48, shallow: int = 41, continuity: int = 20, radius: int = 50, search: int = 150, logarithm: bool = True
) -> DataFrame:
    """The main product from raw traces: follow the surface and cut there, mask, take logarithms, level
    for roll, then as traces_to_thickness, flagged tracks being rescaled.

    ``starts``: track, start; ``positions``: track, trace, lon, lat, roll in radians. Without
    ``logarithm`` the signal is one already.
    """
    surface = tr.followed_surface(traces, starts, radius, search)
    cut = tr.cut_at_surface(traces.join(surface, ["track", "trace"]), 0, samples).drop("surface")
    kept = masks.masked_out(cut, listed(exclusions, "1"))
    # the surface is followed once
    kept = kept_apart(kept.withColumn("samples", tr.log10_samples()) if logarithm else kept)
    level = kept_apart(roll_levelled(kept, positions, step))
    return ice_thickness(tr.shallow(corrected_traces(level, step, flagged), shallow), exclusions, positions, step, continuity)


def transect_profiles(points: DataFrame, listed: DataFrame, width: float = 300.0) -> DataFrame:
    """Binned and smoothed thickness along repeat transects, by year."""
    at = ts.capped(track.with_polar(ts.of_transects(points, listed)))
    keys = ["transect", "year"]
    bins = ts.binned(ts.transect_distance(at), keys, width)
    return ts.gap_edges(ts.rolling(bins, keys), keys)

