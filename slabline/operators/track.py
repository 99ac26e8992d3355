"""Positions along tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def along(track: list[str] | str = "track", order: str = "trace"):
    """The window of a track in order."""
    return Window.partitionBy(*([track] if isinstance(track, str) else track)).orderBy(order)


def with_polar(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    x, y = geo.to_polar(F.col(lon), F.col(lat))
    return df.withColumns({"x": x, "y": y})


def step(x: str = "x", y: str = "y", w=None) -> Column:
    """Distance from the point before; null at the first one and where a coordinate is missing."""
    w = w or along()
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return F.sqrt(dx * dx + dy * dy)


def with_distance(df: DataFrame, track: list[str] | str = "track", order: str = "trace", name: str = "distance") -> DataFrame:
    """Cumulative distance along a track; the first point has 0, steps that are unknown count 0."""
    w = along(track, order)
    rows = df.withColumn("_step", step(w=w))
    total = F.sum(F.coalesce(F.nanvl("_step", F.lit(0.0)), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, total).drop("_step")


def step_summary(df: DataFrame) -> DataFrame:
    """Total and mean step per track, and of all under the track null."""
    steps = df.withColumn("_step", step())
    return steps.rollup("track").agg(F.sum("_step").alias("total"), F.avg("_step").alias("mean_step"))


def with_curvature(df: DataFrame) -> DataFrame:
    """Angle between the rays to the point before and after, and the angle per metre of their mean
    length; null at both ends and where a ray has no length."""
    w = along()
    ax, ay = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    bx, by = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cosine = F.try_divide(ax * bx + ay * by, la * lb)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return df.withColumn("curvature", F.when(cosine.isNotNull(), angle)).withColumn("_mean", (la + lb) / 2).withColumn("curvature_per_m", F.try_divide("curvature", "_mean")).drop("_mean")


def eastward(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Renumbers the traces of tracks that run to the west from their end."""
    whole = Window.partitionBy("track")
    ends = df.withColumns({"_n": F.count("*").over(whole), "_a": F.min_by(lon, "trace").over(whole), "_b": F.max_by(lon, "trace").over(whole)})
    return ends.withColumn("trace", F.when(F.col("_b") < F.col("_a"), F.col("_n") - 1 - F.col("trace")).otherwise(F.col("trace"))).drop("_n", "_a", "_b")


def nearest_trace(df: DataFrame, target: float, tolerance: float = 0.2, lon: str = "lon") -> DataFrame:
    """Per track the trace nearest to a longitude, if it is within the tolerance; ties go to the first."""
    off = F.abs(F.col(lon) - F.lit(target))
    near = df.where(off <= tolerance).groupBy("track").agg(F.min(F.struct(off.alias("off"), "trace", F.col(lon).alias("lon"))).alias("m"))
    return near.select("track", "m.trace", "m.lon")


def nearest_on_track(points: DataFrame, traces: DataFrame, width: float, key: str = "point") -> DataFrame:
    """(key, track, trace, off): for every point the nearest trace of its track by x; ties go to the first.

    Traces are put in bins of ``width`` and a point looks at three of them, so a point meets few traces.
    Points with no trace within that width look at the ends of all their track's bins instead, of which
    there are few, in one pass in the order of x. ``points``: key, track, px; ``traces``: track, trace, x.
    """
    bin_ = lambda c: F.floor(F.col(c) / width).cast("long")
    binned = traces.where("x is not null").withColumn("_bin", bin_("x"))
    looked = points.withColumn("_bin", F.explode(F.array(*[bin_("px") + F.lit(k) for k in (-1, 0, 1)])))
    met = looked.join(binned, ["track", "_bin"]).withColumn("off", F.abs(F.col("x") - F.col("px"))).where(F.col("off") <= width)
    near = met.groupBy(key, "track").agg(F.min(F.struct("off", "trace")).alias("m"))
    ends = binned.groupBy("track", "_bin").agg(F.min(F.struct("x", "trace")).alias("lo"), F.max(F.struct("x", (-F.col("trace")).alias("back"))).alias("hi"))
    end = F.explode(F.array(F.struct(F.col("lo.x").alias("x"), F.col("lo.trace").alias("trace")), F.struct(F.col("hi.x").alias("x"), (-F.col("hi.back")).alias("trace")))).alias("end")
    far = points.join(near.select(key, "track"), [key, "track"], "left_anti").where("px is not null")
    both = far.select("track", key, F.col("px").alias("_x"), F.lit(None).cast("struct<x:double,trace:bigint>").alias("end")).unionByName(
        ends.select("track", end).select("track", F.col("end.x").cast("double").alias("_x"), F.struct(F.col("end.x").cast("double").alias("x"), F.col("end.trace").cast("long").alias("trace")).alias("end")), allowMissingColumns=True
    )
    w = Window.partitionBy("track").orderBy("_x", F.desc("end.trace"))
    sides = F.array(F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("end", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    at = both.withColumn("_sides", sides).where(F.col("end").isNull())
    best = F.array_min(F.transform(F.array_compact("_sides"), lambda e: F.struct(F.abs(e["x"] - F.col("_x")).alias("off"), e["trace"].alias("trace"))))
    rest = at.select(key, "track", best.alias("m")).where("m is not null")
    return near.unionByName(rest).select(key, "track", F.col("m.trace").alias("trace"), F.col("m.off").alias("off"))


def nearest_depth(points: DataFrame, axes: DataFrame, depth: str = "depth") -> DataFrame:
    """Adds depth_idx, the index of the nearest depth of the track's axis; ties go to the first.
    ``axes``: track, depths, one row per track."""
    off = F.transform("depths", lambda d: F.abs(d - F.col(depth)))
    return points.join(axes.select("track", "depths"), "track").withColumn("depth_idx", F.array_position(off, F.array_min(off)).cast("int") - 1).drop("depths")


def clean_gps(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """0 means no fix: null. Longitudes stored as degrees west get their sign."""
    return df.withColumns({lat: F.nullif(F.col(lat), F.lit(0.0)), lon: -F.nullif(F.col(lon), F.lit(0.0))})
