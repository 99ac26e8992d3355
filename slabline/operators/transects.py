"""Repeat transects: profiles, bins, changes, and the weather beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pooled
from . import track as tk


def of_transects(points: DataFrame, transects: DataFrame) -> DataFrame:
    """The listed tracks' points inside the transect's longitude and latitude bounds.

    ``transects``: transect, track, lon0, lon1, lat0, lat1; a null bound is none.
    """
    rows = points.join(transects, "track")
    ok = F.lit(True)
    for c in ("lon", "lat"):
        ok = ok & (F.col(f"{c}0").isNull() | (F.col(c) >= F.col(f"{c}0"))) & (F.col(f"{c}1").isNull() | (F.col(c) <= F.col(f"{c}1")))
    return rows.where(ok).drop("lon0", "lon1", "lat0", "lat1")


def capped(df: DataFrame, most: float = 16.0, value: str = "content") -> DataFrame:
    """Thickness is at most ``most``; null stays null."""
    return df.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.col(value), F.lit(most))))


def transect_distance(points: DataFrame, by_y: tuple[int, ...] = (2011,), own_start: tuple[int, ...] = ()) -> DataFrame:
    """Distance along each transect and year, from the transect's western end.

    Years are ordered by x, those in ``by_y`` by y. The offset to the common start is the distance from
    the westernmost point of all years to the year's first one; years in ``own_start`` begin at 0.
    """
    key = F.when(F.col("year").isin(list(by_y)), F.col("y")).otherwise(F.col("x")) if by_y else F.col("x")
    rows = points.withColumn("_o", F.struct(key.alias("a"), F.col("track").alias("b"), F.col("trace").alias("c")))
    rows = tk.with_distance(rows, ["transect", "year"], "_o", "_d")
    starts = points.groupBy("transect").agg(F.min(F.struct("x", "y")).alias("_s"))
    first = rows.groupBy("transect", "year").agg(F.min_by(F.struct("x", "y"), "_o").alias("_f"))
    off = F.sqrt(F.pow(F.col("_f.x") - F.col("_s.x"), F.lit(2)) + F.pow(F.col("_f.y") - F.col("_s.y"), F.lit(2)))
    first = first.join(starts, "transect").withColumn("_off", F.when(F.col("year").isin(list(own_start)), 0.0).otherwise(off) if own_start else off)
    return rows.join(first.select("transect", "year", "_off"), ["transect", "year"]).withColumn("distance", F.col("_d") + F.col("_off")).drop("_o", "_d", "_off")


def binned(points: DataFrame, keys: list[str], width: float = 300.0, value: str = "content") -> DataFrame:
    """Per key and bin of distance: mean, median, quartiles and sample deviation. Bins without points,
    between a key's first and last one, are kept with nulls."""
    rows = points.withColumn("bin", F.floor(F.col("distance") / width).cast("long"))
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    got = rows.groupBy(*keys, "bin").agg(F.avg(value).alias("mean_value"), F.median(value).alias("median_value"), p.alias("_p"), F.stddev_samp(value).alias("sd_value"), F.count(value).alias("n"))
    ends = got.groupBy(*keys).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    every = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias("bin"))
    out = every.join(got, [*keys, "bin"], "left")
    return out.withColumns({"q25": F.get("_p", F.lit(0)), "q75": F.get("_p", F.lit(1)), "n": F.coalesce("n", F.lit(0))}).drop("_p")


def rolling(bins: DataFrame, keys: list[str], columns: tuple[str, ...] = ("median_value", "q25", "q75")) -> DataFrame:
    """Centred medians of 3 bins (columns roll_...), null unless all 3 are there."""
    w = Window.partitionBy(*keys).orderBy("bin")
    three = w.rowsBetween(-1, 1)
    out = {}
    for c in columns:
        trio = F.sort_array(F.array(F.lag(c).over(w), F.col(c), F.lead(c).over(w)))
        out[f"roll_{c}"] = F.when(F.count(c).over(three) == 3, F.get(trio, F.lit(1)))
    return bins.withColumns(out)


def gap_edges(bins: DataFrame, keys: list[str], rolled: str = "roll_median_value", raw: str = "median_value") -> DataFrame:
    """Adds edge: the rolled value next to a gap, and the raw one where there is no rolled one; else null.
    The first bin has no bin before, and the last none after."""
    w = Window.partitionBy(*keys).orderBy("bin")
    n, last = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    gap = ((n > 1) & F.lag(rolled).over(w).isNull()) | ((n < last) & F.lead(rolled).over(w).isNull())
    return bins.withColumn("edge", F.when(F.col(rolled).isNull(), F.col(raw)).when(gap, F.col(rolled)))


def with_sector(df: DataFrame, sectors: list[tuple[str, float, float | None]], at: str = "distance") -> DataFrame:
    """Label of the sector [low, high); an upper end of None is open. Null outside."""
    inside = lambda lo, hi: (F.col(at) >= lo) if hi is None else (F.col(at) >= lo) & (F.col(at) < hi)
    return df.withColumn("sector", F.coalesce(*[F.when(inside(lo, hi), F.lit(name)) for name, lo, hi in sectors]))


def sector_area(points: DataFrame, keys: list[str], value: str = "content") -> DataFrame:
    """Ice area: the sum of content times the mean spacing, which is (last - first) / (n - 1)."""
    s = points.groupBy(*keys).agg(F.sum(value).alias("total"), F.min("distance").alias("_a"), F.max("distance").alias("_b"), F.count("*").alias("n"))
    spacing = F.try_divide(F.col("_b") - F.col("_a"), F.col("n") - 1)
    return s.withColumn("area", F.col("total") * spacing).drop("_a", "_b", "total")


def change(df: DataFrame, keys: list[str], first: int, last: int, value: str = "area", by: str = "year") -> DataFrame:
    """Value in two years and its percent change; null where one is missing."""
    w = df.groupBy(*keys).agg(F.max(F.when(F.col(by) == first, F.col(value))).alias("first"), F.max(F.when(F.col(by) == last, F.col(value))).alias("last"))
    return w.withColumn("percent", F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100)


def summary(df: DataFrame, keys: list[str], value: str = "content") -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and largest value per key."""
    of = F.struct(*keys).alias("_key")
    g = df.groupBy(of).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("sd_value"), F.min(value).alias("low"), F.max(value).alias("high"))
    quartiles = pooled.keyed_percentiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return g.join(quartiles, "_key", "left").select("_key.*", "n", "mean_value", "sd_value", "low", "high", "q25", "q50", "q75")


def bin_difference(bins: DataFrame, first: int, last: int, low: float, high: float, width: float = 300.0, value: str = "median_value", by: str = "year") -> DataFrame:
    """Mean and median, over bins that start in a distance range, of the change of a value between two
    years; bins that lack one are left out."""
    rows = bins.where((F.col("bin") * F.lit(width)).between(low, high) & F.col(by).isin(first, last))
    pairs = rows.groupBy("transect", "bin").agg(F.max(F.when(F.col(by) == first, F.col(value))).alias("a"), F.max(F.when(F.col(by) == last, F.col(value))).alias("b"))
    d = pairs.withColumn("d", F.col("b") - F.col("a"))
    return d.groupBy("transect").agg(F.count("d").alias("n"), F.avg("d").alias("mean_change"), F.median("d").alias("median_change"))


def variability(points: DataFrame, lon_low: float, lon_high: float, first: int, last: int) -> DataFrame:
    """Percent difference of the ice area of two years in a longitude range, per transect."""
    inside = points.where(F.col("lon").between(lon_low, lon_high))
    return change(sector_area(inside, ["transect", "year"]), ["transect"], first, last)


def level_distances(profile: DataFrame, every: float = 50.0) -> DataFrame:
    """(transect, level, distance, elevation): where a profile comes nearest to each whole level within
    its range; of ties the first place. Samples without a finite elevation, or without a transect, are left
    out.

    Samples are put into the bands between levels. Of a band only the place nearest to its lower level and
    that nearest to its upper one matter; the levels from one band to the next are nearest to a place of
    either. So what is shuffled is at most one narrow row per elevation, whatever the profile's steps.
    """
    finite = profile.where((F.abs("elevation") < F.lit(float("inf"))) & F.col("transect").isNotNull())
    # the least of a plain column: unlike that of a struct, it is found without sorting the samples
    rows = finite.groupBy("transect", "elevation").agg(F.min("distance").alias("distance")).withColumn("k", F.floor(F.col("elevation") / every))
    off = lambda p, k: F.struct(F.abs(p["elevation"] - k * F.lit(every)).alias("off"), p["distance"].alias("distance"), p["elevation"].alias("elevation"))
    here = F.struct("distance", "elevation")
    bands = rows.groupBy("transect", "k").agg(F.min(off(here, F.col("k"))).alias("_low"), F.min(off(here, F.col("k") + 1)).alias("_high"), F.min(F.ceil(F.col("elevation") / every)).alias("_first"))
    w = Window.partitionBy("transect").orderBy("k")  # one row per band
    bands = bands.withColumns({"_below": F.lag("_high").over(w), "_from": F.coalesce(F.lag("k").over(w) + 1, F.col("_first"))}).where("_from <= k")
    each = bands.select("transect", "_low", "_below", F.explode(F.sequence("_from", "k")).alias("k"))
    best = F.least(off(F.col("_low"), F.col("k")), F.when(F.col("_below").isNotNull(), off(F.col("_below"), F.col("k"))))
    return each.select("transect", (F.col("k") * F.lit(every)).alias("level"), best.alias("m")).select("transect", "level", "m.distance", "m.elevation")


def every_distance(profile: DataFrame, every: float = 5000.0) -> DataFrame:
    """(transect, mark, elevation) of the sample nearest to each multiple of ``every`` metres within
    half of that; of ties the first."""
    mark = F.floor(F.col("distance") / every + 0.5) * F.lit(every)
    rows = profile.withColumn("mark", mark)
    best = rows.groupBy("transect", "mark").agg(F.min(F.struct(F.abs(F.col("distance") - F.col("mark")).alias("off"), "distance", "elevation")).alias("m"))
    return best.select("transect", "mark", "m.elevation")


def degree_hours(hours: DataFrame, last_year: int | None = None) -> DataFrame:
    """Per year: hours with a temperature, hours above 0, and the sum of temperatures above 0."""
    t = F.col("temperature")
    rows = hours if last_year is None else hours.where(F.col("year") <= last_year)
    return rows.groupBy("year").agg(F.count("temperature").alias("n_hours"), F.count_if(t > 0).alias("n_positive"), F.coalesce(F.sum(F.when(t > 0, t)), F.lit(0.0)).alias("degree_hours"))


def accretion(df: DataFrame, low: float, high: float) -> Column:
    """1 inside a longitude window, else 0."""
    return df["lon"].between(low, high).cast("int")
