"""Positions of the 2002-2003 radargrams, by whole seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Codes of digitised outlines by the first three letters of their colour word.
COLOURS = {"red": -1, "ora": 0, "gre": 1, "pur": 2}


def matched(radar: DataFrame, gps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Radar rows with the position of the k-th GPS row of their second, k being the radar row's
    place in its second; coordinates 0 without one.

    A first second that occurs once in a radargram but repeats in the GPS table starts at its second
    GPS row. ``radar``: radargram, second, index_vector; ``gps``: second, index_gps, lat, lon;
    ``keys``: columns, such as the day, that both have besides.
    """
    keys = keys or []
    inside = Window.partitionBy("radargram", *keys, "second")
    r = radar.withColumns({"k": F.row_number().over(inside.orderBy("index_vector")), "_same": F.count("*").over(inside), "_first": F.min("second").over(Window.partitionBy("radargram", *keys))})
    g = gps.withColumns({"k": F.row_number().over(Window.partitionBy(*keys, "second").orderBy("index_gps")), "_gps": F.count("*").over(Window.partitionBy(*keys, "second"))})
    repeats = gps.groupBy(*keys, "second").agg(F.count("*").alias("_gps"))
    r = r.join(repeats, [*keys, "second"], "left")
    late = (F.col("second") == F.col("_first")) & (F.col("_same") == 1) & (F.coalesce("_gps", F.lit(0)) > 1)
    r = r.withColumn("k", F.col("k") + late.cast("int")).drop("_gps")
    out = r.join(g.drop("_gps"), [*keys, "second", "k"], "left")
    return out.withColumns({"lat": F.coalesce("lat", F.lit(0.0)), "lon": F.coalesce("lon", F.lit(0.0))}).drop("k", "_same", "_first")


def limited(radar: DataFrame, limits: DataFrame) -> DataFrame:
    """Cuts damaged radargrams to their valid leading traces. ``limits``: radargram, n."""
    return radar.join(limits, "radargram", "left").where("n is null or index_vector < n").drop("n")


def quality(rows: DataFrame) -> DataFrame:
    """Per radargram: whether first and last second have a position, how many of the first and last 3
    have, and the share of located rows."""
    w, v = Window.partitionBy("radargram").orderBy("index_vector"), Window.partitionBy("radargram").orderBy(F.desc("index_vector"))
    r = rows.withColumns({"_a": F.row_number().over(w), "_b": F.row_number().over(v), "_ok": F.col("index_gps").isNotNull()})
    hit = lambda c: F.count_if(c & F.col("_ok"))
    return r.groupBy("radargram").agg(
        hit(F.col("_a") == 1).alias("first_match"), hit(F.col("_b") == 1).alias("last_match"), hit(F.col("_a") <= 3).alias("first_3"), hit(F.col("_b") <= 3).alias("last_3"),
        F.count("*").alias("n_rows"), F.count_if("_ok").alias("n_matched"), (F.count_if("_ok") == F.count("*")).alias("length_match"),
    )


def outline_traces(points: DataFrame, width: int) -> DataFrame:
    """(track, outline, trace, code): each outline's columns rounded half to even, each once.

    Where an outline's largest column is past the edge (``width`` or more), that column alone is left
    out, an artefact of picking by eye. Missing columns and unknown colour words are dropped.
    ``points``: track, outline, xcoord, colour.
    """
    word = F.substring("colour", 1, 3)
    code = F.coalesce(*[F.when(word == w, F.lit(k)) for w, k in COLOURS.items()])
    rows = points.select("track", "outline", F.bround(F.nanvl("xcoord", F.lit(None).cast("double"))).cast("long").alias("trace"), code.alias("code"))
    rows = rows.where("trace is not null and code is not null").distinct()
    last = F.max("trace").over(Window.partitionBy("track", "outline"))
    return rows.withColumn("_last", last).where((F.col("trace") < width) | (F.col("trace") < F.col("_last"))).drop("_last")


def confident(points: DataFrame) -> DataFrame:
    return points.where("code = 1")


def candidates(radar: DataFrame, names: DataFrame) -> DataFrame:
    """Radargrams on the candidate list."""
    return radar.join(names.select("radargram"), "radargram", "left_semi")
