"""Tracks, radar files and their catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Date, line and number of a file name, once normalised.
FILE = r"(\d{8})_(\d{2})_(\d{3})"


def track_parts(df: DataFrame, track: str = "track") -> DataFrame:
    """Adds year, date, line, start and end of names YYYYMMDD_LL_SSS_EEE; null where the name has another form."""
    ok = F.col(track).rlike(r"^\d{8}_\d{2}_\d{3}_\d{3}$")
    part = lambda at, n: F.when(ok, F.substring(track, at, n))
    return df.withColumns({"year": part(1, 4).cast("int"), "date": part(1, 8), "line": part(10, 2).cast("int"), "start": part(13, 3).cast("int"), "end": part(17, 3).cast("int")})


def track_files(tracks: DataFrame, track: str = "track") -> DataFrame:
    """(track, name) of every file of a track."""
    parts = track_parts(tracks.select(track), track).where("start <= end")
    number = F.explode(F.sequence("start", "end"))
    return parts.withColumn("n", number).select(track, F.concat(F.lit("Data_"), "date", F.lit("_"), F.lpad(F.col("line").cast("string"), 2, "0"), F.lit("_"), F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(".mat")).alias("name"))


def normal_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Drops the img_01_ of 2012 names."""
    return df.withColumn(name, F.regexp_replace(name, "img_01_", ""))


def file_parts(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds date, line, number and the numeric id of the flight line: date followed by line."""
    got = lambda i: F.regexp_extract(name, FILE, i)
    return df.withColumns({"date": got(1), "line": got(2).try_cast("int"), "number": got(3).try_cast("int"), "line_id": F.concat(got(1), got(2)).try_cast("long")})


def tracks_of_files(files: DataFrame) -> DataFrame:
    """Runs of consecutive file numbers of a flight line as tracks. ``files``: date, line, number."""
    line = Window.partitionBy("date", "line").orderBy("number")
    runs = files.select("date", "line", "number").distinct().withColumn("island", F.col("number") - F.row_number().over(line))
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return (
        runs.groupBy("date", "line", "island")
        .agg(F.min("number").alias("start"), F.max("number").alias("end"), F.count("*").alias("n_files"))
        .select(F.concat_ws("_", "date", pad("line", 2), pad("start", 3), pad("end", 3)).alias("track"), "n_files")
    )


def file_ids(files: DataFrame) -> DataFrame:
    """Numbers the files of each flight line from 1, in file order."""
    return files.withColumn("file_id", F.row_number().over(Window.partitionBy("date", "line").orderBy("number", "name")).cast("long"))


def trace_numbers(files: DataFrame, per_file: str = "n_traces") -> DataFrame:
    """(line_id, name, file_tracenum, flight_tracenum), from 1, for every trace of every file.

    The running number of a line starts where the files before end; only lines are windowed.
    """
    before = F.sum(per_file).over(Window.partitionBy("line_id").orderBy("number", "name").rowsBetween(Window.unboundedPreceding, -1))
    rows = files.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col(per_file) > 0)
    return rows.select("line_id", "name", F.explode(F.sequence(F.lit(1).cast("long"), F.col(per_file).cast("long"))).alias("file_tracenum"), "before").select("line_id", "name", "file_tracenum", (F.col("file_tracenum") + F.col("before")).alias("flight_tracenum"))


def coordinate_rows(files: DataFrame, arrays: list[str], optional: list[str]) -> DataFrame:
    """One row per trace of a file: its name, file_tracenum from 1, and the value of every array;
    optional columns that are missing are null."""
    have = [a for a in [*arrays, *optional] if a in files.columns]
    rows = files.select("name", F.posexplode(F.arrays_zip(*have)).alias("at", "z"))
    return rows.select("name", (F.col("at") + 1).alias("file_tracenum"), *[F.col(f"z.{a}").alias(a) if a in have else F.lit(None).cast("double").alias(a) for a in [*arrays, *optional]])


def files_of_tracks(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """(track, name): files of the track's date and line, with a number between its start and end."""
    t = track_parts(tracks.select("track")).select("track", F.col("date").alias("_d"), F.col("line").alias("_l"), "start", "end")
    return t.join(files, (F.col("_d") == F.col("date")) & (F.col("_l") == F.col("line")) & F.col("number").between(F.col("start"), F.col("end"))).select("track", "name")


def in_box(points: DataFrame, x0: float, y0: float, x1: float, y1: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points in a box, ends included; its corners may come in any order."""
    return points.where(F.col(x).between(min(x0, x1), max(x0, x1)) & F.col(y).between(min(y0, y1), max(y0, y1)))


def listed(files: DataFrame, names: DataFrame, keep: bool = True, name: str = "name") -> DataFrame:
    """Keeps the listed files, or the others."""
    return files.join(names.select(name), name, "left_semi" if keep else "left_anti")


def files_touching(points: DataFrame, inside: str, name: str = "name") -> DataFrame:
    """Files with at least one point inside an area; ``inside``: a boolean column."""
    return points.groupBy(name).agg(F.bool_or(inside).alias("hit")).where("hit").select(name)
