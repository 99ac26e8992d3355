"""The files of the survey: thickness tables, ragged lists, cutoffs, weather, flight lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THICKNESS = "Track_name string, Tracenumber int, lat double, lon double, alongtrack_distance_m double, `20m_ice_content_m` double, likelihood double"
FLIGHT_LINE = "LAT double, LON double, FRAME string"


def read_thickness(spark: SparkSession, *paths: str) -> DataFrame:
    """Thickness CSV with a header, by its fixed schema."""
    return spark.read.schema(THICKNESS).option("header", True).csv(list(paths))


def read_ragged(spark: SparkSession, *paths: str) -> DataFrame:
    """(track, tokens) of lines: a track, then any number of tokens. Empty lines are left out."""
    words = F.split(F.trim("value"), " +")
    lines = spark.read.text(list(paths)).where("trim(value) <> ''")
    return lines.select(F.get(words, F.lit(0)).alias("track"), F.slice(words, 2, F.size(words)).alias("tokens"))


def tokens(ragged: DataFrame) -> DataFrame:
    """One row per token."""
    return ragged.select("track", F.explode("tokens").alias("token"))


def read_starts(spark: SparkSession, *paths: str) -> DataFrame:
    """(track, pixel) of lines with one or two fields; pixel is null where it is missing."""
    words = F.split(F.trim("value"), "[ ,]+")
    lines = spark.read.text(list(paths)).where("trim(value) <> ''")
    return lines.select(F.get(words, F.lit(0)).alias("track"), F.get(words, F.lit(1)).try_cast("int").alias("pixel"))


def read_cutoffs(spark: SparkSession, path: str) -> DataFrame:
    """(quantile, cutoff) of a file of two rows: quantiles, then cutoffs."""
    rows = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    numbers = lambda i: F.transform(F.split(F.trim(F.get(lines, F.lit(i))), " +"), lambda x: x.cast("double"))
    return rows.select(F.explode(F.arrays_zip(numbers(0).alias("quantile"), numbers(1).alias("cutoff"))).alias("z")).select("z.*")


def read_weather(spark: SparkSession, *paths: str, missing: str = "-999") -> DataFrame:
    """CSV with semicolons and decimal commas: the named columns, numbers as doubles."""
    rows = spark.read.option("header", True).option("sep", ";").option("nullValue", missing).csv(list(paths))
    number = lambda c: F.regexp_replace(F.col(f"`{c}`"), ",", ".").try_cast("double")
    return rows.select(*[number(c).alias(c) for c in rows.columns])


def read_flight_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Yearly flight lines; FRAME stays text."""
    return spark.read.schema(FLIGHT_LINE).option("header", True).csv(list(paths))


def write_thickness(df: DataFrame, path: str, as_csv: bool = False) -> None:
    """Thickness as CSV, or as Parquet by year."""
    if as_csv:
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").partitionBy("year").parquet(path)


def write_parameters(df: DataFrame, path: str) -> None:
    """Fit parameters, one row per track."""
    df.write.mode("overwrite").option("header", True).csv(path)


def not_done(tracks: DataFrame, done: DataFrame) -> DataFrame:
    """Tracks without any row in an output."""
    return tracks.join(done.select("track").distinct(), "track", "left_anti")


def exclusion_lines(logbook: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of an exclusion list: track and fields joined by a space, null fields being empty; rows
    without a track are left out."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return logbook.where("track is not null").select(F.concat_ws(" ", "track", *fields).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_confident(points: DataFrame, path: str) -> None:
    """The confident 2002-2003 points as CSV."""
    points.where("code = 1").write.mode("overwrite").option("header", True).csv(path)

