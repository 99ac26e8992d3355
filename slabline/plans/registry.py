"""How queries are registered: a function of the stand-in views, and SQL over the same views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Inputs:
    """The views and tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return standins.view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def folder(self, name: str) -> str:
        """A new folder that driver and executors share; removed when the session's JVM ends."""
        base = self.spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not self.spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="slabline-")
        at = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        return at


def query(name: str, sql: str | None = None):
    """Registers a function of Inputs; sql is over the views' names."""

    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = standins.with_views(sql)
        return f

    return add


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, so that the order of sums does not show; also no negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
