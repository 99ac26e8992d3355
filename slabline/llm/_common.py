"""What the corpus operators share: scratch tables, row numbers and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts mean it, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"
#: A word between such white space.
WORD = rf"[^{SPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster has no such fallback.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_folder, "made", None)
    if made is None:
        made = shared_folder.made = tempfile.mkdtemp(prefix="slabline-")
    return made


class Scratch:
    """Parquet tables that cut lineage, in the shared folder; they outlive a lost executor.

    ``drop`` removes one table or all. What is left is removed when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/slabline-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        self._fs().deleteOnExit(self._path(self.base))

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the written table."""
        at = f"{self.base}/{name}-{len(self.tables)}"
        df.write.parquet(at)
        self.tables.append(at)
        # the schema of df, so that an empty table can be read too
        return self.spark.read.schema(df.schema).parquet(at)

    def last(self) -> str:
        return self.tables[-1]

    def drop_since(self, mark: int, *but: str) -> None:
        """Removes what was kept after the first ``mark`` tables, but for tables of these names: what an
        operator no longer needs when its result is made of the others."""
        for at in self.tables[mark:]:
            if at.rsplit("/", 1)[1].rsplit("-", 1)[0] not in but:
                self.drop(at)

    def drop(self, *at: str) -> None:
        for path in at or list(self.tables):
            self._fs().delete(self._path(path), True)


def numbered(df: DataFrame, scratch: Scratch, name: str = "_row") -> DataFrame:
    """df as a written table with a distinct long for every row, repeated rows included."""
    return scratch.keep(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def read_columns(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Number of words between ASCII white space; null counts as no words."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def join_split(rows: DataFrame, aggregated: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins rows with what was aggregated by the same keys, so that a hot key's rows can be split.

    Aggregation leaves its result partitioned by the keys; Spark would join there, and a partition
    below an aggregation can't be split. One more key, made of the others, has both sides shuffled for
    the join alone, and adaptive execution then splits a hot key's rows over several tasks.
    """
    more = F.hash(*keys)
    return rows.withColumn("_spread", more).join(aggregated.withColumn("_spread", more), [*keys, "_spread"], how).drop("_spread")


#: Rows of a long or two that are broadcast at most: some 50 MB.
FEW = 1_000_000


def matching(rows: DataFrame, keys: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins rows with ``keys``, a written table of a long named ``key`` and at most short columns of
    bounded size. They are counted; up to FEW are broadcast, so that rows with texts stay where they
    are. More are joined by a shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, key, how)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose number is not in ``gone``, a written table of numbers; joined like ``matching``."""
    return matching(rows, gone, key, "left_anti")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each neighbour above a node to the least label around that node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return join_split(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lower neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = join_split(edges, least, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has the long columns a and b; returns (node, root), root being the least node of the
    component, for every node that has an edge to another one. Each round is a join and two
    aggregations that combine before the shuffle; a hub's rows are split by the skew join. Rounds go
    on until the set of edges stays the same, which takes a logarithmic number of them.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.keep(edges.distinct(), "edges")
    mark = None
    while True:
        at = scratch.last()
        edges = scratch.keep(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(at)
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def chained(rows: DataFrame, key: str, node: str) -> DataFrame:
    """Edges (a, b) between neighbours in each key's sorted nodes: they join the key's nodes together
    with one edge per row."""
    before = F.lag(node).over(Window.partitionBy(key).orderBy(node))
    return rows.select(F.col(node).alias("a"), before.alias("b")).where("b is not null")
