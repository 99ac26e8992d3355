"""Exclusions by hand and by data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Beyond any trace number.
OPEN_END = 2**31 - 1
#: Track, first and last trace whose ice is not trusted.
DISTRUSTED = (("20120412_01_095_095", 0, 8999),)


def intervals(tokens: DataFrame, token: str = "token", single: bool = True) -> DataFrame:
    """Adds lo and hi of tokens -N (from the start), N- (to the end), N-M and N (one trace).

    Without ``single``, as in the porous-firn lists, a lone number and everything else unreadable is
    dropped; with it, only what is unreadable.
    """
    t = F.trim(token)
    num = lambda regex: F.regexp_extract(t, regex, 1).try_cast("long")
    lo = F.when(t.rlike(r"^-\d+$"), F.lit(0).cast("long")).when(t.rlike(r"^\d+(-\d*)?$"), num(r"^(\d+)"))
    hi = F.when(t.rlike(r"^\d+-$"), F.lit(OPEN_END).cast("long")).when(t.rlike(r"^\d*-\d+$"), num(r"-(\d+)$")).when(t.rlike(r"^\d+$"), num(r"^(\d+)$"))
    lo = lo if single else F.when(~t.rlike(r"^\d+$"), lo)
    # behind a generator, so that a token is parsed once, and after a distinct where the caller has one
    rows = tokens.withColumn("_of", F.explode(F.array(F.struct(lo.alias("lo"), hi.alias("hi")))))
    return rows.withColumns({"lo": F.col("_of.lo"), "hi": F.col("_of.hi")}).drop("_of").where("lo is not null and hi is not null")


def united(spans: DataFrame, *by: str) -> DataFrame:
    """Intervals of whole numbers as few as can be: those of one track (and one value of ``by``) that
    overlap or touch are one, both ends included, so that a trace lies in at most one. One with its ends
    swapped holds nothing and is left out."""
    keys = ["track", *by]
    before = F.max("hi").over(Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where("lo <= hi").select(*keys, "lo", "hi").withColumn("_new", F.when(before + 1 >= F.col("lo"), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def _meeting(traces: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    s = united(spans).select(F.col("track").alias("_t"), "lo", "hi")
    return traces.join(s, (F.col("track") == F.col("_t")) & F.col("trace").between(F.col("lo"), F.col("hi")), how)


def excluded(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of traces that lie in an interval of their track, both ends included. Intervals are united
    first; the join is an equi-join by track with a range condition."""
    return _meeting(traces, spans, "left_semi")


def masked_out(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of traces outside all intervals, both ends of an interval being excluded."""
    return _meeting(traces, spans, "left_anti")


def _with_hit(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Traces with _hit, whether they lie in an interval of their track, both ends included. Intervals are
    united first, so that no trace comes twice and none carries or tries a list of intervals."""
    s = united(spans).select(F.col("track").alias("_t"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    rows = traces.join(s, (F.col("track") == F.col("_t")) & F.col("trace").between(F.col("_lo"), F.col("_hi")), "left")
    return rows.withColumn("_hit", F.col("_t").isNotNull()).drop("_t", "_lo", "_hi")


def with_porous_firn(traces: DataFrame, spans: DataFrame, *values: str) -> DataFrame:
    """Sets columns (likelihood without any named) to 0 in intervals of porous firn; their end is not
    included."""
    rows = _with_hit(traces, spans.withColumn("hi", F.col("hi") - 1))
    return rows.withColumns({v: F.when(F.col("_hit"), F.lit(0.0)).otherwise(F.col(v)) for v in values or ("likelihood",)}).drop("_hit")


def complete(samples: str = "samples") -> Column:
    """True for traces without missing samples."""
    return F.forall(samples, lambda x: x.isNotNull() & ~F.isnan(x))


def restored(kept: DataFrame, every: DataFrame) -> DataFrame:
    """All traces again; those that were masked have nulls. ``every``: track, trace, ..."""
    return every.select("track", "trace").join(kept, ["track", "trace"], "left")


def exclusion_shares(traces: DataFrame, spans: DataFrame, name: str = "list") -> DataFrame:
    """Per list of intervals, the number and percentage of traces that it excludes. A list's intervals
    are united first, so a trace meets a list once and is counted where it is joined."""
    s = united(spans, name).select(F.col("track").alias("_t"), "lo", "hi", name)
    hit = traces.select("track", "trace").join(s, (F.col("track") == F.col("_t")) & F.col("trace").between(F.col("lo"), F.col("hi")))
    n = hit.groupBy(name).agg(F.count("*").alias("n_excluded"))
    total = traces.agg(F.count("*").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select(name, "n_excluded", (100 * F.col("n_excluded") / F.col("_all")).alias("percent"))  # one row is broadcast


def with_rule(traces: DataFrame, rules: tuple[tuple[str, int, int], ...] = DISTRUSTED, content: str = "content", likelihood: str = "likelihood") -> DataFrame:
    """Content 0, likelihood null and mask false in listed ranges, both ends included."""
    bad = F.lit(False)
    for track, lo, hi in rules:
        bad = bad | ((F.col("track") == track) & F.col("trace").between(lo, hi))
    return traces.withColumns({content: F.when(bad, F.lit(0.0)).otherwise(F.col(content)), likelihood: F.when(bad, F.lit(None)).otherwise(F.col(likelihood)), "mask": ~bad})


def nulled(traces: DataFrame, spans: DataFrame, *columns: str) -> DataFrame:
    """The variant in which excluded traces have null in the columns, not 0; both ends included."""
    return _with_hit(traces, spans).withColumns({c: F.when(~F.col("_hit"), F.col(c)) for c in columns}).drop("_hit")
