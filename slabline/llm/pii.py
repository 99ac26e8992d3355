"""Personal data: fixed patterns plus bootstrapped contextual extraction, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c
from . import _spans

#: The contract's kinds in its order. A run of the first class is entered at its start,
#: or where the last match ended, so that no text takes quadratic time; possessive repeats give back
#: nothing that a match could need.
FIND = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IN = r"\p{L}\p{N}@._%+()-"
#: What could be an identifier: short groups of digits, or a word with a digit or an at sign.
CANDIDATE = rf"(?<![{_IN}])(?:\+?\(?[0-9]{{1,5}}\)?(?:[\x20.-]\(?[0-9]{{1,5}}\)?)++(?![\p{{L}}\p{{N}}@_%+(])|(?=[\p{{L}}._%+()-]*+[0-9@])[{_IN}]++)"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Prefix of the kinds that the method adds, and the kind of what can be no identifier.
ADDED, NONE = "ctx_", "none"
#: Defaults of the bootstrapping: distinct instances that a pattern needs; confidence from which a
#: pattern speaks for its instances, and score from which an instance is reported.
SUPPORT, CONFIDENT, REPORTED = 3, 0.8, 0.9
#: How much a candidate that is known to be none counts against a kind: the share of random numbers
#: that the kind's check lets pass, as the candidates in question have passed it.
AGAINST = {"email": 1.0, "ip": 1.0, "card": 0.1, "phone": 1.0}


def valid(kind: Column, found: Column) -> Column:
    """Whether a match passes its kind's check."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    size = F.length(digits)
    card = F.when(size.between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return (
        F.when(kind == "email", found.rlike(r"(?i)@|(?<!\p{L})at(?!\p{L})"))
        .when(kind == "ip", found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", card)
        .when(kind == "phone", size.between(9, 15) & ~found.rlike(r"[\p{L}@]"))
        .otherwise(True)
    )


def scanned(docs: DataFrame, scratch: c.Scratch, id_col: str, text: str) -> DataFrame:
    """A written table: _row, the id, and every kind's hits in context, of every row's whole text."""
    rows = docs.select(F.col(id_col).alias("_id"), c.text_or_empty(text).alias("_text"))
    whole = F.col("_text")
    digit, at = whole.rlike("[0-9]"), F.contains(whole, F.lit("@"))
    guards = {"email": at, "ip": digit, "card": digit, "phone": F.contains(whole, F.lit("+")), "candidate": digit | at}
    return c.numbered(_spans.with_hits(rows, "_text", FIND | {"candidate": CANDIDATE}, guards, context=True).drop("_text"), scratch)


def trimmed(spans: DataFrame) -> DataFrame:
    """Candidates without the punctuation and blanks around them, which become context."""
    lead, trail = F.regexp_extract("found", r"^[\x20._%)-]*", 0), F.regexp_extract("found", r"[\x20._%+(-]*$", 0)
    cut = spans.withColumns({"_a": F.length(lead), "_b": F.length(trail)})
    core = F.expr("substring(found, _a + 1, length(found) - _a - _b)")
    cut = cut.withColumns({"before": F.concat("before", F.expr("substring(found, 1, _a)")), "after": F.concat(F.expr("right(found, _b)"), F.col("after")), "found": core, "start": F.col("start") + F.col("_a"), "end": F.col("end") - F.col("_b")})
    return cut.where("start < end").drop("_a", "_b")


def apart(spans: DataFrame) -> DataFrame:
    """What the base spans of a row leave of its candidates, each piece with its context.

    Candidates don't overlap each other, and base spans that do are united, so each union that starts
    in a candidate has one to which it belongs; one that reaches into a candidate moves its start.
    Both are told by windows over a row's spans, and a candidate meets its own unions only.
    """
    row = Window.partitionBy("_row").orderBy("start", "end")
    upto = row.rowsBetween(Window.unboundedPreceding, -1)
    base = spans.where("kind <> 'candidate'").select("_row", "start", "end")
    base = base.withColumn("_new", F.when(F.max("end").over(upto) >= F.col("start"), 0).otherwise(1))
    base = base.withColumn("_n", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_row", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    candidates = spans.where("kind = 'candidate'").drop("kind")
    # at the same place a candidate comes before the union that belongs to it
    events = candidates.select("_row", "start", "end", F.lit(0).alias("_base")).unionByName(base.select("_row", "start", "end", F.lit(1).alias("_base")))
    before = Window.partitionBy("_row").orderBy("start", "_base").rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("_base") == 1
    events = events.withColumns({"_host": F.last(F.when(~is_base, F.struct("start", "end")), True).over(before), "_from": F.max(F.when(is_base, F.col("end"))).over(before)})
    cuts = events.where(is_base & (F.col("_host.end") > F.col("start"))).groupBy("_row", F.col("_host.start").alias("start")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("_cuts"))
    begins = events.where(~is_base).select("_row", "start", "_from")
    rows = candidates.join(begins, ["_row", "start"]).join(cuts, ["_row", "start"], "left")
    begin = F.greatest("start", F.coalesce("_from", "start"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    held = F.coalesce("_cuts", none)
    starts, ends = F.concat(F.array(begin), F.transform(held, lambda x: x["e"])), F.concat(F.transform(held, lambda x: x["s"]), F.array("end"))
    pieces = rows.select("_row", "start", "found", "before", "after", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("_p")).where("_p.s < _p.e")
    part = pieces.withColumns({"_a": (F.col("_p.s") - F.col("start")).cast("int"), "_b": (F.col("_p.e") - F.col("start")).cast("int")})
    return part.select(
        "_row", F.lit("candidate").alias("kind"), F.col("_p.s").alias("start"), F.col("_p.e").alias("end"),
        F.expr("substring(found, _a + 1, _b - _a)").alias("found"), F.expr("concat(before, substring(found, 1, _a))").alias("before"), F.expr("concat(substring(found, _b + 1), after)").alias("after"),
    )


def _patterns() -> Column:
    """The lexical patterns of a span, from one word beside it to its shape alone.

    A shape keeps punctuation and writes runs of letters, of digits and of nine or more digits as one
    sign each; a long one is told by its digest. A class says how the word beside is written, or that the line ends there.
    """
    shape = F.col("found")
    for of, sign in ((r"\p{L}+", "a"), (r"[0-9]{9,}", "N"), (r"[0-9]+", "9")):
        shape = F.regexp_replace(shape, of, sign)
    shape = F.when(F.length(shape) > 40, F.concat(F.lit("~"), F.sha2(shape, 256))).otherwise(shape)
    left, right = F.lower(F.regexp_extract("before", r"(\S+)\s*$", 1)), F.lower(F.regexp_extract("after", r"^\s*(\S+)", 1))
    two = F.lower(F.regexp_extract("before", r"(\S+\s+\S+)\s*$", 1))

    def kind_of(side: str, edge: str, word: str) -> Column:
        near = F.regexp_extract(side, word, 1)
        found = F.when(F.col(side).rlike(edge), "^").when(near.rlike(r"[0-9@]"), "9").when(near.rlike(r"[.:!?]$"), ".").when(near.rlike(r"^\p{Lu}"), "A")
        return found.when(near.rlike(r"^\p{L}"), "a").otherwise("*")

    classes = kind_of("before", r"(?:^|[\r\n])[\x20\t]*$", r"(\S+)\s*$"), kind_of("after", r"^[\x20\t]*(?:$|[\r\n])", r"^\s*(\S+)")
    bar = F.lit("\n")
    return F.array(
        F.when(left != "", F.concat(F.lit("<"), left, bar, shape)),
        F.when(right != "", F.concat(F.lit(">"), right, bar, shape)),
        F.when((left != "") & (right != ""), F.concat(F.lit("="), left, bar, right)),
        F.when(two != "", F.concat(F.lit("2"), two)),
        *[F.concat(F.lit("#"), a, bar, shape, bar, b) for a in (classes[0], F.lit("")) for b in (classes[1], F.lit(""))],
    )


def graph(spans: DataFrame, scratch: c.Scratch) -> DataFrame:
    """A written table of the distinct edges (pattern, instance) of spans."""
    edges = spans.select(F.explode(F.array_compact(_patterns())).alias("pattern"), F.lower("found").alias("instance"))
    return scratch.keep(edges.distinct(), "graph")


def bootstrapped(seeds: DataFrame, unknown: DataFrame, scratch: c.Scratch, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """A written table (instance, kind, score) of the instances in ``unknown``, seeds among them.

    Both have found, before and after, seeds also kind. Seeds have score 1; candidates that no kind's
    check lets pass are known to be none. In each round a pattern's confidence for a kind is the share
    of that kind in the scores of its known instances, one more counting against it, and none by
    AGAINST; instances whose kind is open don't count. An open instance's score for a kind whose check it passes is the
    noisy-or of the confident patterns, and never falls. Rounds go on until no score changes; scores
    have three digits, so they end. Hot patterns and instances combine before the shuffle and are
    split in the joins.
    """
    kinds = list(FIND)
    edges = graph(seeds.select("found", "before", "after").unionByName(unknown.select("found", "before", "after")), scratch)
    sure = seeds.groupBy(F.lower("found").alias("instance")).agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0))
    instances = unknown.select(F.lower("found").alias("instance")).distinct()
    passes = F.array_compact(F.array(*[F.when(valid(F.lit(k), F.col("instance")), F.lit(k)) for k in kinds]))
    checked = scratch.keep(instances.join(sure.select("instance"), "instance", "left_anti").withColumn("kinds", passes), "instances")
    none = checked.where(F.size("kinds") == 0).select("instance", F.lit(NONE).alias("kind"), F.lit(1.0).alias("score"))
    fixed = scratch.keep(sure.unionByName(none), "known")
    open_ = scratch.keep(c.join_split(edges, checked.where(F.size("kinds") > 0), ["instance"]), "open")
    found, mark = None, None
    while True:
        known = fixed if found is None else fixed.unionByName(found)
        per = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in [*kinds, NONE]]
        many = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds]
        sums = c.join_split(edges, known, ["instance"]).groupBy("pattern").agg(*per, *many)
        all_ = {k: reduce(add, [F.col(x) for x in kinds]) + AGAINST[k] * F.col(NONE) + 1 for k in kinds}
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) / all_[k]).alias("conf"), F.col(f"n_{k}").alias("n")) for k in kinds])).alias("of")
        patterns = scratch.keep(sums.select("pattern", each).select("pattern", "of.*").where((F.col("conf") >= confident) & (F.col("n") >= support)).drop("n"), "patterns")
        scored = c.join_split(open_, patterns, ["pattern"]).where(F.array_contains("kinds", F.col("kind")))
        scored = scored.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        if found is not None:
            scored = scored.unionByName(found).groupBy("instance", "kind").agg(F.max("score").alias("score"))
        best = scored.groupBy("instance").agg(F.max(F.struct(F.round("score", 3).alias("score"), "kind")).alias("best"))
        found = scratch.keep(best.select("instance", "best.kind", "best.score"), "scores")
        now = tuple(found.agg(F.count("*"), F.sum(F.xxhash64("instance", "kind", "score").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    seen = sure.join(instances, "instance", "left_semi")
    return scratch.keep(found.unionByName(seen), "scored")


def spans_of(rows: DataFrame, scratch: c.Scratch) -> tuple[DataFrame, DataFrame]:
    """Written tables of the base spans and of what they leave of the candidates, of rows of ``scanned``:
    _row, kind, start, end, found, before, after."""
    kinds = [*FIND, "candidate"]
    some = rows.where(" or ".join(f"size({k}) > 0" for k in kinds))
    spans = _spans.placed(some, ["_row"], kinds, context=True).where(valid(F.col("kind"), F.col("found")))
    spans = scratch.keep(spans, "spans")
    return spans.where("kind <> 'candidate'"), scratch.keep(trimmed(apart(spans)), "unknown")


def pii_spans(docs: DataFrame, scratch: c.Scratch, id_col: str = "doc_id", text: str = "text", support: int = SUPPORT, confident: float = CONFIDENT, reported: float = REPORTED) -> DataFrame:
    """One row per row of docs: id, and spans, an array of (kind, start, end, found) by kind as listed,
    then start. Places are code points, the end is exclusive.

    Base kinds are leftmost non-overlapping matches that pass their check. They seed the graph of
    patterns and identifiers; candidates that confident patterns, or seeds elsewhere, tell to be of a
    kind are added as ctx_ and the kind. Those never overlap base spans. Null and empty texts have no
    spans; null ids and repeated rows are rows like any others. Other columns are ignored.
    """
    rows = scanned(docs, scratch, id_col, text)
    seeds, unknown = spans_of(rows, scratch)
    scores = bootstrapped(seeds, unknown, scratch, support, confident).where(F.col("score") >= reported)
    named = scores.select("instance", F.concat(F.lit(ADDED), "kind").alias("_kind"))
    added = c.join_split(unknown.withColumn("instance", F.lower("found")), named, ["instance"])
    every = seeds.select("_row", "kind", "start", "end", "found").unionByName(added.select("_row", F.col("_kind").alias("kind"), "start", "end", "found"))
    order = F.array_position(F.array(*[F.lit(p + k) for p in ("", ADDED) for k in FIND]), F.col("kind"))
    grouped = every.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(order.alias("rank"), "start", "end", "kind", "found"))).alias("_spans"))
    out = rows.select("_row", "_id").join(grouped, "_row", "left")
    none = F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string,found:string>>")
    tidy = F.transform(F.coalesce("_spans", none), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))
    return out.select(F.col("_id").alias(id_col), tidy.alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row of documents."""
    found = pii_spans(c.read_columns(spark, sf_dir, "documents", "doc_id", "text"), c.Scratch(spark))
    base = F.filter("spans", lambda x: x["kind"].isin(list(FIND)))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in FIND], F.sha2(_spans.joined(base), 256).alias("base_sha256"), _spans.joined(F.col("spans")).alias("spans"))
