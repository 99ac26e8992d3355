"""Positions of regular-expression matches with DataFrame functions only.

Spark's functions return matches without their places, so matches are marked in the text, which is
then cut at the marks: a match starts after all gaps and matches before it, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

#: What counts as context: the two words before a match, read from its end, and the word behind it, whole
#: however long, with the white space between.
BEFORE, AFTER = r"^\s*+\S*+(?:\s++\S++)?", r"^\s*+\S*+"
NO_HITS = "array<struct<gap:int,found:string>>"
NO_HITS_IN_CONTEXT = "array<struct<gap:int,found:string,before:string,after:string>>"
#: The mark: no character, so that texts rarely have it; those that do are cut in another way.
MARK = "\ufdd0"
_CUT = "_cut_"


def _cut(text: Column, regex: str, guard: Column | None) -> Column:
    """What lies between the matches and the matches, by turns; null without a match."""
    marked = F.split(F.regexp_replace(text, F.lit(f"({regex})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1)
    pairs = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda gap, found: F.array(gap, found))
    test = text.rlike(regex) if guard is None else guard & text.rlike(regex)
    return F.when(test, F.when(F.contains(text, F.lit(MARK)), F.array_compact(F.flatten(pairs))).otherwise(marked))


def with_hits(rows: DataFrame, text: str, finds: dict[str, str], guards: dict[str, Column] | None = None, context: bool = False, when: dict[str, Column] | None = None) -> DataFrame:
    """Adds a column per regex of ``finds``: the array of (gap, found) of all matches in the column
    ``text``, leftmost and non-overlapping. gap: code points since the last match. With ``context``
    also the words just before and after the match. The column ``text`` must have no nulls.

    No regex may match the empty string or have capturing groups. ``guards``: cheaper tests that hold
    for every text with a match; ``when``: where a regex is looked for at all. The texts are cut in a
    step of their own, which the lambdas below use several times, so each regex runs once.
    """
    tests = {k: [x for x in ((guards or {}).get(k), (when or {}).get(k)) if x is not None] for k in finds}
    cut = rows.withColumns({_CUT + k: _cut(F.col(text), regex, None if not tests[k] else tests[k][0] if len(tests[k]) == 1 else tests[k][0] & tests[k][1]) for k, regex in finds.items()})

    def hits(k: str) -> Column:
        parts = F.col(_CUT + k)
        at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        own = lambda i: [F.length(F.get(parts, i - 1)).alias("gap"), F.get(parts, i).alias("found")]
        back = lambda x: F.reverse(F.regexp_extract(F.reverse(x), BEFORE, 0))
        near = lambda i: [back(F.concat(at(i - 2), at(i - 1))).alias("before"), F.regexp_extract(F.concat(at(i + 1), at(i + 2)), AFTER, 0).alias("after")]
        each = F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(*own(i), *(near(i) if context else [])))
        return F.when(F.size(parts) > 1, each).otherwise(F.array().cast(NO_HITS_IN_CONTEXT if context else NO_HITS))

    return cut.withColumns({k: hits(k) for k in finds}).drop(*[_CUT + k for k in finds])


def placed(rows: DataFrame, keys: list[str], kinds: list[str], context: bool = False) -> DataFrame:
    """keys, kind, start, end, found for every hit in the columns named ``kinds``; keys are unique.

    Only matches are shuffled, by row and kind.
    """
    also = ["before", "after"] if context else []

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("_i"), *[x[n].alias(n) for n in ["gap", "found", *also]]))

    each = [tagged(kind) for kind in kinds]
    out = rows.select(*keys, F.explode(F.concat(*each)).alias("_hit")).select(*keys, "_hit.*")
    upto = Window.partitionBy(*keys, "kind").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(upto)).select(
        *keys, "kind", (F.col("end") - F.length("found")).alias("start"), "end", "found", *also
    )


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
