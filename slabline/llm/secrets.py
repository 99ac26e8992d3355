"""Secret scans through a trigram inverted index, with DataFrame functions only."""

from __future__ import annotations

import re
import re._constants as k
import re._parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from . import _spans


@dataclass(frozen=True)
class Rule:
    """find: a regular expression in the syntax that Java and Python share; a match counts if its
    whole, or ``part`` of it, has at least ``least`` code points."""

    name: str
    find: str
    least: int = 1
    part: str = ""


#: The contract's rules.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""", 6, r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""),
    Rule("access", r"AKIA[A-Z0-9]++", 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
)
#: Published formats of further secrets.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("pem", r"-----BEGIN\x20(?:[A-Z]++\x20)*PRIVATE\x20KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}+"),
)
RULES = BASE + MORE
#: Alternatives a rule's query may have.
ALTERNATIVES = 64


def _strings(node) -> set[str] | None:
    """All strings that one parsed item can match, lower-cased, or None where they are too many."""
    op, arg = node
    if op is k.LITERAL:
        return {chr(arg).lower()}
    if op is k.IN:
        chars = [chr(x).lower() for what, a in arg if what is not k.NEGATE for x in ([a] if what is k.LITERAL else range(a[0], a[1] + 1) if what is k.RANGE else [])]
        plain = all(what in (k.LITERAL, k.RANGE) for what, _ in arg)
        return set(chars) if plain and len(set(chars)) <= 8 else None
    if op is k.SUBPATTERN:
        return _all_strings(arg[-1])
    if op is k.BRANCH:
        parts = [_all_strings(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT) and arg[1] <= 1:
        of = _all_strings(arg[2])
        return None if of is None else of | ({""} if arg[0] == 0 else set())
    return {""} if op in (k.AT, k.ASSERT, k.ASSERT_NOT) else None


def _all_strings(items) -> set[str] | None:
    out = {""}
    for item in items:
        of = _strings(item)
        if of is None or len(out) * len(of) > ALTERNATIVES:
            return None
        out = {a + b for a, b in product(out, of)}
    return out


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives of trigrams: a text with a match, lower-cased, has all trigrams of one of them.

    A regular expression is a sequence of items. Each run of items with few possible strings must
    occur; the trigrams of its strings are one OR of ANDs. The runs' queries are multiplied out while
    they stay small. No alternatives at all: no trigram is mandatory.
    """
    runs, run = [], {""}
    for item in [*re._parser.parse(regex), (k.ANY, None)]:
        of = _strings(item)
        if of is not None and len(run) * len(of) <= ALTERNATIVES:
            run = {a + b for a, b in product(run, of)}
        else:
            runs.append(run)
            run = of or {""}
    query = [frozenset()]
    for run in runs:
        of = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if all(of) and len(query) * len(of) <= ALTERNATIVES:
            query = [a | b for a, b in product(query, of)]
    query = set(query)
    return [] if frozenset() in query else sorted((a for a in query if not any(b < a for b in query)), key=sorted)


def any_of(trigrams: list[str]) -> str:
    """A regular expression that finds every place where one of the trigrams begins, as its group 1.

    Trigrams that begin alike share a branch, and places where none begins fail at once.
    """
    quote = lambda s: re.sub(r"([^\w\s])", r"\\\1", s)
    by: dict[str, dict[str, list[str]]] = {}
    for t in sorted(trigrams):
        by.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    second = lambda of: "|".join(f"{quote(b)}[{''.join(map(quote, c))}]" for b, c in of.items())
    heads = "".join(map(quote, by))
    return f"(?=[{heads}])(?=({'|'.join(f'{quote(a)}(?:{second(of)})' for a, of in by.items())}))"


def index(docs: DataFrame, trigrams: list[str], scans: tuple[Rule, ...], scratch: c.Scratch, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table with one row per row of docs: _row, its id and text, the distinct trigrams of
    ``trigrams`` that it has, found in one pass, and the hits of the rules that scan every text."""
    rows = docs.select(F.col(id_col).alias("_id"), c.text_or_empty(text).alias("_text"))
    grams = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(any_of(trigrams)), F.lit(1))) if trigrams else F.array().cast("array<string>")
    return c.numbered(_spans.with_hits(rows.withColumn("_grams", grams), "_text", {r.name: r.find for r in scans}), scratch)


def candidates(indexed: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(_row, _rules): rows whose postings satisfy a rule's query.

    The posting lists (trigram, row) meet the terms of the queries; an alternative holds for the rows
    where as many of its terms meet as it has. The terms are a fixed table of a few hundred rows.
    """
    terms = [(t, f"{rule}/{n}", rule, len(alt)) for rule, alts in queries.items() for n, alt in enumerate(alts) for t in alt]
    terms = indexed.sparkSession.createDataFrame(terms, "_gram string, _alt string, _rule string, _all int")
    postings = indexed.select("_row", F.explode("_grams").alias("_gram"))
    met = postings.join(F.broadcast(terms), "_gram").groupBy("_row", "_rule", "_alt").agg(F.count("*").alias("_n"), F.first("_all").alias("_all"))
    return met.where("_n = _all").groupBy("_row").agg(F.collect_set("_rule").alias("_rules"))


def secret_spans(docs: DataFrame, scratch: c.Scratch, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, and spans, an array of (kind, start, end, found) by start, then in
    the order of rules. Places are code points, the end is exclusive.

    Null texts count as empty; null ids and repeated rows are rows of their own. Other columns are
    ignored. Matches are leftmost and non-overlapping per rule; one that fails its rule's length is
    dropped, and the search goes on after it.
    """
    queries = {r.name: q for r in rules if (q := trigram_query(r.find))}
    trigrams = sorted({t for q in queries.values() for alt in q for t in alt})
    scans, looked_up = tuple(r for r in rules if r.name not in queries), [r for r in rules if r.name in queries]
    indexed = index(docs, trigrams, scans, scratch, id_col, text)
    spans = None
    if looked_up:
        found = scratch.keep(candidates(indexed, queries), "candidates")
        held = c.matching(indexed.select("_row", "_text"), found, "_row")
        verified = _spans.with_hits(held, "_text", {r.name: r.find for r in looked_up}, when={r.name: F.array_contains("_rules", r.name) for r in looked_up})
    for part, names in ((verified if looked_up else None, [r.name for r in looked_up]), (indexed, [r.name for r in scans])):
        if names:
            got = _spans.placed(part.where(" or ".join(f"size({n}) > 0" for n in names)), ["_row"], names)
            spans = got if spans is None else spans.unionByName(got)
    counted, rank = F.lit(False), F.lit(len(rules))
    for i, r in enumerate(rules):
        what = F.regexp_extract("found", r.part, 1) if r.part else F.col("found")
        counted = F.when(F.col("kind") == r.name, F.length(what) >= r.least).otherwise(counted)
        rank = F.when(F.col("kind") == r.name, F.lit(i)).otherwise(rank)
    spans = spans.where(counted).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "found"))).alias("_spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,found:string>>")
    tidy = F.transform(F.coalesce("_spans", none), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))
    return indexed.select("_row", "_id").join(spans, "_row", "left").select(F.col("_id").alias(id_col), tidy.alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every row of documents."""
    docs = c.read_columns(spark, sf_dir, "documents", "doc_id", "text")
    found = secret_spans(docs, c.Scratch(spark))
    base = F.filter("spans", lambda x: x["kind"].isin([r.name for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.name).alias(f"n_{r.name}") for r in BASE], F.sha2(_spans.joined(base), 256).alias("base_sha256"), _spans.joined(F.col("spans")).alias("spans"))


def op10_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The query with matches placed by window sums over what lies between them."""
    parts = []
    for rank, r in enumerate(rules):
        # the other engine's syntax has no possessive repeats and no look-behind; runs are maximal anyway
        find = r.find.replace("(?<![0-9a-f])[0-9a-f]{24,}+", "[0-9a-f]+").replace("++", "+").replace("}+", "}").replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{r.name}' AS kind, {rank} AS rank, i, found, gap FROM (SELECT doc_id, unnest(m) AS found, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS i"
            f" FROM (SELECT doc_id, regexp_extract_all(t, '{find}') AS m, string_split_regex(t, '{find}') AS g FROM d) AS x) AS y"
        )
    ok = []
    for r in rules:
        part = r.part.replace("'", "''")
        what = f"regexp_extract(found, '{part}', 1)" if r.part else "found"
        ok.append(f"(kind = '{r.name}' AND length({what}) >= {24 if r.name == 'hex' else r.least})")
    base = ", ".join(f"'{r.name}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.name}') AS n_{r.name}" for r in BASE)
    shown = "kind || ':' || CAST(e - length(found) AS STRING) || ':' || CAST(e AS STRING)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({" UNION ALL ".join(parts)}),
p AS (SELECT doc_id, kind, rank, found, CAST(sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS e FROM a),
s AS (SELECT *, {shown} AS span, e - length(found) AS start FROM p WHERE {' OR '.join(ok)}),
g AS (SELECT doc_id, {counts}, string_agg(CASE WHEN kind IN ({base}) THEN span END, ',' ORDER BY start, rank) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
