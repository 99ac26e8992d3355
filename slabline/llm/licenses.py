"""License scans by a positional index of rare license words, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c


@dataclass(frozen=True)
class Template:
    """words: consecutive words of a license notice, * for any word; key: the phrase in it that a
    match must hold in full."""

    label: str
    words: str
    key: str
    base: bool = False

    @property
    def terms(self) -> list[tuple[int, str]]:
        return [(i, w) for i, w in enumerate(self.words.split()) if w != "*"]

    @property
    def key_at(self) -> int:
        """Where the key phrase starts."""
        words, key = self.words.split(), self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: The contract's phrases, in their usual notices, and further well-known ones.
TEMPLATES = (
    Template("mit", "released under * mit license", "mit license", base=True),
    Template("apache", "licensed under * apache license version 2 0", "apache license", base=True),
    Template("gpl", "licensed under * gnu general public license version 3", "general public license", base=True),
    Template("mit", "permission * hereby granted free * charge", "hereby granted"),
    Template("agpl", "gnu affero general public license version 3", "affero general public license"),
    Template("lgpl", "gnu lesser general public license version 3", "lesser general public license"),
    Template("bsd", "redistribution * use * source * binary forms", "binary forms"),
    Template("bsd", "licensed under * bsd license", "bsd license"),
    Template("mpl", "mozilla public license version 2 0", "mozilla public license"),
    Template("epl", "eclipse public license version 2 0", "eclipse public license"),
    Template("cc", "licensed under * creative commons attribution", "creative commons"),
    Template("isc", "licensed under * isc license", "isc license"),
    Template("unlicense", "free * unencumbered software released", "unencumbered software"),
    Template("reserved", "all rights reserved", "rights reserved"),
)
#: The Kelvin sign is the one other letter that lower-cases to a letter of A-Z.
KELVIN = chr(0x212A)
#: Words after A-Z are lower-cased, and the same before.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def postings(docs: DataFrame, vocabulary: list[str], scratch: c.Scratch, carry: tuple[str, ...], text: str = "text") -> DataFrame:
    """A written table: the columns carry, n_words, and hits: (pos, term) of every word of the whole
    text that is in the vocabulary, by position; term is its number there, from 1."""
    low = F.lower(F.replace(c.text_or_empty(text), F.lit(KELVIN), F.lit(chr(0xFFFD))))
    rows = docs.select(*[F.col(x).alias(f"_{x}") for x in carry], F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)).alias("_words"))
    known = F.array(*[F.lit(w) for w in vocabulary])
    places = F.when(F.size("_words") > 0, F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get("_words", i).isin(vocabulary)))
    rows = rows.withColumn("_places", F.coalesce(places, F.array().cast("array<int>")))
    hit = F.transform("_places", lambda i: F.struct(i.alias("pos"), F.array_position(known, F.get("_words", i)).cast("int").alias("term")))
    return scratch.keep(rows.select(*[f"_{x}" for x in carry], F.size("_words").cast("long").alias("n_words"), hit.alias("hits")), "postings")


def rarities(indexed: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each word of the vocabulary over all rows."""
    total = indexed.count()
    seen = indexed.select(F.explode(F.array_distinct("hits.term")).alias("term")).groupBy("term").count()
    df = {vocabulary[term - 1]: n for term, n in seen.collect()}  # one row per word of the vocabulary
    return {w: 1 + math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def found_places(hits: Column, template: Template, vocabulary: list[str], idf: dict[str, float]) -> Column:
    """array of (start, score) of all places of the template's key phrase.

    The highest-IDF word of the key is looked up; the key's other words have to stand at their
    relative positions, next to it among the hits. score: the share of the template's IDF that stands
    at its relative position.
    """
    key, term = template.key.split(), {w: i + 1 for i, w in enumerate(vocabulary)}
    rare = max(range(len(key)), key=lambda i: (idf[key[i]], -i))

    def whole(j: Column) -> Column:
        at, ok = F.get(hits, j), F.lit(True)
        for i, word in enumerate(key):
            x = F.get(hits, j + F.lit(i - rare))
            ok = ok & F.coalesce((x["term"] == term[word]) & (x["pos"] == at["pos"] + F.lit(i - rare)), F.lit(False))
        return (at["term"] == term[key[rare]]) & ok

    reach = len(template.words.split())  # at most so many hits lie between a word and the key

    def place(j: Column) -> Column:
        start = F.get(hits, j)["pos"] - F.lit(rare)
        near = F.slice(hits, F.greatest(j + 1 - F.lit(reach), F.lit(1)), F.lit(2 * reach + 1))
        got = F.lit(0.0)
        for i, word in template.terms:
            there = _stands(near, term[word], start + F.lit(i - template.key_at))
            got = got + F.when(there, F.lit(idf[word])).otherwise(F.lit(0.0))
        return F.struct(start.cast("long").alias("start"), F.round(got / F.lit(sum(idf[w] for _, w in template.terms)), 6).alias("score"))

    anchors = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), whole)
    return F.when(F.size(hits) >= len(key), F.transform(anchors, place)).otherwise(F.array().cast("array<struct<start:bigint,score:double>>"))


def _stands(near: Column, term: int, pos: Column) -> Column:
    return F.exists(near, lambda x: (x["term"] == term) & (x["pos"] == pos))


def license_places(docs: DataFrame, scratch: c.Scratch, carry: tuple[str, ...] = ("doc_id",), text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of docs: the columns carry, n_words, and places: an array of (label, base,
    start, score), word positions from 0.

    Null texts count as empty; null ids and repeated rows are rows like any others. Only the columns
    carry are kept.
    """
    vocabulary = sorted({w for t in templates for _, w in t.terms})
    indexed = postings(docs, vocabulary, scratch, carry, text)
    idf = rarities(indexed, vocabulary)
    each = []
    for t in templates:
        each.append(F.transform(found_places(F.col("hits"), t, vocabulary, idf), _labelled(t)))
    return indexed.select(*[F.col(f"_{x}").alias(x) for x in carry], "n_words", F.concat(*each).alias("places"))


def _labelled(t: Template):
    return lambda x: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), x["start"].alias("start"), x["score"].alias("score"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every row of documents; score: the best matched place's, 0 without any."""
    found = license_places(c.read_columns(spark, sf_dir, "documents", "doc_id", "text"), c.Scratch(spark))
    base = F.filter("places", lambda x: x["base"])

    def labels(places: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))))

    starts = F.transform(base, lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def op2_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The query as joins of word positions with the templates' terms."""
    terms = [
        f"({n}, '{t.label}', {t.base}, {len(t.key.split())}, {t.key_at}, {i}, '{w}', {t.key_at <= i < t.key_at + len(t.key.split())})"
        for n, t in enumerate(templates)
        for i, w in t.terms
    ]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH k(t, label, base, n_key, key_at, off, word, in_key) AS (VALUES {", ".join(terms)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
h AS (SELECT * FROM w WHERE word IN (SELECT word FROM k)),
f AS (SELECT v.word, 1 + ln(((SELECT count(*) FROM d) + 1) / CAST(count(DISTINCT h.doc_id) + 1 AS DOUBLE)) AS idf FROM (SELECT DISTINCT word FROM k) AS v LEFT JOIN h ON h.word = v.word GROUP BY v.word),
p AS (SELECT h.doc_id, k.t, k.label, k.base, k.key_at, h.pos - k.off + k.key_at AS start FROM h JOIN k ON k.word = h.word AND k.in_key GROUP BY h.doc_id, k.t, k.label, k.base, k.key_at, k.n_key, h.pos - k.off + k.key_at HAVING count(*) = k.n_key),
g AS (SELECT k.t, sum(f.idf) AS total FROM k JOIN f ON f.word = k.word GROUP BY k.t),
s AS (SELECT p.doc_id, p.t, p.start, round(sum(f.idf) / min(g.total), 6) AS score FROM p JOIN k ON k.t = p.t JOIN h ON h.doc_id = p.doc_id AND h.word = k.word AND h.pos = p.start + k.off - k.key_at JOIN f ON f.word = k.word JOIN g ON g.t = p.t GROUP BY p.doc_id, p.t, p.start),
b AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(CASE WHEN base THEN start END) AS first_word, max(CASE WHEN base THEN start END) AS last_word,
  string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id),
m AS (SELECT doc_id, max(score) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
