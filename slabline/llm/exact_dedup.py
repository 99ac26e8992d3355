"""Exact deduplication by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Code points of the first digit; each further digit is GROWTH times as long, up to WIDEST.
FIRST, GROWTH, WIDEST = 64, 4, 1 << 16


def normalised(text: str) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(c.text_or_empty(text), rf"[{c.SPACE}]+", "")


def _members(rows: DataFrame, scratch: c.Scratch) -> DataFrame:
    """(_row, _group) of all rows whose text another row has too.

    ``rows``: _row, _group (rows of different groups are known to differ), _rest, what is not compared
    yet. The texts of a group have the same length. A group is split by the next digit; rows alone in
    their part leave, and groups whose texts have ended are complete. A part is named by its smallest
    row number, so equality needs no digest. What was compared is carried no further.
    """
    done, width = [], FIRST
    while True:
        width = min(width * GROWTH, WIDEST)
        done.append(rows.where("_rest = ''").select("_row", "_group"))
        going = rows.where("_rest <> ''").select("_row", "_group", F.substring("_rest", 1, width).alias("_digit"), F.expr(f"substring(_rest, {width + 1})").alias("_rest"))
        if going.isEmpty():
            break
        parts = going.groupBy("_group", "_digit").agg(F.min("_row").alias("_part"), F.count("*").alias("_n")).where("_n > 1")
        rows = scratch.keep(c.join_split(going, parts, ["_group", "_digit"]).select("_row", F.col("_part").alias("_group"), "_rest"), "split")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _classes(docs: DataFrame, scratch: c.Scratch, id_col: str, text: str, carry: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Written tables: of all rows, _row, _id, _text, _sha and what is carried; and of those with an
    equal text, _row, _size, _keep (the id that stays) and _keep_row.

    The first digit is the length and the first code points. Only those are shuffled to find the rows
    that share one; the texts of these rows alone are fetched for the further digits.
    """
    norm, mark = normalised("_text"), len(scratch.tables)
    rows = docs.select(F.col(id_col).alias("_id"), c.text_or_empty(text).alias("_text"), *[x.alias(k) for k, x in carry.items()])
    rows = rows.withColumn("_norm", norm).select("_id", "_text", *carry, F.length("_norm").alias("_length"), F.substring("_norm", 1, FIRST).alias("_head"), F.sha2("_norm", 256).alias("_sha"))
    rows = c.numbered(rows, scratch)
    digit = rows.select("_row", "_length", "_head")
    heads = digit.groupBy("_length", "_head").agg(F.min("_row").alias("_group"), F.count("*").alias("_n")).where("_n > 1")
    open_ = scratch.keep(c.join_split(digit, heads, ["_length", "_head"]).select("_row", "_group"), "open")
    texts = c.matching(rows.select("_row", "_id", "_text"), open_, "_row").withColumn("_norm", norm)
    texts = scratch.keep(texts.select("_row", "_id", "_group", F.length("_text").alias("_long"), F.expr(f"substring(_norm, {FIRST + 1})").alias("_rest")), "texts")
    members = scratch.keep(_members(texts.select("_row", "_group", "_rest"), scratch), "members")
    best = F.struct((-F.col("_long")).alias("long"), F.col("_id").isNull().alias("none"), F.col("_id").alias("keep"), F.col("_row").alias("row"))
    sized = members.join(texts.select("_row", "_id", "_long"), "_row")
    stays = sized.groupBy("_group").agg(F.count("*").alias("_size"), F.min(best).alias("_best")).where("_size > 1")
    found = scratch.keep(c.join_split(members, stays, ["_group"]).select("_row", "_size", F.col("_best.keep").alias("_keep"), F.col("_best.row").alias("_keep_row")), "found")
    scratch.drop_since(mark, "numbered", "found")
    return rows, found


def exact_classes(docs: DataFrame, scratch: c.Scratch, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts,
    the row with the longest original text stays, then the one with the smallest id (nulls last); of
    rows that tie in both, exactly one. The digest is only reported, never compared. Other columns are
    ignored.
    """
    rows, found = _classes(docs, scratch, id_col, text, {})
    lone = F.col("_size").isNull()
    return rows.select("_row", "_id", "_sha").join(found, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.when(lone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_keep_first(docs: DataFrame, scratch: c.Scratch, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each set of equal texts left, as ``exact_classes`` says; all columns stay,
    whatever their names."""
    rest = F.struct(*[F.col(f"`{x}`") for x in docs.columns if x != text])
    rows, found = _classes(docs, scratch, id_col, text, {"_doc": rest, "_none": F.col(text).isNull()})
    gone = scratch.keep(found.where("_row <> _keep_row").select("_row"), "gone")
    original = F.when(~F.col("_none"), F.col("_text")).alias(text)
    return c.without(rows, gone, "_row").select(*[original if x == text else F.col("_doc")[x].alias(x) for x in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact-copy class of every row of documents."""
    return exact_classes(c.read_columns(spark, sf_dir, "documents", "doc_id", "text"), c.Scratch(spark))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS long,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY long DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
