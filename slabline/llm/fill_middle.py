"""Fill-in-the-middle texts: one match of a pattern made for each row cuts its text in three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: A unit: a run of ASCII letters, or any other code point.
UNIT = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that stay as they are, and of the others that begin with the suffix.
PLAIN, SPM = 10, 20
#: What a row's digest is taken of, before its id.
SEED = "1:"


def draws(id_col: str, seed: str = SEED) -> list[Column]:
    """Four unsigned numbers of 32 bits from SHA-256 of the seed and the id as text; a null id is no text."""
    told = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(told, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cut(text: Column, a: Column, b: Column, spm: Column) -> Column:
    """``text`` with its first a units, the next b and the rest in the order of the form.

    The groups are possessive, so the match neither backtracks nor recurses, however long the text.
    """
    units = lambda n: F.concat(F.lit(f"((?:{UNIT}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), units(a), units(b), F.lit(r"(.*)\z"))
    order = F.when(spm, f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    return F.regexp_replace(text, pattern, order)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output of that form was made of. No text that was cut holds a mark, so the first
    of each kind is the one put in."""
    out, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    psm = F.regexp_replace(out, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(out, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """One row per row of docs: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    A text is cut after two numbers of units drawn from its id. It stays plain, and the two counts of
    code points null, if it is empty or holds one of the marks, or by lot for ``plain`` per cent; of the
    others, ``spm`` per cent have the suffix first. Null texts count as empty. Null ids draw as an empty
    id does; repeated rows are rows like any others and get equal results, as ties need no order here.
    Texts of any length are cut whole. Other columns are ignored, whatever their names. An empty table
    gives an empty result. No shuffle.
    """
    h = draws(id_col, seed)
    rows = docs.select(F.col(id_col).alias("_id"), c.text_or_empty(text).alias("_text"), *[x.alias(f"_h{i}") for i, x in enumerate(h)])
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(UNIT)).cast("long"))
    a, b = (F.col(f"_h{i}") % (F.col("n") + 1) for i in (0, 1))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("_text", F.lit(mark))
    stays = (F.col("n") == 0) | held | (F.col("_h2") % 100 >= 100 - plain)
    rows = rows.withColumn("form", F.when(stays, "plain").when(F.col("_h3") % 100 < spm, "spm").otherwise("psm"))
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(cut(F.col("_text"), F.least(a, b), F.greatest(a, b) - F.least(a, b), F.col("form") == "spm"))
    rows = rows.select("_id", "n", "form", output.alias("output"))
    at = {m: F.instr("output", m).cast("long") for m in (PREFIX, SUFFIX, MIDDLE)}
    before = F.when(F.col("form") == "psm", at[SUFFIX] - 4).when(F.col("form") == "spm", at[MIDDLE] - at[PREFIX] - 3)
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at[MIDDLE] - 2)
    return rows.select(F.col("_id").alias(id_col), "n", "form", before.alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every row of documents."""
    made = fill_in_middle(c.read_columns(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), k AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM k
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
