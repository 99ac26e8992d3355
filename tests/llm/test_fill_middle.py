"""Fill-in-the-middle: against a loop over tokens, odd input, and any cut of hard texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from slabline.llm import fill_middle as fm

HARD = [
    "", None, "a", "abc", "a b", " ", "\n\n", "<P>", "x <S> y", "ends with <", "ends <S", "<M", "$1 \\2 {3}", "Straße \U0001f600 é ab\U0001f600cd",
    "a\r\nb c\x00d", "word " * 40, "x" * 5000, "<<<P", "é" * 300, "A1" * 700,
]


def by_hand(doc_id, text, seed="1:", plain=10, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    told = hashlib.sha256((seed + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(told[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("plain", "spm"), [(10, 20), (0, 50), (100, 0)])
def test_same_as_by_hand(spark, plain, spm):
    rows = [(i * 20 + k, text) for i in range(12) for k, text in enumerate(HARD)] + [(None, "no id here"), (None, None), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fm.fill_in_middle(df, plain=plain, spm=spm).withColumn("back", fm.restored("output", "form")).collect()
    want = [(i, *by_hand(i, t, plain=plain, spm=spm), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert plain == 100 or {"psm", "spm"} <= {r.form for r in got}


def test_every_cut_of_a_text(spark):
    """The match takes any two numbers of units, none and all of them too."""
    text = "ab 1<\U0001f600c<"
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    df = spark.range(len(units) + 1).selectExpr("id a").crossJoin(spark.range(len(units) + 1).selectExpr("id b")).where("a + b <= " + str(len(units)))
    for spm in (False, True):
        out = fm.cut(F.lit(text), F.col("a"), F.col("b"), F.lit(spm))
        for r in df.select("a", "b", out.alias("out"), fm.restored(out, F.lit("spm" if spm else "psm")).alias("back")).collect():
            pre, mid, suf = "".join(units[: r.a]), "".join(units[r.a : r.a + r.b]), "".join(units[r.a + r.b :])
            assert r.out == (f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}")
            assert r.back == text


def test_odd_tables(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, "some words here", "x", 2, "y", 3)], "doc_id long, text string, _id string, n int, _text string, form int")
    assert tuple(fm.fill_in_middle(clash).first())[1:] == by_hand(1, "some words here")
    long = spark.createDataFrame([(7, "ab 1é " * 200_000)], "doc_id long, text string")
    assert tuple(fm.fill_in_middle(long, plain=0).first())[1:] == by_hand(7, "ab 1é " * 200_000, plain=0)
