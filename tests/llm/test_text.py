"""Toxicity, mixing, HTML extraction and tokenization: held-out accuracy, totals, fixtures, round trips."""

import hashlib
import random
import re
import time
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from slabline.llm import byte_bpe, html_text, mixing, toxicity
from slabline.llm._common import Scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# Toxicity.


def test_held_out_accuracy(spark, data):
    rng = np.random.default_rng(0)
    words, bad = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)], ["awful", "nasty", "vileword"]
    texts, labels = [], []
    for i in range(1200):
        t = list(rng.choice(words, 40))
        toxic = i % 6 == 0
        if toxic:
            t[int(rng.integers(40))] = str(rng.choice(bad)) + str(rng.choice(["", "ish"]))
        texts.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*texts, (5000, None), (5001, ""), (None, "awful")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (7777, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, Scratch(spark))
    got = docs.select("doc_id", toxicity.held_out().alias("h"), toxicity.score(model, "text").alias("s")).collect()
    truth = dict(labels)
    held = [(r.s >= 0.5) == bool(truth[r.doc_id]) for r in got if r.h and r.doc_id in truth]
    assert len(held) > 150 and np.mean(held) > 0.98
    assert all(0 <= r.s <= 1 for r in got) and [r.s for r in got if r.doc_id in (5000, 5001)] == [model.score("")] * 2
    clean = toxicity.keep_clean(docs.selectExpr("*", "1 as _score", "2 as _doc"), lab, Scratch(spark))
    assert clean.columns == ["doc_id", "text", "_score", "_doc"] and 950 <= clean.count() <= 1010


def sparse(x):
    return toxicity.Sparse(np.append(0, np.cumsum((x != 0).sum(axis=1))), np.nonzero(x)[1], x[x != 0].astype(float), x.shape[1])


def test_swaps_are_penalised():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 3))  # bad word, group A, group B
    y = ((x[:, 0] == 1) | ((x[:, 1] == 1) & (rng.random(400) < 0.4))).astype(float)
    change = np.zeros((400, 3))
    change[:, 1], change[:, 2] = x[:, 1] - x[:, 2], x[:, 2] - x[:, 1]
    free, fair = (toxicity.newton(sparse(x), y, sparse(change), swap=s) for s in (0.0, 50.0))
    assert abs(fair[1] - fair[2]) < 0.2 * abs(free[1] - free[2]) and fair[0] > 2


def test_newton_ends_where_the_slope_is_zero():
    """More features than rows, some without a row, equal ones: the dense gradient at the result is nothing."""
    rng = np.random.default_rng(8)
    x = (rng.random((300, 400)) < 0.05).astype(float)
    x[:, 7] = x[:, 8]
    x[:, 9] = 0
    y = (x[:, :5].sum(axis=1) + 0.3 * rng.standard_normal(300) > 0.2).astype(float)
    change = np.roll(x[:50], 1, axis=1) - x[:50]
    w = toxicity.newton(sparse(x), y, sparse(change), ridge=0.1, swap=2.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    slope = x.T @ (p - y) + 0.2 * w[:-1] + 4.0 * change.T @ (change @ w[:-1])
    assert np.abs(slope).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    a = rng.standard_normal((30, 30))
    a = a @ a.T + np.eye(30)
    assert np.allclose(toxicity.solved(lambda v: a @ v, np.ones(30), np.diag(a)), np.linalg.solve(a, np.ones(30)))


def test_rows_are_bounded_not_ids(spark):
    """Each id 20 times, and columns named like those used inside."""
    docs = spark.createDataFrame([(i, f"plain words number {'awful' if i % 4 == 0 else 'nice'}", 7, 8, "z") for i in range(60)] * 20, "doc_id long, text string, _id int, _y int, _row string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0), 3) for i in range(60)] * 2, "doc_id long, toxic int, _id int")
    seen = toxicity._sample(docs, lab, Scratch(spark), "doc_id", "text", "toxic", 20)
    assert seen.count() == 20 and seen.columns == ["_y", "_text"]
    assert all(r._y == ("awful" in r._text) for r in seen.collect())
    clean = toxicity.keep_clean(docs, lab, Scratch(spark))
    assert clean.columns == docs.columns and clean.count() == 900 and clean.where("text like '%awful%' or _id <> 7 or _row <> 'z'").count() == 0


def test_fit_with_swaps_spares_neutral_mentions(spark):
    """One group is named in most toxic rows, another in clean ones: without swaps the name itself tells."""
    rng = np.random.default_rng(5)
    words, insults = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(15) for j in range(15)], [f"{a}{b}ish" for a in "bdfgk" for b in ("arg", "olm", "unt", "ezz", "ipp", "awn")]
    texts, labels = [], []
    for i in range(1500):
        t = list(rng.choice(words, 25))
        if i % 8 == 0:
            t += ["muslims"] * (rng.random() < 0.9) + ([str(rng.choice(insults))] if rng.random() < 0.8 else [])
        elif i % 8 < 3:
            t.append("muslims" if rng.random() < 0.03 else "christians")
        texts.append((i, " ".join(t)))
        labels.append((i, int(i % 8 == 0)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [" ".join([*rng.choice(words, 25), "muslims"]) for _ in range(100)]
    insulting = [" ".join([*rng.choice(words, 25), str(rng.choice(insults))]) for _ in range(100)]
    plain, fair = (toxicity.fit(docs, lab, Scratch(spark), swap=x) for x in (0.0, toxicity.SWAP))
    false = [sum(m.score(t) >= 0.5 for t in neutral) for m in (plain, fair)]
    caught = [sum(m.score(t) >= 0.5 for t in insulting) for m in (plain, fair)]
    assert fair.swapped > 300 and false[0] >= 50 and false[1] <= 10, false
    assert caught[1] >= caught[0], caught


def test_very_long_text_is_scored():
    model = toxicity.Model(-2.0, {"awful": 4.0})
    text = "plain words " * 300_000
    assert model.score(text) == model.score("plain words") < 0.5 < model.score(text + "awful")


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for rows, want in (([], 0.5), ([(1, 1)], 2 / 3)):
        lab = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert toxicity.fit(docs, lab, Scratch(spark)).score("x") == pytest.approx(want)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.keep_clean(none, spark.createDataFrame([], "doc_id long, toxic int"), Scratch(spark)).count() == 0


# Mixing.


def brute_targets(sizes):
    """Excess reshared by weight, step by step."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mixture(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        s = ["a", "b", "c", "d", "é", None, "tiny"][min(6, int(rng.integers(0, 60) ** 0.5))]
        rows.append((i, " ".join(["w"] * int(rng.lognormal(3, 1.2))), s))
    rows += [(9000 + i, "x y", "small") for i in range(3)] + [(1, None, "a"), (1, None, "a"), (None, "p q r", "b"), (9100, "", "empty"), (9101, None, "empty")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mixed(docs, Scratch(spark), carry=True).collect()
    assert len(got) == len(rows)
    sizes, taken, target, n = {}, {}, {}, {}
    for r in got:
        s = r.doc.source
        assert r.size == len((r.doc.text or "").split()) and r.taken == r.copies * r.size <= 3 * r.size
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        n[s], target[s] = n.get(s, 0) + 1, r.target
    assert all(r.source_size == sizes[r.doc.source] for r in got)
    want = brute_targets(sizes)
    assert target == {s: pytest.approx(w) for s, w in want.items()}
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.01)
    assert all(abs(taken[s] - want[s]) <= max(0.01 * want[s], 3) for s in sizes if n[s] > 30)
    again = mixing.mixed(docs.repartition(7), Scratch(spark)).where("doc_id is not null and doc_id > 1").collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got if r.doc_id is not None and r.doc_id > 1}
    out = mixing.mixture(docs, Scratch(spark))
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_many_blocks_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    docs = spark.range(600).selectExpr("id as doc_id", "repeat('w ', cast(id % 40 as int)) as text", "cast(id % 2 as string) as source")
    got = mixing.mixed(docs, Scratch(spark)).toPandas()
    by = got.groupby("target")["taken"].sum()
    assert np.allclose(by.index, by.values, rtol=0.002)
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(none, Scratch(spark)).count() == 0 and mixing.mixture(none, Scratch(spark)).count() == 0


def test_equal_rows_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = [(1, "same words here", "b")] * 3000 + [(i, "w " * (i % 40), "a") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    units = docs.select(F.monotonically_increasing_id().alias("_row"), F.xxhash64("doc_id", "text").alias("key"))
    nth = mixing._counted(units)
    per = nth.groupBy("key").agg(F.count("*").alias("n"), F.min("nth").alias("lo"), F.max("nth").alias("hi"), F.count_distinct("nth").alias("d")).collect()
    assert {(r.n, r.lo, r.hi, r.d) for r in per} == {(3000, 1, 3000, 3000), (1, 1, 1, 1)}
    first = mixing.mixed(docs, Scratch(spark)).groupBy("doc_id", "taken").count().collect()
    again = mixing.mixed(docs.repartition(7), Scratch(spark)).groupBy("doc_id", "taken").count().collect()
    assert sorted(first) == sorted(again)


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(0, 500, 300))[::-1].astype(float)
    sums = np.zeros(300)
    for k in range(200):
        p = mixing.flight(np.full(300, 0.3), x, np.random.default_rng(k))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert p.sum() == pytest.approx(90) and p @ x == pytest.approx(0.3 * x.sum())
        sums += p
    assert abs((sums / 200)[10:-10].mean() - 0.3) < 0.01


# HTML.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, you know, to make, this site, work, for everybody.</p></div>
<div id="wrap"><div class="content"><h2>Title &amp; more</h2><p>First paragraph, with a comma, and <b>bold</b>&nbsp;text that is long enough to count.
<p>Second&#32;paragraph,   it goes on, and on, and on, with caf&eacute; and words enough.<br>New line here.
<ul><li>Item one<li>Item two</ul><blockquote>Quoted, a while, for good measure.</blockquote><table><tr><td>cell a<td>cell b</table>
<!-- <p>hidden, in, a, comment</p> --><form><p>Your name, please, here, now</p><input></form></div></div>
<aside class="sidebar"><p>Related, stories, that, are, long, enough, to, count, as, text, of, some, kind.</p></aside>
<section id="comments"><p>I think, that this, is a, comment, of a reader, who, writes, a lot, of text.</p></section>
<div class="ad">Buy this, now, please, it is, good.</div><footer>&copy; 2020, all, rights</footer></body></html>"""


def test_article_is_found():
    assert html_text.main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph, with a comma, and bold text that is long enough to count.",
        "Second paragraph, it goes on, and on, and on, with café and words enough. New line here.",
        "Item one", "Item two", "Quoted, a while, for good measure.", "cell a", "cell b",
    ]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div class='main-content with-sidebar'><p>Some, long, text, here, to, be, scored.</p></div><div class='sidebar'><p>a, b, c, d, e, f, g, h, i, j, k, l</p></div>", "Some, long, text, here, to, be, scored."),
        ("<article><div class='post-header'><h1>Title</h1></div><p class=byline>By me</p><div><p>Some, long, text, here, to, be, scored.</p></div><div class='comment-content'><p>No, no, no, no, no, no, no, no, no.</p></div><p>End.</p></article>", "Title\nBy me\nSome, long, text, here, to, be, scored.\nEnd."),
        ("<body><h1>Title</h1><div><p>Some, long, text, here, to, be, scored.</p></div><p>End.</p><ul><li><a href=x>link</a></ul></body>", "Title\nSome, long, text, here, to, be, scored.\nEnd."),
    ],
)
def test_what_stays(html, text):
    assert html_text.main_text(html) == text


LONG = "Sentences of an article, with commas, and more words than furniture has, so that they count, as they should, for the whole."


@pytest.mark.parametrize(
    "inside, kept",
    [
        ('<p title="a hidden gem">x, y</p>', True), ('<p title="see class=sidebar x">x, y</p>', True), ("<p data-note='id=comments'>x, y</p>", True), ('<p title=hidden>x, y</p>', True),
        ('<p hidden>x, y</p>', False), ('<p title="a" hidden>x, y</p>', False), ("<p class = 'sidebar'>x, y</p>", False), ('<p title="a>b" class="ad">x, y</p>', False), ('<p CLASS=ad>x, y</p>', False),
        ('<h2 id="related-work">x, y</h2>', True), ('<h2 class="related">x, y</h2>', False), ('<p class="share-price">x, y</p>', True), ('<p class="related-links"><a href="/">x, y</a></p>', False),
        (f'<section class="notice-period"><p>x, y</p><p>{LONG}</p></section>', True), (f'<div class="form"><p>x, y</p><p>{LONG}</p></div>', True), ('<div class="form">x, y</div>', False),
        (f'<div class="cookie-notice"><p>x, y</p><p>{LONG}</p></div>', False), (f'<div class="sidebar-box left"><p>x, y</p><p>{LONG}</p></div>', False), (f'<div class="related-work"><a href="/">x, y {LONG}</a> and</div>', False), ('<div class="banner">x, y</div>', False),
    ],
)
def test_furniture_by_name_and_content(inside, kept):
    text = html_text.main_text(f"<body><article><p>{LONG}</p>{inside}<p>{LONG}</p></article></body>")
    assert text.startswith(LONG) and text.endswith(LONG) and ("x, y" in text) == kept


def test_articles_of_generated_pages():
    """Pages whose article is known: its blocks come back, all of them, in order, and nothing else."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefg"), int(rng.integers(2, 8))))
    line = lambda n: " ".join(word() + ("," if rng.random() < 0.15 else "") for _ in range(n))
    odd = ["", ' title="a hidden menu"', ' id="related-work"', ' data-x="class=ad"', ' class="lead"', ' style="display:block"']
    for _ in range(60):
        blocks, html = [], []
        for _ in range(int(rng.integers(3, 12))):
            kind, text, attr = str(rng.choice(["p", "h2", "li", "blockquote", "pre"])), line(int(rng.integers(8, 60))), str(rng.choice(odd))
            blocks.append(text.strip())
            html.append(f"<ul><li{attr}>{text}</li></ul>" if kind == "li" else f"<{kind}{attr}>{text.replace(' ', ' <b>', 1)}</b></{kind}>")
            if rng.random() < 0.3:
                html.append(f'<div class="{rng.choice(["ad", "sidebar", "share-buttons", "newsletter", "comments"])}"><p>{line(12)}</p></div>')
        around = f'<nav><a href="/">{line(4)}</a></nav><header>{line(5)}</header>', f'<div id="sidebar">{line(30)}</div><form>{line(3)}</form><footer>{line(9)}</footer>'
        page = f"<html><body>{around[0]}<article>{''.join(html)}</article>{around[1]}</body></html>"
        assert html_text.main_text(page).split("\n") == [" ".join(b.split()) for b in blocks]


def test_pages_have_their_articles(spark, data):
    """Brute force on the given table: the text of each page's article element, without white space."""
    bare = lambda s: re.sub(r"\s", "", s)
    rows = html_text.op7_html_text(spark, data).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search(r"<article[^>]*>(.*)</article>", r.html, re.S)
        if article and 'class="ad"' not in article[1]:
            assert bare(r.text) == bare(unescape(re.sub(r"<[^>]*>", "", article[1])))


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("   ", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a\nb"), ("<!-- open", ""), ("<script>x", ""), ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("a < b and c > d", "a < b and c > d")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_long_page_is_whole():
    body = "".join(f"<p>Paragraph {i}, with words, and so on.</p>" for i in range(20_000))
    assert html_text.main_text(f"<body><article>{body}</article></body>").count("\n") == 19_999


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "old"), (None, None, PAGE, None), (None, None, PAGE, None)], "page_id long, url string, html string, text string")
    got = html_text.with_main_text(df)
    assert got.columns == df.columns and sorted(len(r.text) for r in got.collect()) == [0] + [len(html_text.main_text(PAGE))] * 2
    assert html_text.with_main_text(df.limit(0)).count() == 0


# Tokens.


def whole():
    return byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)


@pytest.mark.parametrize("text", ["", "a", "it's  \n\n  x", " " * 5000, "word " * 4000 + "\n\n" * 3000, "x" * 20_000, "é😀 1234 " * 2000, "<|endoftext|>", "a b　c " * 500, "\t \t x\r\n" * 900])
def test_pieces_change_nothing(text):
    want = whole().encode_ordinary(text)
    got = [i for p in byte_bpe.pieces(text, 100) for i in whole().encode_ordinary(p)]
    assert got == want and "".join(byte_bpe.pieces(text, 100)) == text
    assert byte_bpe.decode(np.array(want, np.int32), RANKS) == text.encode()


def test_encoded_rows(spark, monkeypatch):
    texts = [None, "", "héllo wörld", "a b " * 50_000, "x"]
    df = spark.createDataFrame([(i if i else None, t, 3) for i, t in enumerate(texts)] + [(4, "x", 3)], "doc_id long, text string, ids int")
    got = byte_bpe.encoded(df, RANKS, decoded=True).collect()
    assert len(got) == 6
    for r in got:
        t = texts[r.doc_id or 0] or ""
        assert r.ids == whole().encode_ordinary(t) and bytes(r.bytes) == t.encode()
    d = byte_bpe.digests(df, RANKS).where("doc_id = 2").first()
    ids = whole().encode_ordinary(texts[2])
    assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[2].encode()).hexdigest())
    assert byte_bpe.digests(df.limit(0), RANKS).count() == 0
    assert isinstance(whole(), tiktoken.Encoding)


@pytest.mark.parametrize("text", [" " * 10**7, "a" + "\n" * 10**6 + "b c", ("x" + " " * 5000) * 200, "\x1c\x1d" * 40_000, "\u3000" * 10**6 + "é"], ids=range(5))
def test_long_white_space_is_encoded(text):
    ids = byte_bpe.encode(text, RANKS)
    assert byte_bpe.decode(ids, RANKS) == text.encode()


def test_white_space_runs_as_without_cuts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE", 40)
    monkeypatch.setattr(byte_bpe, "LONG", re.compile(byte_bpe.LONG.pattern.replace("4096", "5")))
    whole, rng = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab1é!'s \n\t\u3000\x1c\x85") if rng.random() < 0.7 else rng.choice(" \n") * rng.randint(1, 15) for _ in range(rng.randint(0, 90)))
        assert byte_bpe.encode(text, RANKS).tolist() == whole.encode_ordinary(text), repr(text)


K = 1 << 17


@pytest.mark.parametrize(
    "page",
    ["<a " * (2 * K), '<a "' * (2 * K), "<a \"" * (2 * K) + "'>", "<b>" * K + "</i>" * K, "<x><table>" + "<b>" * K + "</x>" * K, "<ul>" + "<b>" * K + "<li></li>" * K, "<script></script " * (K // 2), "<b>" * K + "<header>" * K, "<a<" * (2 * K)],
    ids=range(9),
)
def test_malformed_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 10


def test_misnested_tables_and_quotes():
    assert html_text.main_text("<p>one <b>two<table><tr><td>three</b> four</td></tr></table></p><p>five") == "one two\nthree four\nfive"
    assert html_text.main_text('<p title="a > b">x</p><p a="un closed>y</p>') == 'x\n<p a="un closed>y'
    assert html_text.main_text("<p data-id=menu>kept</p>") == "kept"
