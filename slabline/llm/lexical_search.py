"""Ranked lexical search by dual trees: hierarchies over items and over documents hold coordinate maxima."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Documents found for an item.
TOP = 10
#: Items that are searched for at once; more are dealt over several blocks of about as many.
ITEMS = 2048
#: Documents of a tree, and cells of its maxima; documents of a leaf, items of a leaf.
DOCS, CELLS, LEAF, ITEM_LEAF = 8192, 1 << 22, 16, 4
#: One in so many documents is searched first, for lower bounds of the scores that all must reach.
SAMPLE = 64
#: A term is a run of ASCII letters and digits and of any other bytes over 127; A-Z become a-z, the rest blank.
TERM_BYTES = bytes(ord(chr(i).lower()) if chr(i).isascii() and chr(i).isalnum() else i if i > 127 else 32 for i in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in UTF-8, repeats included; null has none."""
    return (text or "").encode().translate(TERM_BYTES).split()


@dataclass(frozen=True)
class Rows:
    """Sparse rows: row i has the coordinates cols[at[i]:at[i+1]] with the values vals."""

    at: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    width: int

    def take(self, order: np.ndarray) -> Rows:
        sizes = np.diff(self.at)[order]
        at = np.concatenate([[0], np.cumsum(sizes)])
        pick = np.repeat(self.at[order] - at[:-1], sizes) + np.arange(at[-1])
        return Rows(at, self.cols[pick], self.vals[pick], self.width)

    def dense(self, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((hi - lo, self.width))
        of = np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1]))
        out[of, self.cols[self.at[lo] : self.at[hi]]] = self.vals[self.at[lo] : self.at[hi]]
        return out


@dataclass(frozen=True)
class Tree:
    """Nodes in an order in which children follow their parent: rows lo to hi of the reordered rows, the
    children (-1: none), and per coordinate the largest value of the node's rows."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    most: np.ndarray


def tree(rows: Rows, leaf: int) -> tuple[Tree, Rows]:
    """Splits rows again and again by the coordinate in which they differ most, at its mean, down to
    ``leaf`` rows; a side has a fourth at least, so that the depth is logarithmic. Returns the tree and
    the rows in its order."""
    n = len(rows.at) - 1
    order, nodes, todo = np.arange(n), [], [(0, n, -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([lo, hi, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if hi - lo <= leaf:
            continue
        part = rows.take(order[lo:hi])
        sums = np.bincount(part.cols, part.vals, rows.width)
        spread = np.bincount(part.cols, part.vals**2, rows.width) - sums**2 / (hi - lo)
        col = int(spread.argmax()) if rows.width else 0
        value = np.zeros(hi - lo)
        if rows.width:
            at = part.cols == col
            value[np.repeat(np.arange(hi - lo), np.diff(part.at))[at]] = part.vals[at]
        order[lo:hi] = order[lo:hi][np.argsort(value, kind="stable")]
        under, fourth = int((value <= value.mean()).sum()), -(-(hi - lo) // 4)
        mid = lo + min(max(under, fourth), hi - lo - fourth)
        todo += [(lo, mid, me, 0), (mid, hi, me, 1)]
    lo, hi, left, right = np.array(nodes).T
    rows, most = rows.take(order), np.zeros((len(nodes), rows.width))
    for i in reversed(range(len(nodes))):
        most[i] = rows.dense(lo[i], hi[i]).max(axis=0, initial=0.0) if left[i] < 0 else np.maximum(most[left[i]], most[right[i]])
    return Tree(order, lo, hi, left, right, most), rows


class Best:
    """The best ``top`` documents of each item so far: score, whether the id is null, id."""

    def __init__(self, least: np.ndarray, top: int):
        self.least, self.top = least.astype(float), top
        self.score = np.full((len(least), top), -1.0)
        self.none, self.ids = np.ones((len(least), top), bool), np.zeros((len(least), top), np.int64)

    def add(self, items: np.ndarray, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        """scores: items by documents. Those under an item's least score are left out."""
        n = (len(items), scores.shape[1])
        score = np.hstack([self.score[items], np.where(scores >= self.least[items, None], scores, -1.0)])
        none = np.hstack([self.none[items], np.broadcast_to(none, n)])
        ids = np.hstack([self.ids[items], np.broadcast_to(ids, n)])
        first = np.lexsort((ids, none, -score), axis=1)[:, : self.top]
        self.score[items], self.none[items], self.ids[items] = (np.take_along_axis(x, first, 1) for x in (score, none, ids))
        self.least[items] = np.maximum(self.least[items], self.score[items, -1])


def _children(x: Tree, y: Tree, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of pairs of nodes; a leaf stands for itself."""
    of_x = np.where(x.left[a] < 0, a, x.left[a]), x.right[a]
    of_y = np.where(y.left[b] < 0, b, y.left[b]), y.right[b]
    a, b = np.concatenate([of_x[i] for i in (0, 0, 1, 1)]), np.concatenate([of_y[i] for i in (0, 1, 0, 1)])
    return a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]


def dual_search(items: Rows, docs: Rows, none: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Puts the best documents of each item into ``best``; returns how many pairs were scored.

    A pair of nodes is bounded by the product of their coordinate maxima. One whose bound is below the
    weakest score that its items already have is left, with all pairs below it; on equality it stays, as
    a smaller id may win. Values are whole numbers, so sums in doubles are exact below 2 ** 53.
    """
    docs_, docs = tree(docs, LEAF)
    items_, items = tree(items, ITEM_LEAF)
    none, ids = none[docs_.order], ids[docs_.order]
    asked = items.dense(0, len(items.at) - 1)
    a, b = np.array([0]), np.array([0])
    while True:
        # the pairs as a table of the nodes in them
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        weakest = np.array([best.least[items_.order[items_.lo[x] : items_.hi[x]]].min() for x in ua])
        keep = (items_.most[ua] @ docs_.most[ub].T)[ia, ib] >= weakest[ia]
        a, b = a[keep], b[keep]
        if not len(a) or ((items_.left[a] < 0) & (docs_.left[b] < 0)).all():
            break
        a, b = _children(items_, docs_, a, b)
    scored = 0
    if not len(a):
        return scored
    leaves, which = np.unique(b, return_inverse=True)
    asks = np.zeros((len(items_.lo), len(leaves)), bool)
    asks[a, which] = True
    of = np.empty(len(items.at) - 1, np.int64)  # the leaf of each item, in the tree's order
    for node in np.flatnonzero(items_.left < 0):
        of[items_.lo[node] : items_.hi[node]] = node
    bound = np.where(asks[of], asked @ docs_.most[leaves].T, -1.0)
    asked = np.ascontiguousarray(asked.T)
    for leaf in np.argsort(-bound.max(axis=0), kind="stable"):  # the most promising leaf raises the scores first
        rows = np.flatnonzero(bound[:, leaf] >= best.least[items_.order])
        if len(rows):
            lo, hi = docs_.lo[leaves[leaf]], docs_.hi[leaves[leaf]]
            cols, at = np.unique(docs.cols[docs.at[lo] : docs.at[hi]], return_inverse=True)
            some = Rows(docs.at[lo : hi + 1] - docs.at[lo], at, docs.vals[docs.at[lo] : docs.at[hi]], len(cols)).dense(0, hi - lo)
            best.add(items_.order[rows], (some @ asked[np.ix_(cols, rows)]).T, none[lo:hi], ids[lo:hi])
            scored += len(rows) * (hi - lo)
    return scored


def _counted(vocabulary):
    """What a task does with rows of id, text: id, number of terms, and the items' terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            n, sizes, cols, counts = [], [0], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                hit = Counter(map(number.get, words))
                hit.pop(None, None)
                n.append(len(words))
                sizes.append(len(hit))
                cols.extend(hit.keys())
                counts.extend(hit.values())
            ends = pa.array(np.cumsum(sizes, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((cols, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["id", "n", "cols", "counts"])

    return run


def _searched(items, weights, least, documents: int, length: int, top: int):
    """What a task does with rows of id, n, cols, counts: the best documents of each item among them."""

    def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, len(batch), most):
                part = batch.slice(start, most)
                if size + len(part) > most:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = weights.value, items.value
        best = Best(least.value, top)
        for batch in blocks(batches, max(4 * LEAF, min(DOCS, LEAF * CELLS // max(1, len(weight)) // 2))):
            ends = batch.column(2).offsets.to_numpy()
            cols, tf = (batch.column(i).values.to_numpy()[ends[0] : ends[-1]] for i in (2, 3))
            sizes, n = np.diff(ends), batch.column(1).to_numpy()
            m = 100 - 90 + 90 * n * documents // length
            value = weight[cols] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
            some = value > 0
            kept = np.add.reduceat(np.append(some, False).astype(np.int64), ends[:-1] - ends[0]) * (sizes > 0) if len(sizes) else sizes
            here, cols = np.unique(cols[some], return_inverse=True)  # coordinates that this block has
            docs = Rows(np.concatenate([[0], np.cumsum(kept)]), cols, value[some].astype(float), len(here))
            at = np.searchsorted(here, asked.cols)
            found = (at < len(here)) & (np.append(here, -1)[at] == asked.cols)
            of = np.repeat(np.arange(len(asked.at) - 1), np.diff(asked.at))[found]
            mine = Rows(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(asked.at) - 1))]), at[found], np.ones(len(of)), len(here))
            ids = batch.column(0)
            dual_search(mine, docs, ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), best)
        item, place = np.nonzero(best.score > 0)
        ids = pa.array(best.ids[item, place], mask=best.none[item, place])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(best.score[item, place].astype(np.int64))], names=["item", "doc", "score"])

    return run


def _top(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def _block(spark: SparkSession, items: pd.DataFrame, docs: DataFrame, scratch: c.Scratch, top: int, sample: int) -> DataFrame:
    """(item, rank, doc, score) of a block of items, numbered from 0."""
    mark, sc = len(scratch.tables), spark.sparkContext
    asked = [set(terms(x)) for x in items["text"]]
    number = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    vectors = docs.mapInArrow(_counted(sc.broadcast(number)), "id long, n long, cols array<int>, counts array<bigint>")
    vectors = scratch.keep(vectors, "vectors")
    documents, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    for t, n in vectors.select(F.explode("cols").alias("t")).groupBy("t").count().collect():  # at most the terms of the block's items
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    rows = Rows(np.concatenate([[0], np.cumsum([len(x) for x in asked])]), np.array([number[t] for x in asked for t in sorted(x)], np.int64), np.empty(0), len(number))
    shared = sc.broadcast(rows), sc.broadcast(weights)

    def search(part: DataFrame, least: np.ndarray) -> DataFrame:
        run = _searched(*shared, sc.broadcast(least), documents, max(1, length), top)
        return _top(scratch.keep(part.mapInArrow(run, "item int, doc long, score long"), "found"), top)

    # a score of 0 is no hit
    least = np.ones(len(items), np.int64)
    vectors = vectors.where(F.size("cols") > 0)
    first = search(vectors.where(F.pmod(F.xxhash64("id", "n", F.size("cols")), F.lit(sample)) == 0), least)
    for item, score in first.where(F.col("rank") == top).select("item", "score").collect():  # at most one row per item of the block
        least[item] = score
    out = scratch.keep(search(vectors, least), "ranked")
    scratch.drop_since(mark, "ranked")
    return out


def ranked(docs: DataFrame, items: DataFrame, scratch: c.Scratch, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", top: int = TOP, most: int = ITEMS, sample: int = SAMPLE) -> DataFrame:
    """One row per item and rank: item id, rank, doc id, score: each item's ``top`` documents by score.

    A term counts once in an item and by its frequency in a document; scores are whole numbers, those of
    0 are no hits, equal ones go by ascending id, null ids last. Whole texts are read; null and empty
    ones have no terms, such an item finds nothing. Repeated rows, of items too, are rows of their own:
    an item that is there twice has its ranks twice. Empty tables give an empty result. Other columns
    are ignored, whatever their names.

    Items are searched in blocks of about ``most``, each over all documents: a block's terms and texts
    are what the driver and tasks hold of them. Documents become sparse vectors over the block's terms
    where they are read and aren't shuffled; a task builds trees over some thousand of them at a time.
    The scores that one in ``sample`` documents reach bound what every task must look at and return; they
    leave nothing out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    asked = c.numbered(items.select(F.col(item_col).alias("_item"), F.col(text).alias("text")), scratch, "_row")
    blocks = max(1, math.ceil(asked.count() / most))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    out = None
    for i in range(blocks):
        block = asked.where(F.col("_block") == i).select("_row", "text").toPandas()  # about ``most`` rows
        rows = spark.createDataFrame(pd.DataFrame({"item": np.arange(len(block), dtype=np.int32), "_row": block["_row"].astype(np.int64)}), "item int, _row long")
        got = _block(spark, block, docs, scratch, top, sample).join(F.broadcast(rows), "item").drop("item")
        out = got if out is None else out.unionByName(got)
    out = c.matching(out, asked.select("_row", "_item"), "_row")
    return out.select(F.col("_item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every row of benchmark."""
    docs, items = c.read_columns(spark, sf_dir, "documents", "doc_id", "text"), c.read_columns(spark, sf_dir, "benchmark", "item_id", "text")
    return ranked(docs, items, c.Scratch(spark))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT count(*) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0
), m AS (
  SELECT doc_id, 100 - 90 + (90 * len(t) * nn) // ll AS m FROM d, s WHERE len(t) > 0
), f AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) AS x WHERE term IN (SELECT term FROM b) GROUP BY doc_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, nn
), c AS (
  SELECT item_id, f.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM b JOIN f ON f.term = b.term JOIN w ON w.term = f.term JOIN m ON m.doc_id = f.doc_id GROUP BY item_id, f.doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM c WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
