"""A counterfactual-regularised classifier of toxic texts."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Labelled rows that the classifier is fitted on at most, by the order of a hash of id and text.
MAX_TRAIN = 20_000
#: Documents of the fitted sample that a feature needs, and log-likelihood ratio of its dependence on the
#: label: 4 is what two documents tell if both are of the rarer kind, one row in nine.
LEAST, GAIN = 2, 4.0
#: Weights of the squared weights, and of squared score changes under swaps.
RIDGE, SWAP = 0.1, 5.0
#: Texts whose features are made at once.
CHUNK = 64
#: Lengths of the word beginnings that are features, besides whole words.
STEMS = range(3, 9)
WORDS = re.compile(r"[^\W\d_]+")
#: Terms of groups, in rows whose members can replace each other.
IDENTITY = (
    "women men girls boys", "woman man", "gay straight lesbian bisexual", "transgender cisgender", "black white asian latino",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists", "immigrants refugees foreigners natives", "disabled deaf blind", "old young",
    "frauen männer", "muslime christen juden", "ausländer flüchtlinge", "femmes hommes", "musulmans chrétiens juifs", "immigrés réfugiés", "mujeres hombres", "musulmanes cristianos judíos", "inmigrantes refugiados",
)
NEXT = {w: row[(i + 1) % len(row)] for row in map(str.split, IDENTITY) for i, w in enumerate(row)}


def features(words: set[str]) -> set[str]:
    """Whole words and, marked by *, beginnings of longer words."""
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_y, features of the text, and those of its counterfactual if it names a group, else null."""
    for batch in batches:
        for start in range(0, len(batch), CHUNK):  # a text has many features: few texts at once
            part, own, swapped = batch.iloc[start : start + CHUNK], [], []
            for text in part["_text"]:
                words = words_of(text)
                own.append(sorted(features(words)))
                other = {NEXT.get(w, w) for w in words}
                swapped.append(sorted(features(other)) if other != words else None)
            yield pd.DataFrame({"_y": part["_y"].to_numpy(), "own": own, "swapped": pd.Series(swapped, dtype=object)})


@dataclass(frozen=True)
class Model:
    """Logistic scores of presence features. ``swapped``: fitted rows that name a group, whose
    counterfactuals the fit has seen."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    swapped: int = 0

    def score(self, text: str) -> float:
        weights, heads = self.weights, self._heads()
        z, seen = self.bias, set()
        for w in words_of(text):
            if w[:3] in heads:
                seen.add(w)
                seen.update(f"{w[:k]}*" for k in STEMS if len(w) > k)
        for f in sorted(seen):  # in one order, so that equal texts score the same anywhere
            z += weights.get(f, 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def _heads(self) -> frozenset[str]:
        if "heads" not in self.__dict__:
            self.__dict__["heads"] = frozenset(f.rstrip("*")[:3] for f in self.weights)
        return self.__dict__["heads"]


@dataclass(frozen=True)
class Sparse:
    """A matrix of rows with few cells: row i has vals in the columns cols[at[i]:at[i+1]]."""

    at: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    width: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self._rows(), self.vals * w[self.cols], len(self.at) - 1)

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transpose times v."""
        return np.bincount(self.cols, self.vals * v[self._rows()], self.width)

    def _rows(self) -> np.ndarray:
        """The row of each cell."""
        if "rows" not in self.__dict__:
            self.__dict__["rows"] = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        return self.__dict__["rows"]


def solved(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, scale: np.ndarray, exact: float = 1e-8) -> np.ndarray:
    """x with apply(x) = b by conjugate gradients, for a positive definite matrix with the diagonal scale."""
    x, r = np.zeros_like(b), b.copy()
    p = r / scale
    now = r @ p
    enough = exact**2 * now
    for _ in range(4 * len(b)):
        if now <= enough:
            break
        q = apply(p)
        step = now / (p @ q)
        x, r = x + step * p, r - step * q
        z = r / scale
        now, then = r @ z, now
        p = z + now / then * p
    return x


def newton(x: Sparse, y: np.ndarray, change: Sparse, ridge: float = RIDGE, swap: float = SWAP, rounds: int = 60) -> np.ndarray:
    """Weights (bias last) with the least logistic loss + ridge * squares + swap * squared changes of
    the score under counterfactual swaps, by damped Newton steps. No matrix but those of few cells is
    made. A step is solved the more exactly, the smaller the slope has become."""
    ridges = np.append(np.full(x.width, 2 * ridge), 1e-6)

    def fixed(w: np.ndarray) -> np.ndarray:
        return ridges * w + 2 * swap * np.append(change.back(change.times(w[:-1])), 0.0)

    def scores(w: np.ndarray) -> np.ndarray:
        return x.times(w[:-1]) + w[-1]

    def loss(w: np.ndarray) -> float:
        z = scores(w)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * w @ fixed(w))

    def back(v: np.ndarray) -> np.ndarray:
        return np.append(x.back(v), v.sum())

    squares = Sparse(change.at, change.cols, change.vals**2, change.width).back(np.ones(len(change.at) - 1))
    w = np.zeros(x.width + 1)
    now, first = loss(w), None
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(scores(w), -500, 500)))
        v = p * (1 - p)
        scale = back(v) + ridges + 2 * swap * np.append(squares, 0.0)  # cells are 0 and 1, so squares are cells
        slope = back(p - y) + fixed(w)
        left = math.sqrt(slope @ (slope / scale))
        first = first or left
        if left <= 1e-5 * first:
            break
        step = solved(lambda d, v=v: back(v * scores(d)) + fixed(d), slope, scale, min(0.1, left / first))
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w, now = w - size * step, then
        if size <= 1e-4:
            break
    return w


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text is divisible by 5. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _cells(names: dict[str, int]):
    """What a task does with featured rows: y, the numbers of the own features, and the cells by which
    their counterfactuals differ, numbers of features gained and, as -1 less the number, lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [sorted(names[f] for f in fs if f in names) for fs in batch["own"]]
            moved = []
            for mine, fs in zip(own, batch["swapped"], strict=True):
                other = None if fs is None else {names[f] for f in fs if f in names}
                moved.append(None if other is None else sorted(other - set(mine)) + [-1 - i for i in sorted(set(mine) - other)])
            yield pd.DataFrame({"y": batch["_y"].to_numpy(), "own": own, "moved": pd.Series(moved, dtype=object)})

    return run


def _sample(docs: DataFrame, labels: DataFrame, scratch: c.Scratch, id_col: str, text: str, toxic: str, most: int) -> DataFrame:
    """(_y, _text) of at most ``most`` labelled rows outside ``held_out``: of so many ids at most, and of
    their rows, which may be more, again so many at most."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(toxic).alias("_toxic")).where("_toxic in (0, 1) and _id is not null").where(~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("_toxic").cast("int").alias("_y"))
    known = scratch.keep(known.orderBy(F.xxhash64("_id"), "_id").limit(most), "labels")
    rows = docs.select(F.col(id_col).alias("_id"), c.text_or_empty(text).alias("_text"))
    rows = c.numbered(rows.join(F.broadcast(known), "_id").withColumn("_hash", F.xxhash64("_id", "_text")), scratch)
    some = scratch.keep(rows.select("_row", "_hash").orderBy("_hash", "_row").limit(most).select("_row"), "some")
    return c.matching(rows, some, "_row").select("_y", "_text")


def fit(docs: DataFrame, labels: DataFrame, scratch: c.Scratch, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = MAX_TRAIN, ridge: float = RIDGE, swap: float = SWAP) -> Model:
    """A model learnt from labelled rows outside ``held_out``.

    At most ``most`` rows are used, of at most as many ids; that bounds what is broadcast and what the
    driver fits, ids that are repeated included. An id with several labels counts as toxic if any says
    so; null labels and null ids are left out, and null texts count as empty. Rows whose hashes tie go by
    their place. Other columns are ignored, whatever their names.
    The features are all whose presence tells GAIN or more about the label, and the terms of groups. Without both kinds of labels, as in empty tables, every text
    gets the share of toxic ones (half without any).
    """
    mark = len(scratch.tables)
    sample = _sample(docs, labels, scratch, id_col, text, toxic, most)
    sample = c.numbered(sample.mapInPandas(_featured, "_y int, own array<string>, swapped array<string>"), scratch)
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not 0 < pos < n:
        scratch.drop_since(mark)
        share = (pos + 1) / (n + 2)
        return Model(float(np.log(share / (1 - share))))
    counts = sample.select("_y", F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("_y").alias("pos")).where(F.col("n") >= LEAST)
    # log-likelihood ratio of the feature's and the label's dependence
    a, b = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")

    def term(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    share, m = pos / n, F.col("n").cast("double")
    told = term(a, m * share) + term(b, m * (1 - share)) + term(pos - a, (n - m) * share) + term(n - pos - b, (n - m) * (1 - share))
    some = counts.where(F.col("n") < n).where(told >= GAIN)
    best = some.select("f").toPandas()["f"]  # of the words of ``most`` rows
    names = sorted({*best} | {f for f in features(set(NEXT)) if not f.endswith("*")})
    rows = sample.mapInPandas(_cells({f: i for i, f in enumerate(names)}), "y int, own array<int>, moved array<int>").toArrow()  # at most ``most`` rows
    scratch.drop_since(mark)
    named = rows["moved"].is_valid()
    own, moved = (x.combine_chunks() for x in (rows["own"], rows["moved"].filter(named)))
    at = own.value_lengths().to_numpy(), moved.value_lengths().to_numpy()
    cells = own.flatten().to_numpy(), moved.flatten().to_numpy()
    x = Sparse(np.append(0, np.cumsum(at[0])), cells[0], np.ones(len(cells[0])), len(names))
    change = Sparse(np.append(0, np.cumsum(at[1])), np.where(cells[1] < 0, -1 - cells[1], cells[1]), np.where(cells[1] < 0, 1.0, -1.0), len(names))
    w = newton(x, rows["y"].to_numpy().astype(float), change, ridge, swap)
    return Model(float(w[-1]), {f: float(v) for f, v in zip(names, w, strict=False) if v}, len(at[1]))


def score(model: Model, text: str | Column) -> Column:
    """The toxicity score of a text column, 0 to 1; null counts as empty, and empty and very long texts are
    scored whole. Equal texts, repeated rows among them, score the same to the last digit."""

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(x) for x in texts], dtype="float64")

    return scores(c.text_or_empty(text))


def keep_clean(docs: DataFrame, labels: DataFrame, scratch: c.Scratch, threshold: float = 0.5) -> DataFrame:
    """docs without those that score ``threshold`` or more, ties included; all their columns stay, whatever
    their names. Null texts count as empty; repeated rows and null ids are rows like any others. An empty
    table stays one."""
    model = fit(docs, labels, scratch)
    rows = docs.select(F.struct("*").alias("_doc"), score(model, "text").alias("_score"))
    return rows.where(F.col("_score") < threshold).select("_doc.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every row of documents."""
    docs = c.read_columns(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, c.read_columns(spark, sf_dir, "labels", "doc_id", "toxic"), c.Scratch(spark))
    rows = docs.select("doc_id", held_out().alias("held_out"), score(model, "text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
