"""Approximate nearest neighbours by randomly rotated one-bit codes, whose error bounds choose what is reranked."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Neighbours of a query.
TOP = 20
#: Queries that are searched for at once.
QUERIES = 16_384
#: Rows that the centre of the codes is the mean of, by the order of a hash of their number.
CENTRE_ROWS = 4096
#: Standard deviations of an estimate that count as its bound: a neighbour just at the least score is
#: lost with probability 0.0013, better ones more rarely.
WIDTH = 3.0
#: Bits of a query's coordinates.
BITS = 6
#: The first slice of the rows has about so many; each further one is so many times as large as all before.
FIRST, GROWTH = 2048, 15
#: Rows by queries that are estimated at once in a task.
AT_ONCE = (2048, 256)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


@dataclass(frozen=True)
class Codes:
    """Of each vector x around a centre c: the signs of the rotated unit vector u of x - c, packed; the
    length of x - c; the product of u with its signs' unit vector; the product of x and c."""

    signs: np.ndarray
    size: np.ndarray
    fit: np.ndarray
    centred: np.ndarray


def codes(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
    rest = vectors - centre
    size = np.linalg.norm(rest, axis=1)
    unit = (rest / np.where(size > 0, size, 1)[:, None]) @ turn
    fit = np.where(size > 0, np.abs(unit).sum(axis=1) / math.sqrt(vectors.shape[1]), 1)
    return Codes(packed(unit > 0), size, fit, vectors @ centre)


@dataclass(frozen=True)
class Asked:
    """Queries of one length: the rows, their vectors, around the centre and rotated as whole numbers of
    BITS bits by planes, with the numbers' lower end and step, and what else an estimate needs."""

    row: np.ndarray
    vectors: np.ndarray
    at: np.ndarray
    planes: list[np.ndarray]
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    size: np.ndarray
    centred: np.ndarray


def asked(rows: np.ndarray, vectors: np.ndarray, at: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Asked:
    rest = (vectors - centre) @ turn
    low = rest.min(axis=1)
    step = np.maximum((rest.max(axis=1) - low) / (2**BITS - 1), 1e-300)
    whole = np.rint((rest - low[:, None]) / step[:, None]).astype(np.int64)
    planes = [packed((whole >> b & 1).astype(bool)) for b in range(BITS)]
    total = low * rest.shape[1] + step * whole.sum(axis=1)
    return Asked(rows, vectors, at, planes, low, step, total, np.linalg.norm(rest, axis=1), vectors @ centre - centre @ centre)


def estimates(of: Codes, q: Asked, pick: slice, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Per query of ``pick`` and coded vector: the estimated inner product and its bound.

    <q, x> = <q - c, x - c> + <x, c> + <q, c> - <c, c>, of which the first product is estimated by
    |x - c| <q - c, signs> / fit. Its error is that of a random direction beside the signs, so it falls
    with the root of the dimension; that of the whole numbers is added.
    """
    dim = q.vectors.shape[1]
    ones = np.zeros((len(q.row[pick]), len(of.size)), np.int64)
    for b, plane in enumerate(q.planes):
        for word in range(plane.shape[1]):
            ones += np.bitwise_count(plane[pick, word][:, None] & of.signs[:, word][None, :]).astype(np.int64) << b
    count = np.bitwise_count(of.signs).sum(axis=1, dtype=np.int64)
    above = q.low[pick][:, None] * count[None, :] + q.step[pick][:, None] * ones
    scale = of.size / of.fit
    guess = (2 * above - q.total[pick][:, None]) / math.sqrt(dim) * scale[None, :] + of.centred[None, :] + q.centred[pick][:, None]
    beside = np.maximum(1 - of.fit**2, 0) / max(dim - 1, 1)
    error = width * scale[None, :] * np.sqrt(beside[None, :] * q.size[pick][:, None] ** 2 + q.step[pick][:, None] ** 2 / 12)
    return guess, error + 1e-9 * (1 + np.abs(guess))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added in the order of the components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class Best:
    """The best rows of each query so far: score, id (a null id is the last), row."""

    def __init__(self, least: np.ndarray, top: int):
        self.least, self.top = least.copy(), top
        shape = (len(least), top)
        self.score, self.none, self.ids = np.full(shape, -np.inf), np.ones(shape, bool), np.zeros(shape, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        """Of pairs given by columns, those that are among the best of their query."""
        some = np.unique(query)
        held = np.repeat(some, self.top)
        query = np.concatenate([held, query])
        score, none, ids = (np.concatenate([x[some].ravel(), y]) for x, y in ((self.score, score), (self.none, none), (self.ids, ids)))
        order = np.lexsort((ids, none, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        first = order[place < self.top]
        for x, y in ((self.score, score), (self.none, none), (self.ids, ids)):
            x[some] = y[first].reshape(len(some), self.top)
        self.least[some] = np.maximum(self.least[some], self.score[some, -1])


def search(vectors: np.ndarray, of: Codes, row: np.ndarray, none: np.ndarray, ids: np.ndarray, q: Asked, best: Best, width: float = WIDTH) -> int:
    """Puts each query's best coded vectors into ``best``; returns how many pairs were reranked.

    Only pairs whose estimate and bound together reach the query's least score are computed.
    """
    ranked = 0
    for i in range(0, len(row), AT_ONCE[0]):
        here = slice(i, i + AT_ONCE[0])
        part = Codes(of.signs[here], of.size[here], of.fit[here], of.centred[here])
        for j in range(0, len(q.row), AT_ONCE[1]):
            pick = slice(j, j + AT_ONCE[1])
            guess, error = estimates(part, q, pick, width)
            hopeful = (guess + error >= best.least[q.at[pick]][:, None]) & (q.row[pick][:, None] != row[here][None, :])
            a, b = np.nonzero(hopeful)
            ranked += len(a)
            if len(a) > hopeful.size // 8:  # so many that one product of matrices is less work
                rough = (q.vectors[pick] @ vectors[here].T)[a, b]
            else:
                rough = np.einsum("ij,ij->i", q.vectors[j + a], vectors[i + b])
            least = best.least[q.at[j + a]]
            fine = rough >= least - 1e-9 * (1 + np.abs(rough))
            # of many for one query at first, only those that can be among its best
            a, b, rough = a[fine], b[fine], rough[fine]
            order = np.lexsort((-rough, a))
            place = np.arange(len(a)) - np.searchsorted(a[order], a[order])
            last = order[(place == best.top - 1)]
            floor = np.full(len(q.row[pick]), -np.inf)
            floor[a[last]] = rough[last] - 1e-9 * (1 + np.abs(rough[last]))
            a, b = a[rough >= floor[a]], b[rough >= floor[a]]
            if len(a):
                score = products(q.vectors[j + a], vectors[i + b])
                enough = score >= best.least[q.at[j + a]]
                best.add(q.at[j + a[enough]], score[enough], none[i + b[enough]], ids[i + b[enough]])
    return ranked


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of the vectors of each length."""
    ends = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[ends[at][:, None] + np.arange(dim)].astype(np.float64)


def _coded(centres: dict[int, np.ndarray], seed: int):
    """What a task does with rows of row, id, slice, vector: the same with the codes of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, vectors in _by_length(batch.column(3)):
                dim = vectors.shape[1]
                turn = turns.setdefault(dim, rotation(dim, seed))
                of = codes(vectors, centres.get(dim, np.zeros(dim)), turn)
                more = [pa.array([x.tobytes() for x in of.signs], pa.binary()), *map(pa.array, (of.size, of.fit, of.centred))]
                yield pa.RecordBatch.from_arrays([x.take(pa.array(at)) for x in batch.columns] + more, names=["row", "id", "slice", "vec", "signs", "size", "fit", "centred"])

    return run


def _searched(queries, least, centres: dict[int, np.ndarray], seed: int, top: int, width: float):
    """What a task does with coded rows: the best of them for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, vectors_of = queries.value
        best, by_dim = Best(least.value, top), {}
        lengths = np.array([len(v) for v in vectors_of])
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            by_dim[dim] = asked(row_of[at], np.vstack([vectors_of[i] for i in at]).astype(np.float64), at, centres.get(dim, np.zeros(dim)), rotation(dim, seed))
        for batch in batches:
            ids, row = batch.column(1), batch.column(0).to_numpy()
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for at, vectors in _by_length(batch.column(3)):
                if vectors.shape[1] in by_dim:
                    signs = np.frombuffer(b"".join(batch.column(4).take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)
                    of = Codes(signs, *(batch.column(i).to_numpy()[at] for i in (5, 6, 7)))
                    search(vectors, of, row[at], none[at], ids[at], by_dim[vectors.shape[1]], best, width)
        query, place = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(best.ids[query, place], mask=best.none[query, place]), pa.array(best.score[query, place])], names=["query", "vec", "score"])

    return run


def fine_vectors(rows: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, vec) of the rows whose vector is neither null, empty nor zero and holds finite numbers only."""
    kind = rows.schema[vec].dataType
    as_is = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    big = F.lit(float("inf"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<float>" if as_is else "array<double>").alias("vec"))
    return rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("vec", lambda x: x != 0))


def _best_of(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def neighbours(rows: DataFrame, is_query: str, scratch: c.Scratch, id_col: str = "vec_id", vec: str = "embedding", top: int = TOP, most: int = QUERIES, width: float = WIDTH, first: int = FIRST, seed: int = 17) -> DataFrame:
    """One row per query and neighbour: query_id, rank, vec_id, score: of each row whose ``id`` fulfils the
    SQL condition ``is_query``, the ``top`` other rows with the largest inner product, in double precision.

    Every row is coded and every code is looked at for every query; a pair whose estimate and bound
    together don't reach the query's least score so far is left out, all others are computed on the
    original vectors. So a neighbour is only lost by an estimate more than ``width`` standard deviations
    off. Equal scores go by ascending id, null ids last. Vectors that are null, empty, zero or hold null
    or non-finite components take no part; vectors of another length than the query's are no candidates.
    Repeated rows are rows of their own, and so candidates of each other. Empty tables give an empty
    result. Other columns are ignored, whatever their names.

    Queries are searched for in blocks of about ``most``, which is what a task and the driver hold of
    them. The rows are looked at in slices, each 15 times as large as all before, and the scores reached
    so far bound what a task returns: about ``top`` by 15 rows a query and slice, however many tasks.
    The centre of the codes is the mean of at most CENTRE_ROWS rows of each length.
    """
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    all_ = c.numbered(fine_vectors(rows, id_col, vec), scratch, "row")
    n = all_.count()
    near = all_.orderBy(F.xxhash64("row"), "row").limit(CENTRE_ROWS).select("vec").toPandas()["vec"]  # CENTRE_ROWS at most
    lengths = near.map(len)
    centres = {int(d): np.vstack(near[lengths == d].to_numpy()).astype(np.float64).mean(axis=0) for d in lengths.unique()}
    # slice 0 holds about ``first`` rows, slice i all that is left of ``first`` * 16 ** i
    shares, size = [], float(first)
    while size < n:
        shares.append(size / n)
        size *= GROWTH + 1
    chance = F.pmod(F.xxhash64(F.lit("slice"), "row"), F.lit(1 << 30)) / float(1 << 30)
    which = F.lit(0)
    for i, share in enumerate(shares):
        which = F.when(chance >= share, i + 1).otherwise(which)
    coded = all_.select("row", "id", which.cast("int").alias("slice"), "vec").mapInArrow(_coded(centres, seed), "row long, id long, slice int, vec " + all_.schema["vec"].dataType.simpleString() + ", signs binary, size double, fit double, centred double")
    coded = scratch.keep(coded.repartition(max(sc.defaultParallelism, math.ceil(n / 100_000))), "coded")
    asks = scratch.keep(all_.where(is_query), "asks")
    blocks = max(1, math.ceil(asks.count() / most))
    out = None
    for block in range(blocks):
        mine = asks.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "id", "vec").toPandas()  # about ``most`` rows
        queries, least, best = sc.broadcast((mine["row"].to_numpy(np.int64), list(mine["vec"]))), np.full(len(mine), -np.inf), None
        for i in range(len(shares) + 1):
            run = _searched(queries, sc.broadcast(least.copy()), centres, seed, top, width)
            found = coded.where(F.col("slice") == i).mapInArrow(run, "query int, vec long, score double")
            found = found if best is None else found.unionByName(best.select("query", "vec", "score"))
            best = scratch.keep(_best_of(found, top), "best")
            for query, score in best.where(F.col("rank") == top).select("query", "score").collect() if i < len(shares) else ():  # at most one per query of the block
                least[query] = score
        names = pd.DataFrame({"query": np.arange(len(mine), dtype=np.int32), "query_id": mine["id"]})
        got = best.join(F.broadcast(spark.createDataFrame(names, "query int, query_id long")), "query")
        out = got if out is None else out.unionByName(got)
    return out.select("query_id", "rank", F.col("vec").alias("vec_id"), "score")


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row of embeddings whose id is divisible by 20."""
    return neighbours(c.read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding"), "id % 20 = 0", c.Scratch(spark))


OP13_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
