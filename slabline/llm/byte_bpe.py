"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Texts longer than this are split before encoding; code points.
PIECE = 1 << 16
#: Code points of text that are encoded before their result leaves the task.
FLUSH = 1 << 21
#: The white space of the pattern, which is Unicode's and not that of ``re``.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Before white space that follows another character: no match of the pattern goes across.
SAFE = re.compile(rf"(?<=[^{BLANK}])(?=[{BLANK}])")
#: White space so long that it is no work for the pattern's engine, which backtracks in it.
LONG = re.compile(rf"(?<![{BLANK}])[{BLANK}]{{4096,}}")


@lru_cache(2)
def encoding(ranks: str, pattern: str):
    """The encoding of a local rank file, read once per Python worker."""
    import tiktoken

    with open(ranks, "rb") as lines:
        of = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=of, special_tokens={})


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """A text in parts that no match of the pattern goes across; True for one match by itself.

    The pattern's alternatives take white space at their start only, or white space alone, and look
    ahead at most one character. So nothing that starts before white space goes into it, and a run of
    it is one match, but for its last character where a visible one follows.
    """
    at = 0
    for run in LONG.finditer(text):
        if run.start() > at:
            yield text[at : run.start()], False
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at], True
    if at < len(text):
        yield text[at:], False


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A long text in pieces of at least ``size``, cut before white space that follows a visible
    character, which changes no match. A text without such a place stays whole."""
    at = 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, ranks: str, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    """The ids of one text. White space runs of any length and texts without any are fine."""
    of = encoding(ranks, pattern)
    if len(text) < PIECE:  # too short for a run that matters
        return np.asarray(of.encode_ordinary(text), np.int32)
    ids = []
    for part, single in stretches(text):
        ids += [of._encode_single_piece(part)] if single else map(of.encode_ordinary, pieces(part))
    return np.concatenate([np.asarray(x, np.int32) for x in ids])


def decode(ids: np.ndarray, ranks: str, pattern: str = public_tokenizers.PATTERN) -> bytes:
    """The bytes of ids; they need not be valid UTF-8."""
    return encoding(ranks, pattern).decode_bytes(ids.tolist())


def _in_parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    part, size, start = [], 0, 0
    for i, x in enumerate(texts):
        part.append(x.as_py())
        size += len(part[-1])
        if size >= FLUSH:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part


def encoded(docs: DataFrame, ranks: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """The columns ``carry`` of docs, and ids, array<int>; with ``decoded`` also bytes, decoded from ids.

    One row per row; null texts count as empty and have no ids. Special tokens are ordinary text.
    ``ranks`` is the path of the rank file on every machine. Results leave the task every FLUSH code
    points, so memory holds one such part or one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            for start, part in _in_parts(batch.column(batch.num_columns - 1)):
                ids = [encode(x, ranks, pattern) for x in part]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                out = [x.slice(start, len(part)) for x in rest]
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                if decoded:
                    out.append(pa.array([decode(x, ranks, pattern) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    kept = docs.select(*carry).schema.fields
    fields = [*kept, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField("bytes", T.BinaryType(), False))
    names = [f.name for f in fields]
    return docs.select(*carry, c.text_or_empty(text).alias("_text")).mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame, ranks: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, and SHA-256 of the ids joined by commas and of the decoded bytes."""
    return encoded(docs, ranks, text, (id_col,), decoded=True).select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every row of documents."""
    docs = c.read_columns(spark, sf_dir, "documents", "doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
