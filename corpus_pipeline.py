"""A corpus pipeline: toxicity, exact copies, near copies, source mix, tokens.

Every stage reads what its predecessor kept, as a written table. Null texts count as empty, null ids
stay, repeated rows are exact copies of which one stays. Columns beside those of documents are kept
up to the last stage. A stage's result reads scratch tables; without ``scratch`` they are the call's
own and stay until the session ends.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slabline.llm import byte_bpe, exact_dedup, mixing, near_copies, toxicity
from slabline.llm._common import Scratch

RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Leaves out documents that the toxicity classifier scores 0.5 or more.

    Null and empty texts have the score of no words and stay unless nearly all labels are toxic. Equal
    texts, repeated rows among them, share one fate; null ids are never learnt from. All columns stay.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch or Scratch(spark))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Keeps one of each set of texts that are equal without white space: the longest original, then
    the smallest id, nulls last; of rows that tie in both, any one. Null and empty texts are equal."""
    return exact_dedup.exact_keep_first(docs, scratch or Scratch(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Keeps one of each component of texts whose five-word shingles have a similarity of 0.8 or more:
    the one with the smallest id, nulls last. Texts of fewer than five words are similar to equal ones
    only, null and empty ones being equal. Repeated rows are near copies.

    Candidates are what operator 3's ball hashing of SimHash fingerprints links, then, as its two bits reach
    few pairs of just 0.8, those of MinHash bands; both are verified on the sets of shingles."""
    return near_copies.near_keep_first(docs, scratch or Scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Repeats or drops documents so that sources have their target weights. Null is a source, the last.
    Documents without words don't change totals and are taken like others. Reruns agree."""
    return mixing.mixture(docs, scratch or Scratch(spark))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of each row, repeated rows each. Null
    and empty texts have no tokens. This stage needs no scratch tables."""
    return byte_bpe.digests(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),  # SimHash by ball hashing, then MinHash for what is beyond two bits
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: A learnt classifier, SimHash and balanced sampling are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the whole table documents. Each stage's scratch tables go when its
    result is written."""
    between = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        own = Scratch(spark)
        docs = stage(spark, docs, sf_dir, own)
        if i + 1 < len(STAGES):
            docs = between.keep(docs, name)
            own.drop()
            if i:
                between.drop(between.tables[i - 1])
    return docs
