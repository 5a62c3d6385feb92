"""The corpus pipeline: documents of a known language, clean, without near copies, mixed to weights, in pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as
Parquet and read again before the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language, mixing, pieces, simhash, toxicity
from tessera.llm._common import bucket, settled, table

#: Bytes of rows that go to a Python worker at once. A worker and the executor beside it each hold a batch several times.
BATCH = 4 << 20


def in_small_batches(stage):
    """Sets the session's batches to BATCH bytes; a longer text is a batch of its own. That stays, as a stage's rows are computed later."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a language of at least 0.4 of their letters."""
    model = language.train(docs.where(~(bucket("doc_id", 3) == 1)))
    return language.keep_identified(docs, model)


@in_small_batches
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.3 or more; a quarter of the labels is never learned from."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~(bucket("doc_id", 4) == 2)))
    return toxicity.keep_clean(docs, model)


@in_small_batches
def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each SimHash class."""
    return simhash.keep_first(docs)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target draws it: not at all, once or twice; dealt to shards and shuffled there."""
    return mixing.mix_in_shards(docs)


@in_small_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and digests of them and of what they decode to."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("toxicity", remove_toxic),
    ("SimHash near-dedup", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Models are trained and pieces sampled on the way: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settled(docs)
    return docs
