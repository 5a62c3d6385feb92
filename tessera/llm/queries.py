"""The queries of this subpackage, as the driver registers them, and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import html_text, language, toxicity
from tessera.llm._common import bucket, table
from tessera.llm.lattice import vector_groups
from tessera.llm.mixing import mix_plan
from tessera.llm.neighbours import nearest_neighbours
from tessera.llm.pieces import round_trip
from tessera.llm.sharding import shard_rows
from tessera.llm.simhash import simhash_groups
from tessera.llm.token_counts import token_counts


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece segmentations of all documents and what they decode to, with digests of both."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; what is held out is never learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = bucket("doc_id", 4) == 2
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_offending")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the hash tree."""
    return shard_rows(table(spark, sf_dir, "documents"), 16)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the mix of all sources."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "shards")


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings."""
    return vector_groups(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every hundredth."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; what is held out is never learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = bucket("doc_id", 3) == 1
    model = language.train(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_pieces": op1_pieces,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_lattice": op5_lattice,
    "op6_simhash": op6_simhash,
    "op7_neighbours": op7_neighbours,
    "op8_token_counts": op8_token_counts,
    "op9_html": op9_html,
    "op10_language": op10_language,
}
ORACLE_SQL: dict[str, str] = {}
