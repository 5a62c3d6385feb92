"""Variant queries; without SQL, they are held against plain Python in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import variants
from tessera.plans.registry import query
from tessera.plans.text_queries import sentences


@query("variants")
def all_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface-rule variants of all English sentences, filtered, with provenance."""
    found = sentences(spark, sf_dir).where("lang = 'en'")
    base = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("ord").cast("string"))
    return variants.run(found.select(base.alias("base_id"), "sentence")).drop("cue_tokens", "cue_char_spans")


@query("variant_drops")
def variant_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many variants each filter drops, by rule."""
    found = sentences(spark, sf_dir).where("lang = 'en'")
    base = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("ord").cast("string"))
    made = variants.tagged(variants.generate(found.select(base.alias("base_id"), "sentence")))
    return made.groupBy("generator", F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))
