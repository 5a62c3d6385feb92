"""Ensemble, guardrail, polarity and constructed-set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.functions import text
from tessera.plans.metric_queries import SCORED, scored
from tessera.plans.pair_queries import OVERLAP, PAIRS, pairs
from tessera.plans.registry import query
from tessera.session import table

@query(
    "ensemble_scores",
    f"""WITH {SCORED}, m AS (SELECT doc_id, label, [least(score * 50, 1), least(cues / 10, 1), least(len / 2000, 1)] AS s FROM scored)
        SELECT doc_id, round(list_avg(s), 6) AS mean, round(list_median(s), 6) AS median, len(list_filter(s, lambda x: x >= 0.5)) AS votes FROM m""",
)
def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and votes of three scorers, as an array in the row instead of a pivot."""
    s = F.array(F.least(F.col("score") * 50, F.lit(1.0)), F.least(F.col("cues") / 10, F.lit(1.0)), F.least(F.col("len") / 2000, F.lit(1.0)))
    held = scored(spark, sf_dir).select("doc_id", F.sort_array(s).alias("s"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    return held.select("doc_id", F.round(mean, 6).alias("mean"), F.round(F.element_at("s", 2), 6).alias("median"), F.size(F.filter("s", lambda x: x >= 0.5)).cast("long").alias("votes"))


@query(
    "guardrail_margin",
    f"""WITH {PAIRS}, rated AS (SELECT conv_id, turn, {OVERLAP} AS o FROM pairs)
        SELECT conv_id, round(max(o), 6) AS best, round(avg(o) FILTER (place <= 3), 6) AS top3, CASE WHEN max(o) - min(o) < 0.02 THEN 'abstain' WHEN max(o) >= 0.1 THEN 'keep' ELSE 'downgrade' END AS decision
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o DESC) AS place FROM rated) GROUP BY conv_id""",
)
def guardrail_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best and the mean of the best three similarities of each conversation, and what a guardrail does with them."""
    o = text.overlap(text.token_set(F.col("a")), text.token_set(F.col("b")))
    rated = pairs(spark, sf_dir).select("conv_id", o.alias("o"))
    placed = rated.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("o"))))
    decision = F.when(F.max("o") - F.min("o") < 0.02, "abstain").when(F.max("o") >= 0.1, "keep").otherwise("downgrade")
    return placed.groupBy("conv_id").agg(F.round(F.max("o"), 6).alias("best"), F.round(F.avg(F.when(F.col("place") <= 3, F.col("o"))), 6).alias("top3"), decision.alias("decision"))


@query(
    "constructed_thirds",
    """SELECT conv_id, turn, CASE CAST('0x' || substr(md5(conv_id || ':' || turn), 1, 8) AS BIGINT) % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'corrupted' ELSE 'swapped' END AS part FROM conversations""",
)
def constructed_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in three parts by a digest: no sort, and a turn's part doesn't change when others come."""
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    third = F.conv(F.substr(F.md5(key.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long") % 3
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(third == 0, "clean").when(third == 1, "corrupted").otherwise("swapped").alias("part"))


@query(
    "precision_at_k",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
        r AS (SELECT q.vec_id AS query_id, q.label AS wanted, e.label AS got, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS k FROM q JOIN e ON e.vec_id <> q.vec_id)
        SELECT wanted AS label, count(*) FILTER (k = 1) AS n, round(avg(CAST(wanted = got AS DOUBLE)) FILTER (k = 1), 6) AS p1, round(avg(CAST(wanted = got AS DOUBLE)) FILTER (k <= 5), 6) AS p5 FROM r WHERE k <= 5 GROUP BY wanted""",
)
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the nearest vectors of a stated query set have its label: queries go out in blocks, each row ranks within its block."""
    from tessera.functions import vectors as V

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.unit(V.double(F.col("embedding"))).alias("v"))
    blocks = 8
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"), F.col("v").alias("q"))
    held = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cosine = F.round(V.dot(F.col("q"), F.col("v")), 9)
    near = held.join(spread, "block").where("vec_id <> query_id").select("query_id", "wanted", "label", "vec_id", "block", cosine.alias("c"))
    order = [F.desc("c"), F.col("vec_id")]
    first = near.withColumn("k", F.row_number().over(W.partitionBy("query_id", "block").orderBy(*order))).where("k <= 5")
    best = first.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where("k <= 5")
    hit = (F.col("wanted") == F.col("label")).cast("double")
    return best.groupBy(F.col("wanted").alias("label")).agg(
        F.count_if(F.col("k") == 1).alias("n"), F.round(F.avg(F.when(F.col("k") == 1, hit)), 6).alias("p1"), F.round(F.avg(hit), 6).alias("p5")
    )
