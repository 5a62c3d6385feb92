"""Verdict queries; labels stand for judgements, events for a cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import verification as V
from tessera.plans.registry import query
from tessera.session import table


@query("verdict_key", "SELECT conv_id, turn, sha256(text || chr(31) || role || chr(31) || CAST(conv_id AS VARCHAR)) AS key FROM conversations")
def verdict_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", V.verdict_key(F.col("text"), F.col("role"), F.col("conv_id").cast("string")).alias("key"))


JUDGED = "j AS (SELECT d.doc_id, lang, quality = 1 AS good, toxic = 0 AS clean, CASE WHEN n_chars % 7 <> 0 THEN n_chars > 500 END AS long FROM documents d LEFT JOIN labels USING (doc_id))"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions of every document; some are unanswered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    long = F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") > 500)
    return joined.select("doc_id", "lang", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("clean"), long.alias("long"))


@query(
    "verdict_outcome",
    f"WITH {JUDGED} SELECT doc_id, good AND clean AND long AS verified, concat_ws('+', CASE WHEN NOT good THEN 'good' END, CASE WHEN NOT clean THEN 'clean' END, CASE WHEN NOT long THEN 'long' END) AS reason FROM j",
)
def verdict_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued outcome and the reasons against."""
    q = {name: F.col(name) for name in ("good", "clean", "long")}
    return judged(spark, sf_dir).select("doc_id", V.all_three(*q.values()).alias("verified"), V.reasons(q).alias("reason"))


@query(
    "verdict_summary",
    f"""WITH {JUDGED} SELECT lang, count(*) AS n, count(*) FILTER (good AND clean AND long) AS passed, count(*) FILTER (NOT (good AND clean AND long)) AS rejected,
        count(*) FILTER ((good AND clean AND long) IS NULL) AS unjudged FROM j GROUP BY lang""",
)
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.all_three(F.col("good"), F.col("clean"), F.col("long"))
    rows = judged(spark, sf_dir).withColumn("v", v)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("v").alias("passed"), F.count_if(~F.col("v")).alias("rejected"), F.count_if(F.col("v").isNull()).alias("unjudged"))


@query(
    "disagreement_clusters",
    """WITH c AS (SELECT l.quality, d.lang, d.source, count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE l.quality <> 1 - l.toxic GROUP BY ALL)
        SELECT quality, lang, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sum(sum(n)) OVER (), 6) AS share, max_by(source, (n, source)) AS top_source FROM c GROUP BY quality, lang""",
)
def disagreement_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two labels disagree: size, share and most frequent source of each cluster."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id").where("quality <> 1 - toxic")
    counts = rows.groupBy("quality", "lang", "source").agg(F.count("*").alias("n"))
    clusters = counts.groupBy("quality", "lang").agg(F.sum("n").alias("n"), F.max(F.struct("n", "source")).alias("top"))
    whole = clusters.agg(F.sum("n").alias("whole"))
    return clusters.crossJoin(F.broadcast(whole)).select("quality", "lang", "n", F.round(F.col("n") / F.col("whole"), 6).alias("share"), F.col("top.source").alias("top_source"))


@query(
    "latest_verdicts",
    "SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, count(*) AS versions FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type",
)
def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache's latest value of each key; unjudged rows (null) never enter."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    latest = F.max(F.struct("ts", "event_id", "value"))
    return rows.groupBy("user_id", "event_type").agg(latest.alias("x"), F.count("*").alias("versions")).select("user_id", "event_type", F.col("x.value").alias("value"), "versions")


@query(
    "cache_upsert",
    """WITH old AS (SELECT user_id, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id), fresh AS (SELECT user_id, max(value) AS value FROM events WHERE event_type <> 'view' AND value > 50 GROUP BY user_id)
        SELECT user_id, value FROM old WHERE user_id NOT IN (SELECT user_id FROM fresh WHERE value IS NOT NULL) UNION ALL SELECT user_id, value FROM fresh WHERE value IS NOT NULL""",
)
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cache = events.where("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("value"))
    fresh = events.where("event_type <> 'view' AND value > 50").groupBy("user_id").agg(F.max("value").alias("value"))
    return V.upsert(cache, fresh, ["user_id"], "value")
