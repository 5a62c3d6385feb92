"""Sentence pair queries; consecutive turns of a conversation are the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.functions import text
from tessera.plans.registry import query
from tessera.plans.text_queries import CUE_COUNT
from tessera.session import table

PAIRS = "pairs AS (SELECT * FROM (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL)"
TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9'']+'))"
OVERLAP = "len(list_intersect({0}, {1})) / greatest(len(list_distinct(list_concat({0}, {1}))), 1)".format(TOKENS.format("a"), TOKENS.format("b"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, a, b): each turn with the next one."""
    turns = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", "turn", F.col("text").alias("a"), after.alias("b")).where("b IS NOT NULL")


@query("pair_overlap", f"WITH {PAIRS} SELECT conv_id, turn, round({OVERLAP}, 6) AS overlap FROM pairs")
def pair_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard overlap of each pair's token sets."""
    found = pairs(spark, sf_dir)
    return found.select("conv_id", "turn", F.round(text.overlap(text.token_set(F.col("a")), text.token_set(F.col("b"))), 6).alias("overlap"))


@query(
    "pair_features",
    rf"""WITH {PAIRS} SELECT conv_id, turn, {CUE_COUNT.format("a")} AS cue_count_a, {CUE_COUNT.format("b")} AS cue_count_b,
        len(regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}'']+')) AS len_a, len(regexp_extract_all(lower(b), '[\p{{L}}\p{{N}}'']+')) AS len_b,
        abs(len(regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}'']+')) - len(regexp_extract_all(lower(b), '[\p{{L}}\p{{N}}'']+'))) AS len_diff, round({OVERLAP}, 6) AS token_overlap FROM pairs""",
)
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical features of each pair in one projection."""
    found = pairs(spark, sf_dir)
    n = lambda c: F.size(text.words(F.col(c))).cast("long")
    return found.select(
        "conv_id",
        "turn",
        text.cue_count(F.col("a")).cast("long").alias("cue_count_a"),
        text.cue_count(F.col("b")).cast("long").alias("cue_count_b"),
        n("a").alias("len_a"),
        n("b").alias("len_b"),
        F.abs(n("a") - n("b")).alias("len_diff"),
        F.round(text.overlap(text.token_set(F.col("a")), text.token_set(F.col("b"))), 6).alias("token_overlap"),
    )


@query(
    "pair_kind",
    f"""WITH {PAIRS}, rated AS (SELECT conv_id, turn, {CUE_COUNT.format("b")} - {CUE_COUNT.format("a")} AS delta, {OVERLAP} AS o FROM pairs)
        SELECT conv_id, turn, CASE WHEN delta % 2 <> 0 AND o >= 0.4 THEN 'negation' WHEN o >= 0.6 THEN 'paraphrase' WHEN o < 0.2 THEN 'unrelated' ELSE 'other' END AS kind FROM rated""",
)
def pair_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's label of each pair: first rule that holds."""
    found = pairs(spark, sf_dir)
    rated = found.select(
        "conv_id", "turn", (text.cue_count(F.col("b")) - text.cue_count(F.col("a"))).alias("delta"), text.overlap(text.token_set(F.col("a")), text.token_set(F.col("b"))).alias("o")
    )
    kind = F.when((F.col("delta") % 2 != 0) & (F.col("o") >= 0.4), "negation").when(F.col("o") >= 0.6, "paraphrase").when(F.col("o") < 0.2, "unrelated").otherwise("other")
    return rated.select("conv_id", "turn", kind.alias("kind"))


@query(
    "cue_difference",
    rf"""WITH {PAIRS}, a AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}'']+')) AS w FROM pairs),
        b AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(b), '[\p{{L}}\p{{N}}'']+')) AS w FROM pairs),
        counted AS (SELECT conv_id, turn, w, sum(n) AS n FROM (SELECT conv_id, turn, w, 1 AS n FROM b UNION ALL SELECT conv_id, turn, w, -1 FROM a) WHERE w IN ('not', 'no', 'never', 'without', 'nor', 'neither', 'none') GROUP BY ALL)
        SELECT conv_id, turn, w AS cue, CAST(n AS BIGINT) AS extra FROM counted WHERE n <> 0""",
)
def cue_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset difference of cue words between the two sides, signed: one aggregation instead of a full outer join."""
    found = pairs(spark, sf_dir)
    side = lambda c, n: found.select("conv_id", "turn", F.explode(text.words(F.col(c))).alias("cue"), F.lit(n).alias("n"))
    both = side("b", 1).union(side("a", -1)).where(F.col("cue").isin("not", "no", "never", "without", "nor", "neither", "none"))
    return both.groupBy("conv_id", "turn", "cue").agg(F.sum("n").cast("long").alias("extra")).where("extra <> 0")


@query(
    "overlap_bins",
    f"""WITH {PAIRS}, rated AS (SELECT {OVERLAP} AS o, {CUE_COUNT.format("b")} > {CUE_COUNT.format("a")} AS more FROM pairs)
        SELECT least(CAST(floor(o * 5) AS BIGINT), 4) AS bin, count(*) AS n, round(avg(CASE WHEN more THEN 1.0 ELSE 0.0 END), 6) AS more_cues FROM rated GROUP BY 1""",
)
def overlap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by fixed overlap bins."""
    found = pairs(spark, sf_dir)
    o = text.overlap(text.token_set(F.col("a")), text.token_set(F.col("b")))
    more = (text.cue_count(F.col("b")) > text.cue_count(F.col("a"))).cast("double")
    return found.groupBy(F.least(F.floor(o * 5), F.lit(4)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(more), 6).alias("more_cues"))


@query(
    "retrieval_top3",
    f"""WITH bench AS (SELECT item_id, {TOKENS.format("text")} AS t FROM benchmark),
        grams AS (SELECT item_id, t, unnest(t) AS w FROM bench), turns AS (SELECT conv_id, turn, {TOKENS.format("text")} AS t FROM conversations WHERE turn = 0),
        meets AS (SELECT conv_id, item_id, count(*) AS common, any_value(len(turns.ws)) AS na, any_value(len(grams.t)) AS nb
            FROM (SELECT conv_id, unnest(t) AS w, t AS ws FROM turns) turns JOIN grams USING (w) GROUP BY conv_id, item_id)
        SELECT conv_id, item_id, rank FROM (SELECT conv_id, item_id, row_number() OVER (PARTITION BY conv_id ORDER BY common / (na + nb - common) DESC, item_id) AS rank FROM meets) WHERE rank <= 3""",
)
def retrieval_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three benchmark items nearest to each first turn by overlap: they meet on tokens, not in a cross join."""
    items = table(spark, sf_dir, "benchmark").select("item_id", text.token_set(F.col("text")).alias("t")).select("item_id", F.size("t").alias("nb"), F.explode("t").alias("w"))
    turns = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", text.token_set(F.col("text")).alias("t"))
    turns = turns.select("conv_id", F.size("t").alias("na"), F.explode("t").alias("w"))
    meets = turns.join(items, "w").groupBy("conv_id", "item_id", "na", "nb").agg(F.count("*").alias("common"))
    order = W.partitionBy("conv_id").orderBy(F.desc(F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))), "item_id")
    return meets.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("conv_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query(
    "word_edit_distance",
    None,
)
def word_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word edit distance of the whole turns of each pair."""
    distance = text.word_edit_distance(text.words(F.col("a")), text.words(F.col("b")))
    return pairs(spark, sf_dir).select("conv_id", "turn", distance.cast("long").alias("distance"))
