"""Evaluation queries: labelled documents with a lexical score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.functions import lexicons, text
from tessera.operators import metrics
from tessera.plans.registry import query, words_in
from tessera.session import table

CUES = words_in([*lexicons.EXPLICIT_CUES, *lexicons.LEXICALLY_NEGATIVE])
N_WORDS = r"len(regexp_extract_all(lower(text), '[\p{L}\p{N}'']+'))"
N_CUES = rf"len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']+'), lambda w: w IN {CUES}))"
SCORED = f"""scored AS (SELECT doc_id, lang, source, quality, toxic AS label, round({N_CUES} / greatest({N_WORDS}, 1), 6) AS score, {N_CUES} AS cues, {N_WORDS} AS len
    FROM documents JOIN labels USING (doc_id))"""
CURVE = """counts AS (SELECT score AS threshold, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n FROM scored GROUP BY 1),
    curve AS (SELECT *, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM counts)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the share of negative words as score."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id").withColumn("ws", text.words(F.col("text")))
    cues = F.size(F.filter("ws", lambda w: w.isin([*lexicons.EXPLICIT_CUES, *lexicons.LEXICALLY_NEGATIVE])))
    return joined.select(
        "doc_id", "lang", "source", "quality", F.col("toxic").alias("label"), F.round(cues / F.greatest(F.size("ws"), F.lit(1)), 6).alias("score"),
        cues.alias("cues"), F.size("ws").alias("len"),
    )


@query("auc", f"WITH {SCORED}, {CURVE} SELECT round(sum(n * (tp - p / 2)) / any_value(pos * neg), 6) AS auc FROM curve")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query("youden", f"WITH {SCORED}, {CURVE} SELECT threshold, round(tp / pos - fp / neg, 6) AS j FROM curve ORDER BY round(tp / pos - fp / neg, 12) DESC, threshold DESC LIMIT 1")
def youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.youden(scored(spark, sf_dir)).select("threshold", F.round("j", 6).alias("j"))


@query("best_f1", f"WITH {SCORED}, {CURVE} SELECT threshold, round(2 * tp / (tp + fp + pos), 6) AS f1 FROM curve ORDER BY round(2 * tp / (tp + fp + pos), 12) DESC, threshold DESC LIMIT 1")
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_f1(scored(spark, sf_dir)).select("threshold", F.round("f1", 6).alias("f1"))


CONFUSION = """count(*) FILTER (label = 1 AND predicted) AS tp, count(*) FILTER (label = 0 AND predicted) AS fp,
    count(*) FILTER (label = 1 AND NOT predicted) AS fn, count(*) FILTER (label = 0 AND NOT predicted) AS tn"""
RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy"""


@query("confusion_by_lang", f"WITH {SCORED}, c AS (SELECT lang, {CONFUSION} FROM (SELECT *, score >= 0.01 AS predicted FROM scored) GROUP BY lang) SELECT *, {RATES} FROM c")
def confusion_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.01).cast("int"))
    return metrics.confusion(found, ["lang"])


@query(
    "slice_breakdown",
    f"""WITH {SCORED} SELECT lang, source, count(*) AS n, round(avg(CAST(label AS DOUBLE)), 6) AS rate, CAST(sum(cues) AS BIGINT) AS cues
        FROM scored GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""",
)
def slice_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slices by one pass of grouping sets."""
    found = scored(spark, sf_dir)
    sets = found.groupingSets([[], ["lang"], ["source"], ["lang", "source"]], "lang", "source")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"), F.sum("cues").cast("long").alias("cues"))


@query(
    "score_stats",
    f"""WITH {SCORED} SELECT lang, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS low, round(quantile_cont(score, 0.25), 6) AS q1,
        round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3, max(score) AS high FROM scored GROUP BY lang""",
)
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("score", F.lit(p)), 6)
    return scored(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("std"), F.min("score").alias("low"),
        q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("score").alias("high"),
    )


@query(
    "threshold_sweep",
    f"WITH {SCORED}, points AS (SELECT unnest([1, 2, 3, 5, 8, 13, 21]) / 1000.0 AS t) SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (score < t) AS rejected, count(*) AS n FROM scored, points GROUP BY t",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections at each point, from one pass: the points are columns, not joined rows."""
    points = [0.001, 0.002, 0.003, 0.005, 0.008, 0.013, 0.021]
    counts = scored(spark, sf_dir).agg(F.count("*").alias("n"), *[F.count_if(F.col("score") < t).alias(f"r{i}") for i, t in enumerate(points)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"r{i}").alias("rejected")) for i, t in enumerate(points)])
    return counts.select(F.explode(rows).alias("x"), "n").select("x.threshold", "x.rejected", "n")


@query(
    "kappa",
    f"""WITH {SCORED}, m AS (SELECT count(*) AS n, avg(CAST((label = 1) = (score >= 0.01) AS DOUBLE)) AS po, avg(CAST(label AS DOUBLE)) AS pa, avg(CAST(score >= 0.01 AS DOUBLE)) AS pb FROM scored)
        SELECT n, round(po, 6) AS agreed, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM m""",
)
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir).select((F.col("label") == 1).alias("a"), (F.col("score") >= 0.01).alias("b"))
    return metrics.kappa(found, "a", "b")


RATINGS = "ratings AS (SELECT user_id AS u, CAST(floor(value / 25) AS BIGINT) AS v FROM events WHERE value IS NOT NULL)"


@query(
    "krippendorff_alpha",
    f"""WITH {RATINGS}, per AS (SELECT u, v, count(*) AS k FROM ratings GROUP BY ALL), held AS (SELECT u, v, k, sum(k) OVER (PARTITION BY u) AS m FROM per QUALIFY m > 1),
        margin AS (SELECT v, CAST(sum(k) AS DOUBLE) AS n FROM held GROUP BY v), upto AS (SELECT *, sum(n) OVER (ORDER BY v) AS c FROM margin),
        gaps AS (SELECT a.v AS v1, b.v AS v2, a.n AS n1, b.n AS n2, power(b.c - a.c + a.n / 2 - b.n / 2, 2) AS d FROM upto a, upto b WHERE a.v < b.v),
        seen AS (SELECT x.v AS v1, y.v AS v2, sum(x.k * y.k / (x.m - 1)) AS o FROM held x JOIN held y ON x.u = y.u AND x.v < y.v GROUP BY ALL)
        SELECT round(1 - ((SELECT sum(n) FROM margin) - 1) * (SELECT sum(o * d) FROM seen JOIN gaps USING (v1, v2)) / (SELECT sum(n1 * n2 * d) FROM gaps), 6) AS alpha""",
)
def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal agreement of each user's event values, in classes of 25."""
    ratings = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", F.floor(F.col("value") / 25).alias("v"))
    return metrics.krippendorff_ordinal(ratings, "user_id", "v")


@query(
    "spearman_by_lang",
    f"""WITH {SCORED}, ranked AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY len) + (count(*) OVER (PARTITION BY lang, len) - 1) / 2 AS ra,
            rank() OVER (PARTITION BY lang ORDER BY cues) + (count(*) OVER (PARTITION BY lang, cues) - 1) / 2 AS rb FROM scored)
        SELECT lang, CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN round(corr(ra, rb), 6) ELSE 0 END AS rho FROM ranked GROUP BY lang""",
)
def spearman_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of length and cues; ranks come from counts of distinct values."""
    found = scored(spark, sf_dir).select("lang", "len", "cues")

    def ranks(value: str, name: str) -> DataFrame:
        counts = found.groupBy("lang", value).count()
        upto = F.sum("count").over(W.partitionBy("lang").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
        return counts.select("lang", value, (upto - (F.col("count") - 1) / 2).alias(name))

    joined = found.join(ranks("len", "ra"), ["lang", "len"]).join(ranks("cues", "rb"), ["lang", "cues"])
    n, a, b = F.count("*"), F.col("ra"), F.col("rb")
    spread = (n * F.sum(a * a) - F.sum(a) * F.sum(a)) * (n * F.sum(b * b) - F.sum(b) * F.sum(b))
    rho = F.try_divide(n * F.sum(a * b) - F.sum(a) * F.sum(b), F.sqrt(spread))
    return joined.groupBy("lang").agg(F.round(F.coalesce(rho, F.lit(0.0)), 6).alias("rho"))  # 0 where either is constant


@query(
    "cliffs_delta",
    f"""WITH {SCORED}, counts AS (SELECT len AS v, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n FROM scored GROUP BY 1),
        up AS (SELECT *, sum(n) OVER (ORDER BY v) AS below FROM counts)
        SELECT round(sum(p * (below - n / 2)), 3) AS u, round(2 * sum(p * (below - n / 2)) / (sum(p) * sum(n)) - 1, 6) AS delta FROM up""",
)
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney U and Cliff's delta of lengths of toxic and other documents."""
    counts = scored(spark, sf_dir).groupBy("len").agg(F.count_if(F.col("label") == 1).cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("n"))
    parts = metrics.running(counts, "len", {"below": "n"}).withColumn("w", F.col("p") * (F.col("below") - F.col("n") / 2)).agg(F.sum("w").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return parts.select(F.round("u", 3).alias("u"), F.round(2 * F.col("u") / (F.col("p") * F.col("n")) - 1, 6).alias("delta"))


@query("ls_alpha", f"WITH {SCORED} SELECT source, round(sum(cues * CAST(len AS DOUBLE)) / nullif(sum(CAST(len AS DOUBLE) * len), 0), 9) AS alpha FROM scored GROUP BY source")
def ls_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares slope through the origin."""
    n = F.col("len").cast("double")
    return scored(spark, sf_dir).groupBy("source").agg(F.round(F.try_divide(F.sum(F.col("cues") * n), F.sum(n * n)), 9).alias("alpha"))


@query(
    "leave_one_out",
    f"WITH {SCORED} SELECT doc_id, round((sum(cues) OVER (PARTITION BY source) - cues) / nullif(count(*) OVER (PARTITION BY source) - 1, 0), 6) AS mean_of_others FROM scored",
)
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean cue count of a source's other documents: sums by source, pre-aggregated, less the row's own."""
    found = scored(spark, sf_dir).select("doc_id", "source", "cues")
    sums = found.groupBy("source").agg(F.sum("cues").alias("total"), F.count("*").alias("k"))
    return found.join(sums, "source").select("doc_id", F.round(F.try_divide(F.col("total") - F.col("cues"), F.col("k") - 1), 6).alias("mean_of_others"))


@query(
    "reliability_bins",
    f"""WITH {SCORED}, edges AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS q, quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS e FROM scored),
        cut AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS e FROM scored), binned AS (SELECT label, score, len(list_filter(e, lambda x: x <= score)) AS bin FROM scored, cut)
        SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CAST(label AS DOUBLE)), 6) AS rate FROM binned GROUP BY bin""",
)
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed rates by quintiles of the score; the four edges are one small row."""
    found = scored(spark, sf_dir)
    edges = found.agg(F.percentile("score", F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)])).alias("e"))
    binned = found.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda x: x <= F.col("score"))).cast("long"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"))


@query(
    "holm",
    """WITH t AS (SELECT event_type, count(*) / 1000000.0 AS p FROM events GROUP BY event_type),
        r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS q FROM t)
        SELECT event_type, round(CAST(p AS DOUBLE), 8) AS p, round(CAST(max(q) OVER (ORDER BY p) AS DOUBLE), 8) AS p_holm FROM r""",
)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down correction of one test per event type."""
    tests = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count("*") / 1000000.0).alias("p"))
    return metrics.holm(tests).select("event_type", F.round("p", 8).alias("p"), F.round("p_holm", 8).alias("p_holm"))
