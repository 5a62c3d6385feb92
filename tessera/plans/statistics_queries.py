"""Queries of group statistics, reference margins, paragraph scores and constructed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import statistics as S
from tessera.plans.registry import query
from tessera.session import table

RATED = "r AS (SELECT lang AS family, n_chars % 6 AS label, (n_chars % 97 + 1) / 100.0 AS sim FROM documents WHERE lang IS NOT NULL)"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return docs.select(F.col("lang").alias("family"), (F.col("n_chars") % 6).alias("label"), ((F.col("n_chars") % 97 + 1) / 100.0).alias("sim"))


@query(
    "group_table",
    f"WITH {RATED} SELECT family, count(*) AS n, round(avg(label), 6) AS mean, round(stddev_samp(label), 6) AS std, CAST(quantile_cont(label, 0.5) AS DOUBLE) AS median, round(avg(CAST(sim AS DOUBLE)), 6) AS mean_sim, round(sum(label / 5.0 * CAST(sim AS DOUBLE)) / sum(CAST(sim AS DOUBLE) * CAST(sim AS DOUBLE)), 6) AS alpha FROM r GROUP BY family",
)
def group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, spread and the implied factor of every group."""
    return S.group_table(rated(spark, sf_dir), "family", "label", "sim")


@query(
    "group_omnibus",
    f"""WITH {RATED}, k AS (SELECT *, CAST(rank() OVER (ORDER BY label) AS DOUBLE) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS rk, count(*) OVER () AS n FROM r), g AS (SELECT family, count(*) AS m, sum(rk) AS s, avg(label) AS a FROM k GROUP BY family),
        t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY label)), w AS (SELECT count(*) AS n, avg(label) AS a, sum(label * label) - count(*) * avg(label) * avg(label) AS whole FROM r),
        x AS (SELECT any_value(w.n) AS n, count(*) AS groups, (12.0 / (any_value(w.n) * (any_value(w.n) + 1.0)) * sum(s * s / m) - 3 * (any_value(w.n) + 1.0)) / (1 - any_value(t.t) / (pow(any_value(w.n), 3) - any_value(w.n))) AS h, sum(m * pow(g.a - w.a, 2)) AS b, any_value(whole) AS whole FROM g, w, t)
        SELECT CAST(n AS BIGINT) AS n, round(h, 6) AS kruskal_h, round(h / (n - 1), 6) AS epsilon_squared, round((b / (groups - 1)) / ((whole - b) / (n - groups)), 6) AS anova_f, round(b / whole, 6) AS eta_squared FROM x""",
)
def group_omnibus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether groups differ at all: by ranks and by variance."""
    return S.omnibus(rated(spark, sf_dir), "family", "label")


@query(
    "group_comparison",
    f"""WITH {RATED}, d AS (SELECT label FROM r WHERE family = 'de'), e AS (SELECT label FROM r WHERE family = 'en'), dc AS (SELECT label, count(*) AS c FROM d GROUP BY label), ec AS (SELECT label, count(*) AS c FROM e GROUP BY label),
        u AS (SELECT sum(dc.c * ec.c * CASE WHEN dc.label > ec.label THEN 1.0 WHEN dc.label = ec.label THEN 0.5 ELSE 0 END) AS u FROM dc, ec), m AS (SELECT (SELECT count(*) FROM d) AS na, (SELECT count(*) FROM e) AS nb, (SELECT avg(label) FROM d) - (SELECT avg(label) FROM e) AS diff, (SELECT var_samp(label) FROM d) AS va, (SELECT var_samp(label) FROM e) AS vb)
        SELECT na AS n_a, nb AS n_b, round(diff, 6) AS mean_diff, round(diff / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d, CAST(u AS DOUBLE) AS u, round(CAST(2 * u / (na * nb) - 1 AS DOUBLE), 6) AS cliffs_delta FROM u, m""",
)
def group_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two groups differ: means, effect sizes and Mann and Whitney's count."""
    return S.compared(rated(spark, sf_dir), "family", "label", "de", "en")


_SETS = [(1, "neg", [1.0, 0.0]), (1, "neg", [0.6, 0.8]), (1, "same", [0.8, 0.6]), (2, "same", [0.0, 1.0])]


@query("reference_margins", "SELECT * FROM (VALUES (1, 0.96, 1.0, -0.04, -0.08, false), (2, -1.0, 0.6, -1.6, -1.8, true)) t(id, s_neg, s_same, margin, margin_res, coverage_fail)")
def reference_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much nearer two vectors are to generated negations than to the rest, over the axis (1, 0)."""
    rows = spark.createDataFrame([(1, [0.8, 0.6]), (2, [0.8, 0.6])], "id int, vec array<double>")
    return S.reference_margins(rows, spark.createDataFrame(_SETS, "id int, side string, vec array<double>"), F.array(F.lit(1.0), F.lit(0.0)))


@query(
    "paragraph_score",
    "SELECT CAST(4 AS BIGINT) AS teacher_sentences, 0.75 AS verdict_accuracy, 0.6667 AS assignment_accuracy, CAST(1 AS BIGINT) AS contradictions, CAST(1 AS BIGINT) AS caught, CAST(1 AS BIGINT) AS false_alarms, CAST(1 AS BIGINT) AS extra_tp, CAST(1 AS BIGINT) AS extra_fp, CAST(1 AS BIGINT) AS extra_fn",
)
def paragraph_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a matching of two paragraphs got right: three of four verdicts, two of three assignments, one of two extras."""
    shape = "id int, t int, verdict string, s int"
    gold = spark.createDataFrame([(1, 0, "covered", 0), (1, 1, "contradicted", 1), (1, 2, "missing", None), (2, 0, "covered", 2)], shape)
    said = spark.createDataFrame([(1, 0, "covered", 0), (1, 1, "contradicted", 2), (1, 2, "missing", None), (2, 0, "contradicted", 2)], shape)
    pairs = lambda rows: spark.createDataFrame(rows, "id int, s int")
    return S.paragraph_score(gold, said, pairs([(1, 3), (2, 0)]), pairs([(1, 3), (2, 1)]))


_PAIRS = [
    ("The red car is fast today", "The red car is slow today", 2.0), ("The red car is fast", "The red car is not fast", 2.0), ("A b c d", "A b c d.", 2.5), ("The old dog sleeps here", "The old dog eats here", 3.0), ("x y z", "u v w", 2.0), ("The blue car is fast today", "The blue car is slow today", 4.5),
]


@query("hard_negatives", "SELECT 'The red car is fast today' AS a, 'The red car is slow today' AS b, 2.0 AS score")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of six pairs the one that looks alike, has no cue more on a side, is of middling score and not blocked."""
    blocked = spark.createDataFrame([("the old dog eats here",)], "key string")
    return S.hard_negatives(spark.createDataFrame(_PAIRS, "a string, b string, score double"), blocked)


@query(
    "random_control_pairs",
    """WITH p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n, count(*) OVER (PARTITION BY lang) AS m FROM documents)
        SELECT a.lang, a.doc_id, b.doc_id AS partner FROM p a JOIN p b ON a.lang IS NOT DISTINCT FROM b.lang AND b.n = a.n % a.m + 1 WHERE a.m > 1""",
)
def random_control_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with another of its language, in hashed order."""
    return S.random_pairs(table(spark, sf_dir, "documents"), "lang", "doc_id")
