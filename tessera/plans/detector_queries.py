"""Queries of the pair detector over a literal table of scored pairs; SQL has the same rows and its own thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import lexicons, polarity as Y
from tessera.operators import detector as D, pairs as R, polarity_fit
from tessera.plans.parsed_fixtures import SENTENCES
from tessera.plans.parsed_queries import RELATION, values
from tessera.plans.registry import query
from tessera.sources.parses import noted_sentences

COLUMNS = "id, dataset, kind, neg_type, split, label, nli_c, nli_e, nli_n, cos, overlap, prob, override, margin, len_a, len_b, max_sim"
# id, data set, kind, type, split, label, three probabilities, cosine, overlap, combiner, override, margin, lengths, nearest reference
ROWS = [
    (1, "cannot_phase2", "negation", "verbal", "dev", 1, 0.99, 0.005, 0.005, 0.91, 0.8, 0.97, False, 0.21, 6, 7, 0.95),
    (2, "cannot_phase2", "negation", "antonym", "dev", 1, 0.8, 0.1, 0.1, 0.85, 0.7, 0.66, False, 0.02, 9, 9, 0.9),
    (3, "cannot_phase2", "negation", "other", "dev", 1, 0.4, 0.3, 0.3, 0.75, 0.5, 0.35, False, None, 14, 13, 0.8),
    (4, "cannot_phase2", "paraphrase", None, "dev", 0, 0.05, 0.9, 0.05, 0.93, 0.7, 0.04, False, -0.1, 6, 6, 0.97),
    (5, "cannot_phase2", "SemAntoNeg", None, "dev", 0, 0.9, 0.05, 0.05, 0.88, 0.6, 0.72, True, -0.05, 5, 6, 0.9),
    (6, "cannot_phase2", "sts_low", None, "dev", 0, 0.6, 0.1, 0.3, 0.3, 0.1, 0.4, False, -0.2, 20, 11, 0.4),
    (7, "cannot_phase2", "random_pair", None, "dev", 0, 0.3, 0.1, 0.6, 0.05, 0.05, 0.1, False, None, 7, 30, 0.1),
    (8, "xnot360", "xnot360_negation", "verbal", "test", 1, 0.97, 0.01, 0.02, 0.62, 0.3, 0.3, False, 0.3, 25, 22, 0.7),
    (9, "xnot360", "xnot360_not_negation", None, "test", 0, 0.95, 0.02, 0.03, 0.58, 0.45, 0.91, False, 0.01, 25, 24, 0.65),
    (10, "xnot360", "xnot360_not_negation", None, "test", 0, 0.2, 0.7, 0.1, 0.8, 0.9, 0.2, False, 0.0, 18, 18, 0.85),
    (11, "cannot_phase2", "negation", "verbal", "dev", 1, 0.98, 0.01, 0.01, 0.7, 0.35, 0.8, False, 0.15, 12, 5, 0.72),
    (12, "cannot_phase2", "snli_neutral", None, "dev", 0, 0.1, 0.2, 0.7, 0.5, 0.4, 0.2, False, -0.3, 8, 8, 0.55),
]
SCORED = values("p", COLUMNS, [tuple(int(x) if isinstance(x, bool) else x for x in r) for r in ROWS])


def pairs(spark: SparkSession) -> DataFrame:
    kinds = "id long, dataset string, kind string, neg_type string, split string, label long, nli_c double, nli_e double, nli_n double, cos double, overlap double, prob double, override boolean, margin double, len_a long, len_b long, max_sim double"
    return spark.createDataFrame(ROWS, kinds)


@query(
    "gate_fit_recall",
    f"""WITH {SCORED}, g AS (SELECT CAST(range AS DOUBLE) / 100 AS t1 FROM range(100)),
        r AS (SELECT round(t1, 2) AS t1, avg(CASE WHEN label = 1 THEN CAST(cos >= t1 AS INT) END) AS gate_recall, round(avg(CASE WHEN label = 1 THEN CAST(cos >= t1 AND nli_c >= 0.5 AS INT) END) - avg(CASE WHEN label = 0 THEN CAST(cos >= t1 AND nli_c >= 0.5 AS INT) END), 4) AS j FROM p, g WHERE split = 'dev' GROUP BY t1)
        SELECT t1, round(gate_recall, 4) AS gate_recall, j FROM r WHERE gate_recall >= 0.95 ORDER BY j DESC, t1 LIMIT 1""",
)
def gate_fit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of greatest J that keeps 95 % of the negations of dev."""
    return D.gate_fit(pairs(spark).where("split = 'dev'"), "cos", 0.5)


@query(
    "composite_cascade",
    f"""WITH {SCORED} SELECT id, CASE WHEN cos < 0.45 THEN 1 WHEN override = 1 THEN 2 ELSE 3 END AS stage, CASE WHEN cos >= 0.45 AND override = 0 THEN nli_c ELSE -1.0 END AS score FROM p""",
)
def composite_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, veto and model, one after the other."""
    score, stage = D.cascade(F.col("cos") >= 0.45, F.col("override"), F.col("nli_c"))
    return pairs(spark).select("id", stage.alias("stage"), score.alias("score"))


@query(
    "bucketed_cascade",
    f"""WITH {SCORED}, q AS (SELECT *, CASE WHEN least(len_a, len_b) <= 6 THEN 0.3 WHEN least(len_a, len_b) <= 12 THEN 0.55 ELSE 0.6 END AS t1, CASE id WHEN 8 THEN 'negation' WHEN 9 THEN 'not_negation' WHEN 10 THEN 'contraposition' END AS decision FROM p),
        s AS (SELECT *, CASE WHEN decision = 'not_negation' THEN 4 WHEN decision = 'negation' THEN 5 WHEN id = 2 THEN 0 WHEN cos < t1 THEN 1 WHEN override = 1 THEN 2 ELSE 3 END AS stage FROM q)
        SELECT id, t1, stage, CASE WHEN stage IN (0, 3) THEN nli_c WHEN stage = 5 THEN nli_c + 1 ELSE -1.0 END AS score FROM s""",
)
def bucketed_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, gates by length; what both flips of a conditional mean is left to the model here."""
    t1 = D.gate_threshold(F.col("len_a"), F.col("len_b"), [(6, 0.3), (12, 0.55), (None, 0.6)], 0.5)
    decision = F.when(F.col("id") == 8, "negation").when(F.col("id") == 9, "not_negation").when(F.col("id") == 10, "contraposition")
    held = pairs(spark).withColumn("t1", t1)
    score, stage = D.stages(decision, F.col("id") == 2, F.col("cos") >= F.col("t1"), F.col("override"), F.col("nli_c"), both=None)
    return held.select("id", "t1", stage.alias("stage"), score.alias("score"))


@query(
    "detector_predictions",
    f"""WITH {SCORED}, s AS (SELECT *, CASE WHEN override = 1 THEN 'cancellation override' WHEN prob < 0.5 AND overlap < 0.4 AND nli_c > 0.95 AND cos >= 0.6 THEN 'low-overlap NLI override'
            WHEN prob >= 0.5 AND margin IS NOT NULL AND margin <= 0.05 THEN 'guardrail downgrade' ELSE 'combiner' END AS stage FROM p)
        SELECT id, stage, stage = 'low-overlap NLI override' OR (stage = 'combiner' AND prob >= 0.5) AS negation FROM s""",
)
def detector_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detector says of each pair, and which of its rules said it."""
    rows = pairs(spark).withColumnRenamed("overlap", "token_overlap")
    return D.predict(rows, 0.5, {"theta": 0.4, "rho": 0.95, "kappa": 0.6}, 0.05).select("id", "stage", "negation")


@query("guarded_scores", f"WITH {SCORED} SELECT id, CASE WHEN prob >= 0.5 AND margin <= 0.02 THEN -1.0 ELSE prob END AS score FROM p")
def guarded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after the guardrail, which abstains without a margin."""
    return pairs(spark).select("id", D.guarded(F.col("prob"), 0.5, F.col("margin"), 0.02).alias("score"))


@query(
    "evaluation_parts",
    f"""WITH {SCORED}, h AS (SELECT *, CAST(prob >= 0.5 AS INT) AS hit FROM p), parts AS (SELECT 'all' AS part, 'all' AS value, * FROM h UNION ALL SELECT 'dataset', dataset, * FROM h UNION ALL SELECT 'kind', kind, * FROM h UNION ALL SELECT 'neg_type', neg_type, * FROM h)
        SELECT part, value, count(*) AS n, round(avg(CAST(hit = label AS INT)), 4) AS accuracy, round(avg(hit) FILTER (label = 0), 4) AS fpr, round(avg(hit) FILTER (label = 1), 4) AS recall FROM parts WHERE value IS NOT NULL GROUP BY part, value""",
)
def evaluation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, false positives and recall of all pairs and of their slices."""
    return D.evaluation(pairs(spark).withColumn("score", F.col("prob")), 0.5)


@query(
    "override_surface",
    f"""WITH {SCORED} SELECT theta, rho, round(avg(CAST(((overlap < theta AND nli_c > rho AND override = 0 AND cos >= 0.5) OR prob >= 0.5) = (label = 1) AS INT)), 4) AS accuracy
        FROM p, (VALUES (0.2::DOUBLE), (0.4), (0.6)) t(theta), (VALUES (0.9::DOUBLE), (0.95)) r(rho) GROUP BY theta, rho""",
)
def override_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the low-overlap rule over a grid."""
    rows = pairs(spark).withColumns({"token_overlap": F.col("overlap"), "score": F.col("prob")})
    return D.rule_surface(rows, [0.2, 0.4, 0.6], [0.9, 0.95], 0.5, 0.5)


@query("three_way_labels", f"WITH {SCORED} SELECT id, CASE WHEN max_sim < 0.5 THEN 'unrelated' WHEN margin >= 0.1 THEN 'negation' ELSE 'agrees' END AS label3 FROM p")
def three_way_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unrelated, negation or agrees."""
    return pairs(spark).select("id", R.three_way(F.col("max_sim"), F.col("margin"), 0.5, 0.1).alias("label3"))


@query("adopted_system", "SELECT 'rule_b' AS system, 0.017 AS gain")
def adopted_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four systems the one of greatest gain that loses nowhere: rule_c gains more in all, but loses on validation."""
    rows = [("base", 0.9, 0.8), ("rule_a", 0.901, 0.81), ("rule_b", 0.905, 0.812), ("rule_c", 0.89, 0.85)]
    return D.adopted(spark.createDataFrame(rows, "system string, validation double, ood double"), "base")


@query(
    "mean_probability_features",
    f"WITH {SCORED} SELECT id, round((nli_c + nli_e) / 2, 6) AS f1, round((nli_e + nli_n) / 2, 6) AS f2, round((nli_n + nli_c) / 2, 6) AS f3, CAST(20 AS BIGINT) AS n_features FROM p",
)
def mean_probability_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature row with the mean of two models' probabilities, and the length of one with three probabilities more."""
    own, other = [F.array("nli_c", "nli_e", "nli_n"), F.array("nli_e", "nli_n", "nli_c")]
    features = F.concat(F.array("cos"), own, F.array_repeat(F.lit(0.0), 13))
    mean = D.mean_probabilities(features, [own, other])
    return pairs(spark).select("id", *[F.round(F.get(mean, k), 6).alias(f"f{k}") for k in (1, 2, 3)], F.size(D.extended(features, [other])).cast("long").alias("n_features"))


@query(
    "feature_contributions",
    f"""WITH {SCORED}, z AS (SELECT id, 2.0 * cos + 3.0 * nli_c - 2.5 AS z, 2.0 * (cos - 0.7) AS dc, 3.0 * (nli_c - 0.7) AS dn FROM p),
        c AS (SELECT id, 'cos' AS name, 1 / (1 + exp(-z)) - 1 / (1 + exp(-(z - dc))) AS change FROM z UNION ALL SELECT id, 'nli_c', 1 / (1 + exp(-z)) - 1 / (1 + exp(-(z - dn))) FROM z)
        SELECT id, arg_max(name, abs(change)) AS name, round(arg_max(change, abs(change)), 6) AS change FROM c GROUP BY id""",
)
def feature_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature that moves each pair's score most, against its median."""
    found = D.contributions(F.array("cos", "nli_c"), [0.7, 0.7], [2.0, 3.0], -2.5, ["cos", "nli_c"])
    return pairs(spark).select("id", F.get(found, 0).alias("x")).select("id", "x.name", F.round("x.change", 6).alias("change"))


# Read from the sentences: (a, b, aligned antonyms, negator and antonym that cancel).
_ALIGNED = [(13, 14, True, False), (11, 12, False, False), (13, 32, False, False), (38, 14, False, False), (56, 12, False, False), (15, 39, False, False), (13, 15, False, False), (36, 36, False, False)]


@query("antonym_alignment", f"WITH {values('t', 'a, b, aligned, cancels', [(str(a), str(b), int(x), int(y)) for a, b, x, y in _ALIGNED])} SELECT a, b, aligned = 1 AS aligned, cancels = 1 AS cancels FROM t")
def antonym_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sentences that differ by one swap of antonyms, and those where a negator cancels it."""
    held = noted_sentences(spark, SENTENCES).select("sent_id", "tok")
    asked = spark.createDataFrame([(str(a), str(b)) for a, b, *_ in _ALIGNED], "a string, b string")
    side = lambda x: held.select(F.col("sent_id").alias(x), F.col("tok").alias(f"{x}_tok"))
    rows = asked.join(side("a"), "a").join(side("b"), "b").withColumn("found", R.diff(F.col("a_tok"), F.col("b_tok")))
    return rows.select("a", "b", R.antonym_aligned(RELATION, F.col("found")).alias("aligned"), R.not_antonym_cancels(RELATION, F.col("a_tok"), F.col("b_tok"), F.col("found")).alias("cancels"))


_PAIRS = [
    ("ours", "K1_cancellation", "x", "s"), ("ours", "ANCHOR_paraphrase", "x", "s"), ("ours", "ANCHOR_unrelated", "x", "s"), ("ours", "A_syntactic", "x", "s"),
    ("xnot360", None, "negation", "s"), ("cannot", None, "paraphrase", "antonym-substitution"), ("cannot", None, "paraphrase", "s"), ("cannot", None, "sts_low", "s"), ("cannot", None, "negation", "s"),
]


@query(
    "pair_categories",
    f"""WITH {values('p', 'dataset, family, subtype, source', _PAIRS)} SELECT dataset, family, subtype, source, CASE dataset WHEN 'ours' THEN CASE family WHEN 'K1_cancellation' THEN 'K1' WHEN 'ANCHOR_paraphrase' THEN 'ours_paraphrase' WHEN 'ANCHOR_unrelated' THEN 'ours_unrelated' ELSE 'ours_negation' END
        WHEN 'xnot360' THEN 'xnot360_' || subtype ELSE CASE WHEN subtype = 'paraphrase' AND source = 'antonym-substitution' THEN 'SemAntoNeg' ELSE subtype END END AS kind,
        CASE subtype WHEN 'negation' THEN 'negation' WHEN 'paraphrase' THEN 'agrees' WHEN 'sts_low' THEN 'unrelated' END AS gold FROM p""",
)
def pair_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and three-way gold label of pairs."""
    rows = spark.createDataFrame(_PAIRS, "dataset string, family string, subtype string, source string")
    c = F.col
    return rows.select("*", R.kind(c("dataset"), c("family"), c("subtype"), c("source")).alias("kind"), R.gold_three_way(c("subtype")).alias("gold"))


_TYPED = [
    ("The task is simple.", "The task is not simple.", "s", "verbal"), ("The value rose.", "The value fell.", "antonym-substitution", "antonym"),
    ("The value is large.", "The value is tiny.", "s", "antonym"), ("The line is straight.", "The line is curved.", "s", "other"),
]


@query("negation_types", f"WITH {values('t', 'a, b, source, neg_type', _TYPED)} SELECT a, b, source, neg_type FROM t")
def negation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each pair is a negation."""
    rows = spark.createDataFrame([r[:3] for r in _TYPED], "a string, b string, source string")
    swapped = R.antonym_swap(RELATION + [(a, "ADJ", b) for a, b in lexicons.CURATED_ANTONYMS])
    return rows.withColumn("swapped", swapped("a", "b")).select("a", "b", "source", R.negation_type(F.col("a"), F.col("b"), F.col("source"), F.col("swapped")).alias("neg_type"))


@query(
    "pair_polarity_scores",
    f"""WITH {SCORED}, d AS (SELECT id, 0.9 * label - 0.1 * len_a / 30 AS dp, cos, overlap FROM p) SELECT id, round(abs(dp) * cos, 6) AS f1, round(abs(dp) * overlap, 6) AS f2, round(abs(dp), 6) AS f3, round(CASE WHEN cos >= 0.6 THEN abs(dp) ELSE 0 END, 6) AS f4, round(dp, 6) AS f5 FROM d""",
)
def pair_polarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five forms that make a pair's score of two polarities and a similarity."""
    a, b = F.col("len_a") * 0.1 / 30, F.col("label") * 0.9
    return pairs(spark).select("id", *[F.round(Y.pair_score(f, a, b, F.col("cos"), F.col("overlap"), 0.6), 6).alias(f) for f in ("f1", "f2", "f3", "f4", "f5")])


_ERRORS = [
    ("xnot360", "k", None, True, True, 0, 0, False, True), ("xnot360", "k", None, True, True, 0, 0, False, False), ("xnot360", "k", None, True, False, 0, 0, False, False), ("xnot360", "k", None, False, False, 0, 0, False, True),
    ("cannot", "sts_low", None, False, False, 0, 0, False, True), ("cannot", "SemAntoNeg", None, False, False, 1, 1, False, True), ("cannot", "paraphrase", None, False, False, 0, 0, False, True),
    ("cannot", "negation", "antonym", False, False, 0, 0, False, False), ("cannot", "negation", "verbal", False, False, 1, 1, False, False), ("cannot", "negation", "verbal", False, False, 0, 1, False, False), ("cannot", "negation", "other", False, False, 0, 0, False, False),
]
_BUCKETS = ["xNot360: both sides conditional", "xNot360: conditional negation missed", "xNot360: conditional restated", "xNot360: non-conditional", "topically related", "paraphrase that swaps", "paraphrase with a content", "antonym negation missed", "cue on both sides", "verbal negation missed", "lexical substitution"]


@query("error_buckets", f"WITH {values('t', 'bucket', [(b,) for b in _BUCKETS])} SELECT bucket, CAST(1 AS BIGINT) AS n FROM t")
def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wrong pair of every bucket; buckets are named by how they begin."""
    names = ["dataset", "kind", "neg_type", "has_conditional_a", "has_conditional_b", "cue_count_a", "cue_count_b", "antonym_aligned", "predicted"]
    rows = spark.createDataFrame(_ERRORS, "dataset string, kind string, neg_type string, has_conditional_a boolean, has_conditional_b boolean, cue_count_a long, cue_count_b long, antonym_aligned boolean, predicted boolean")
    begins = spark.createDataFrame([(b,) for b in _BUCKETS], "begin string")
    found = rows.select(D.error_bucket({n: F.col(n) for n in names}).alias("bucket"))
    return found.join(F.broadcast(begins), F.startswith("bucket", "begin")).groupBy(F.col("begin").alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "polarity_gate",
    f"""WITH {SCORED}, d AS (SELECT label, cos, abs(0.9 * label - 0.1 * len_a / 30) AS delta FROM p), g AS (SELECT DISTINCT unnest(quantile_cont(cos, [{', '.join(str(round(0.05 * k, 2)) for k in range(20))}])) AS gate FROM d),
        s AS (SELECT gate, label, CASE WHEN cos >= gate THEN round(delta, 9) ELSE 0 END AS score FROM d, g),
        a AS (SELECT x.gate, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS auc FROM s x JOIN s y ON x.gate = y.gate AND x.label = 1 AND y.label = 0 GROUP BY x.gate)
        SELECT round(gate, 9) AS gate, round(auc, 6) AS auc FROM a ORDER BY round(auc, 9) DESC, gate LIMIT 1""",
)
def polarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on the cosine behind which differences of polarity separate negations best."""
    rows = pairs(spark).withColumn("delta", F.col("label") * 0.9 - F.col("len_a") * 0.1 / 30)
    return polarity_fit.fit_gate(rows).select(F.round("gate", 9).alias("gate"), F.round("auc", 6).alias("auc"))


@query(
    "override_mask",
    "SELECT * FROM (VALUES ('0', '37', true), ('37', '0', true), ('12', '56', false), ('13', '14', false), ('0', '32', false)) t(a, b, override)",
)
def override_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that no model may call a negation, as one side cancels its own and both have the same parity."""
    held = noted_sentences(spark, SENTENCES)
    held = held.select("sent_id", "tok", Y.analysis(RELATION, F.col("tok"), F.col("text")).alias("cues"))
    side = lambda x: held.select(F.col("sent_id").alias(x), F.col("tok").alias(f"{x}_tok"), F.col("cues").alias(f"{x}_cues"))
    asked = spark.createDataFrame([("0", "37"), ("37", "0"), ("12", "56"), ("13", "14"), ("0", "32")], "a string, b string")
    rows = asked.join(side("a"), "a").join(side("b"), "b").withColumn("found", R.diff(F.col("a_tok"), F.col("b_tok")))
    a, b = F.col("a_cues"), F.col("b_cues")
    by_antonym = R.not_antonym_cancels(RELATION, F.col("a_tok"), F.col("b_tok"), F.col("found"))
    return rows.select("a", "b", D.override(Y.cancellation_detected(a, b), Y.cancellation_detected(b, a), by_antonym).alias("override"))
