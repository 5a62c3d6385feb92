"""Fitting, cascade, split and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.functions import text
from tessera.operators.statistics import hashed_places
from tessera.plans.metric_queries import CURVE, SCORED, scored
from tessera.plans.pair_queries import OVERLAP, PAIRS, pairs
from tessera.plans.registry import query
from tessera.plans.text_queries import CUE_COUNT
from tessera.session import table

GRID = [round(i * 0.05, 2) for i in range(20)]
RATED = f"rated AS (SELECT conv_id, turn, {OVERLAP} AS o, {CUE_COUNT.format('b')} - {CUE_COUNT.format('a')} AS delta, length(a) AS la FROM pairs)"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with overlap, cue difference and length."""
    o = text.overlap(text.token_set(F.col("a")), text.token_set(F.col("b")))
    return pairs(spark, sf_dir).select("conv_id", "turn", o.alias("o"), (text.cue_count(F.col("b")) - text.cue_count(F.col("a"))).alias("delta"), F.length("a").alias("la"))


@query(
    "gate_fit",
    f"""WITH {SCORED}, grid AS (SELECT unnest({GRID}) * 0.1 AS t), r AS (SELECT round(t, 4) AS t, avg(CAST(score >= round(t, 4) AS DOUBLE)) FILTER (label = 1) AS tpr, avg(CAST(score >= round(t, 4) AS DOUBLE)) FILTER (label = 0) AS fpr
            FROM scored, grid GROUP BY 1)
        SELECT CAST(t AS DOUBLE) AS threshold, round(tpr, 6) AS recall, round(tpr - fpr, 6) AS j FROM r WHERE tpr >= 0.2 ORDER BY round(tpr - fpr, 10) DESC, t LIMIT 1""",
)
def gate_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of greatest Youden J among grid points with enough recall, the lower of equals: one pass for all points."""
    points = [round(g * 0.1, 4) for g in GRID]
    y = F.col("label") == 1
    pos, neg = F.count_if(y), F.count_if(~y)
    sums = scored(spark, sf_dir).agg(pos.alias("p"), neg.alias("n"), *[c for i, t in enumerate(points) for c in (F.count_if(y & (F.col("score") >= t)).alias(f"a{i}"), F.count_if(~y & (F.col("score") >= t)).alias(f"b{i}"))])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"a{i}") / F.col("p")).alias("tpr"), (F.col(f"b{i}") / F.col("n")).alias("fpr")) for i, t in enumerate(points)])
    grid = sums.select(F.explode(rows).alias("x")).select("x.*").where("tpr >= 0.2")
    best = grid.agg(F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 10).alias("j"), (-F.col("threshold")).alias("t"), "tpr")).alias("x"))
    return best.select((-F.col("x.t")).alias("threshold"), F.round("x.tpr", 6).alias("recall"), F.round("x.j", 6).alias("j"))


@query(
    "cascade_stages",
    f"""WITH {PAIRS}, {RATED} SELECT CASE WHEN o < 0.05 THEN 'stopped' WHEN delta = 0 THEN 'no_cue' WHEN delta % 2 = 0 THEN 'cancelled' ELSE 'negation' END AS stage,
        CASE WHEN la < 200 THEN 'short' WHEN la < 1000 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n FROM rated GROUP BY ALL""",
)
def cascade_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the stage that decides them and by length bucket."""
    stage = F.when(F.col("o") < 0.05, "stopped").when(F.col("delta") == 0, "no_cue").when(F.col("delta") % 2 == 0, "cancelled").otherwise("negation")
    bucket = F.when(F.col("la") < 200, "short").when(F.col("la") < 1000, "middle").otherwise("long")
    return rated(spark, sf_dir).groupBy(stage.alias("stage"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "corpus_statistics",
    """SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts, CAST(sum(n_chars) AS BIGINT) AS chars,
        count(*) FILTER (n_chars > 5000) AS long FROM documents GROUP BY lang""",
)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language. Distinct texts are counted by digest, in two steps, so that no task holds a language's texts."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    per = docs.groupBy("lang", "digest").agg(F.count("*").alias("k"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 5000).alias("long"))
    sums = per.groupBy("lang").agg(F.sum("k").alias("documents"), F.count("digest").alias("texts"), F.sum("chars").cast("long").alias("chars"), F.sum("long").alias("long"))
    sources = docs.select("lang", "source").distinct().groupBy("lang").agg(F.count("source").alias("sources"))
    return sums.join(sources, "lang").select("lang", "documents", "sources", "texts", "chars", "long")


@query(
    "model_disagreement",
    f"""WITH {SCORED}, d AS (SELECT doc_id, unnest(['cues', 'share', 'length']) AS model, unnest([cues > 0, score >= 0.01, len > 300]) AS said FROM scored)
        SELECT x.model AS a, y.model AS b, count(*) AS n, round(avg(CAST(x.said <> y.said AS DOUBLE)), 6) AS disagree FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.model < y.model GROUP BY ALL""",
)
def model_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise disagreement of three decisions, from columns instead of a self join."""
    said = {"cues": F.col("cues") > 0, "length": F.col("len") > 300, "share": F.col("score") >= 0.01}
    names = [(a, b) for a in said for b in said if a < b]
    sums = scored(spark, sf_dir).agg(F.count("*").alias("n"), *[F.avg((said[a] != said[b]).cast("double")).alias(f"{a}_{b}") for a, b in names])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.round(f"{a}_{b}", 6).alias("disagree")) for a, b in names])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


@query(
    "domain_cube",
    f"WITH {SCORED} SELECT coalesce(lang, 'all') AS lang, coalesce(q, 'all') AS quality, count(*) AS n, round(avg(CAST(label AS DOUBLE)), 6) AS rate FROM (SELECT *, CAST(quality AS VARCHAR) AS q FROM scored) GROUP BY CUBE (lang, q)",
)
def domain_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir)
    cells = found.withColumn("quality", F.col("quality").cast("string")).cube("lang", "quality").agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"))
    return cells.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("lang", "quality")})


@query(
    "quintile_bins",
    f"""WITH {SCORED}, cut AS (SELECT quantile_cont(CAST(len AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e FROM scored)
        SELECT len(list_filter(e, lambda x: x < len)) AS bin, count(*) AS n, min(len) AS low, max(len) AS high, round(avg(score), 6) AS mean_score FROM scored, cut GROUP BY 1""",
)
def quintile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir)
    edges = found.agg(F.percentile(F.col("len").cast("double"), F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("e"))
    binned = found.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda x: x < F.col("len"))).cast("long"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("len").cast("long").alias("low"), F.max("len").cast("long").alias("high"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("roc_points", f"WITH {SCORED}, {CURVE} SELECT threshold, round(tp / pos, 6) AS tpr, round(fp / neg, 6) AS fpr FROM curve")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import metrics

    return metrics.curve(scored(spark, sf_dir)).select("threshold", F.round(F.col("tp") / F.col("pos"), 6).alias("tpr"), F.round(F.col("fp") / F.col("neg"), 6).alias("fpr"))


@query(
    "median_label",
    "SELECT user_id, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS median, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id HAVING count(*) >= 3",
)
def median_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id")
    return rows.agg(F.round(F.percentile(F.col("value").cast("double"), F.lit(0.5)), 6).alias("median"), F.count("*").alias("n")).where("n >= 3")


@query(
    "cross_topic_donors",
    """WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents),
        names AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM documents))
        SELECT a.doc_id AS base, b.doc_id AS donor FROM d a JOIN names x ON a.source = x.source JOIN names y ON y.k = (x.k + 1) % x.m JOIN d b ON b.source = y.source AND b.n = a.n WHERE y.source <> x.source""",
)
def cross_topic_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unrelated partner for each document, from the next source: places join places, no theta join.

    Where the next source has fewer rows, its places are gone through again. Rows without a source are a source of their
    own, last in order. The SQL states the same only where no source is larger than the next and none is null.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    placed = hashed_places(docs, "source", F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "n")
    names = docs.select("source").distinct()
    ranked = names.withColumn("k", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)  # one row per source
    m = ranked.agg(F.count("*").alias("m"))
    following = ranked.crossJoin(F.broadcast(m)).select("source", ((F.col("k") + 1) % F.col("m")).alias("k"))
    sizes = docs.groupBy(F.col("source").alias("donor_source")).agg(F.count("*").alias("size"))
    partner = following.join(ranked.withColumnRenamed("source", "donor_source"), "k").where("NOT (source <=> donor_source)")
    partner = partner.join(sizes.withColumnRenamed("donor_source", "of"), F.col("donor_source").eqNullSafe(F.col("of"))).select(F.col("source").alias("base_source"), "donor_source", "size")
    base = placed.join(partner, placed["source"].eqNullSafe(partner["base_source"]))
    base = base.select(F.col("doc_id").alias("base"), "donor_source", ((F.col("n") - 1) % F.col("size") + 1).alias("place"))
    donors = placed.withColumnRenamed("doc_id", "donor")
    return base.join(donors, base["donor_source"].eqNullSafe(donors["source"]) & (base["place"] == donors["n"])).select("base", "donor")


@query(
    "json_fields",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN lower(json_extract_string(props, '$.flag')) IN ('true', 'yes', '1') THEN true WHEN lower(json_extract_string(props, '$.flag')) IN ('false', 'no', '0') THEN false END AS flag FROM events",
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of tolerant JSON, with booleans in any spelling."""
    from tessera.operators.verification import as_bool

    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), as_bool(F.get_json_object("props", "$.flag")).alias("flag"))


@query(
    "template_pairs",
    """WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), p AS (SELECT item_id, w[1] AS p, w[2] AS q FROM t WHERE len(w) >= 2)
        SELECT item_id, kind, replace(replace(form, '<p>', p), '<q>', q) AS sentence FROM p,
        (VALUES ('plain', 'if <p> then <q>'), ('antecedent', 'if not <p> then <q>'), ('consequent', 'if <p> then not <q>'), ('contrapositive', 'if not <q> then not <p>'), ('unless', 'unless <p>, <q>')) AS forms(kind, form)""",
)
def template_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional templates filled from every item; the five forms are an array, not a joined table."""
    forms = {"plain": "if <p> then <q>", "antecedent": "if not <p> then <q>", "consequent": "if <p> then not <q>", "contrapositive": "if not <q> then not <p>", "unless": "unless <p>, <q>"}
    words = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")).where(F.size("w") >= 2)
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("form")) for k, f in forms.items()])
    spread = words.select("item_id", F.element_at("w", 1).alias("p"), F.element_at("w", 2).alias("q"), F.explode(listed).alias("x"))
    return spread.select("item_id", "x.kind", F.replace(F.replace("x.form", F.lit("<p>"), F.col("p")), F.lit("<q>"), F.col("q")).alias("sentence"))


@query(
    "grammar_swap",
    r"""WITH t AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM conversations), p AS (SELECT *, 2 + turn % greatest(len(w) - 3, 1) AS k FROM t)
        SELECT conv_id, turn, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(list_concat(list_concat(w[1:k-1], [w[k+1], w[k]]), w[k+2:]), ' ') END AS broken FROM p""",
)
def grammar_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with two neighbouring words swapped."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.swap_middle(flat, F.col("turn")).alias("broken"))
