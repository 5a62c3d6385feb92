"""Statistics of rated groups, reference margins and scores of matched paragraphs, all by aggregates of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions import text as X, vectors as V
from tessera.operators.metrics import running


def group_table(rows: DataFrame, group: str, label: str, sim: str, top: float = 5.0) -> DataFrame:
    """(group, n, mean, std, median, mean_sim, alpha): alpha is the factor of least squares from sim to label / top."""
    y, s = F.col(label) / top, F.col(sim)
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(label), 6).alias("mean"), F.round(F.stddev_samp(label), 6).alias("std"), F.percentile(label, 0.5).alias("median"),
        F.round(F.avg(sim), 6).alias("mean_sim"), F.round(F.sum(y * s) / F.sum(s * s), 6).alias("alpha"),
    )


def _counts(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(g, v, k, r): how often each value occurs in each group, with the value's average rank among all."""
    counts = rows.groupBy(F.col(group).alias("g"), F.col(label).cast("double").alias("v")).agg(F.count("*").alias("k"))
    values = counts.groupBy("v").agg(F.sum("k").alias("c"))
    ranks = running(values, "v", {"upto": "c"}).select("v", "c", (F.col("upto") - (F.col("c") - 1) / 2).alias("r"))
    return counts.join(ranks, "v")


def omnibus(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(n, kruskal_h, epsilon_squared, anova_f, eta_squared) over all groups; ranks of equal values are averaged."""
    held = _counts(rows, group, label)
    by_group = held.groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("r")).alias("ranks"), F.sum(F.col("k") * F.col("v")).alias("s"), F.sum(F.col("k") * F.col("v") ** 2).alias("q"))
    ties = held.select("v", "c").distinct().agg(F.sum(F.col("c").cast("double") ** 3 - F.col("c")).alias("t"))
    total = by_group.agg(
        F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("ranks") ** 2 / F.col("n")).alias("rr"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 / F.col("n")).alias("ss")
    ).crossJoin(ties)
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)) / (1 - F.col("t") / (n**3 - n))
    between, whole = F.col("ss") - F.col("s") ** 2 / n, F.col("q") - F.col("s") ** 2 / n
    f = (between / (F.col("g") - 1)) / ((whole - between) / (n - F.col("g")))
    return total.select("n", F.round(h, 6).alias("kruskal_h"), F.round(h / (n - 1), 6).alias("epsilon_squared"), F.round(f, 6).alias("anova_f"), F.round(between / whole, 6).alias("eta_squared"))


def compared(rows: DataFrame, group: str, label: str, a: str, b: str) -> DataFrame:
    """(n_a, n_b, mean_diff, cohens_d, u, cliffs_delta) of two groups; u counts pairs in which a is greater, ties half."""
    held = _counts(rows.where(F.col(group).isin(a, b)), group, label)
    side = lambda g, c: F.sum(F.when(F.col("g") == g, c).otherwise(0))
    k, v = F.col("k"), F.col("v")
    sums = held.agg(*[side(g, e).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, e in (("n", k), ("s", k * v), ("q", k * v * v), ("r", k * F.col("r")))])
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    var = lambda i, n: F.col(f"q{i}") - F.col(f"s{i}") ** 2 / n
    diff = F.col("s0") / n0 - F.col("s1") / n1
    u = F.col("r0") - n0 * (n0 + 1) / 2
    pooled = F.sqrt((var(0, n0) + var(1, n1)) / (n0 + n1 - 2))
    return sums.select(
        F.col("n0").alias("n_a"), F.col("n1").alias("n_b"), F.round(diff, 6).alias("mean_diff"), F.round(F.try_divide(diff, pooled), 6).alias("cohens_d"), u.alias("u"), F.round(2 * u / (n0 * n1) - 1, 6).alias("cliffs_delta")
    )


def hashed_places(df: DataFrame, group: str, digest: Column, tie: str, name: str) -> DataFrame:
    """Adds the place (from 1) of each row of its group in the order of a hexadecimal digest.

    Counts of 4096 ranges of the digest say how many rows stand before a range; only a range's rows are sorted together.
    """
    ranged = df.withColumns({"_digest": digest, "_range": F.substr(digest, F.lit(1), F.lit(3))})
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(group).orderBy("_range"))  # 4096 rows of a group at most
    before = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_of"), (upto - F.col("_c")).alias("_past"))
    joined = ranged.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_of")))
    nth = F.row_number().over(W.partitionBy(group, "_range").orderBy("_digest", tie))
    return joined.withColumn(name, nth + F.col("_past")).drop("_digest", "_range", "_g", "_of", "_past")


def reference_margins(rows: DataFrame, references: DataFrame, axis: Column) -> DataFrame:
    """(id, s_neg, s_same, margin, margin_res, coverage_fail) of rows (id, vec) against references (id, side, vec).

    Sides are neg and same. A similarity is the greatest cosine of unit vectors; that of residuals is their dot product
    without the axis, less the distance along it. An empty side counts -1, and -2 for residuals.
    """
    b, v = F.col("b"), F.col("v")
    joined = rows.select("id", V.unit(F.col("vec")).alias("b")).join(references.select("id", "side", V.unit(F.col("vec")).alias("v")), "id", "left")
    cos = V.dot(b, v)
    res = V.dot(V.residual(b, axis), V.residual(v, axis)) - F.abs(V.dot(v, axis) - V.dot(b, axis))
    best = lambda side, x, none: F.coalesce(F.max(F.when(F.col("side") == side, x)), F.lit(none))
    held = joined.groupBy("id").agg(
        best("neg", cos, -1.0).alias("s_neg"), best("same", cos, -1.0).alias("s_same"), best("neg", res, -2.0).alias("r_neg"), best("same", res, -2.0).alias("r_same"), (F.count_if(F.col("side") == "neg") == 0).alias("coverage_fail")
    )
    return held.select(
        "id", F.round("s_neg", 6).alias("s_neg"), F.round("s_same", 6).alias("s_same"), F.round(F.col("s_neg") - F.col("s_same"), 6).alias("margin"), F.round(F.col("r_neg") - F.col("r_same"), 6).alias("margin_res"), "coverage_fail"
    )


def paragraph_score(gold: DataFrame, predicted: DataFrame, gold_extra: DataFrame, extra: DataFrame) -> DataFrame:
    """One row: teacher sentences, accuracy of verdicts, right assignments, extra sentences (tp, fp, fn), contradictions
    (gold, caught, false alarms). gold and predicted have (id, t, verdict, s); extras (id, s)."""
    both = gold.join(predicted.select("id", "t", F.col("verdict").alias("said"), F.col("s").alias("to")), ["id", "t"], "left")
    hit = lambda test: F.round(F.avg(test.cast("double")), 4)
    told, said = F.col("verdict") == "contradicted", F.coalesce(F.col("said") == "contradicted", F.lit(False))
    own = both.agg(
        F.count("*").alias("teacher_sentences"), hit(F.coalesce(F.col("verdict") == F.col("said"), F.lit(False))).alias("verdict_accuracy"),
        F.round(F.avg(F.when(F.col("s").isNotNull(), F.coalesce((F.col("s") == F.col("to")).cast("double"), F.lit(0.0)))), 4).alias("assignment_accuracy"),
        F.count_if(told).alias("contradictions"), F.count_if(told & said).alias("caught"), F.count_if(~told & said).alias("false_alarms"),
    )
    marked = gold_extra.select("id", "s", F.lit(1).alias("g")).join(extra.select("id", "s", F.lit(1).alias("p")), ["id", "s"], "full")
    return own.crossJoin(marked.agg(F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("extra_tp"), F.count_if(F.col("g").isNull()).alias("extra_fp"), F.count_if(F.col("p").isNull()).alias("extra_fn")))


def hard_negatives(pairs: DataFrame, blocked: DataFrame, least_overlap: float = 0.5, scores: tuple[float, float] = (1.5, 3.5)) -> DataFrame:
    """Pairs (a, b, score) that look alike and are no negations: of middling score, with as many cues on both sides and half of
    the words in common; pairs with a blocked sentence (key), or of one sentence, are left out."""
    words = X.overlap(X.token_set(F.col("a")), X.token_set(F.col("b")))
    keyed = pairs.withColumns({"ka": X.pair_key(F.col("a")), "kb": X.pair_key(F.col("b"))})
    fit = keyed.where(F.col("score").between(*scores) & (words >= least_overlap) & (X.cue_count(F.col("a")) == X.cue_count(F.col("b"))) & (F.col("ka") != F.col("kb")))
    for side in ("ka", "kb"):
        fit = fit.join(blocked.select(F.col("key").alias(side)), side, "left_anti")
    return fit.drop("ka", "kb")


def random_pairs(rows: DataFrame, stratum: str, key: str) -> DataFrame:
    """(stratum, key, partner): every row with the next of its stratum in hashed order, the last with the first: no row is its
    own partner but in a stratum of one, which has none."""
    placed = hashed_places(rows.select(stratum, key).distinct(), stratum, F.md5(F.col(key).cast("string").cast("binary")), key, "n")
    sizes = placed.groupBy(F.col(stratum).alias("_s")).agg(F.max("n").alias("m"))
    asked = placed.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).where("m > 1").withColumn("to", F.col("n") % F.col("m") + 1).drop("_s", "m", "n")
    partner = placed.select(F.col(stratum).alias("_t"), F.col(key).alias("partner"), F.col("n").alias("_n"))
    return asked.join(partner, F.col(stratum).eqNullSafe(F.col("_t")) & (F.col("to") == F.col("_n"))).select(stratum, key, "partner")
