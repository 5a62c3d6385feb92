"""Evaluation measures over a frame of labels (0 or 1) and scores, all by aggregation and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


RANGES = 64


def running(df: DataFrame, by: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds running sums (name -> column) in the order of a numeric column without equal values.

    The values fall into RANGES ranges by approximate quantiles; sums run within each range in its own task, and
    start from the total of the ranges before it. So no task sorts all rows.
    """
    cuts = df.agg(F.percentile_approx(by, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 10000).alias("_cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(by)))).drop("_cuts")
    way = F.desc if descending else F.asc
    totals = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    upto = W.orderBy(way("_range")).rowsBetween(W.unboundedPreceding, -1)  # RANGES rows
    before = totals.select("_range", *[F.coalesce(F.sum(f"_{name}").over(upto), F.lit(0)).alias(f"_{name}") for name in sums])
    within = W.partitionBy("_range").orderBy(way(by)).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = placed.join(F.broadcast(before), "_range")
    return joined.withColumns({name: F.sum(c).over(within) + F.col(f"_{name}") for name, c in sums.items()}).drop("_range", *[f"_{name}" for name in sums])


def curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score, highest first: tp and fp if it is the threshold, and the totals.

    Rows are reduced to distinct scores before any window; absent and undefined scores are lowest.
    """
    s = F.coalesce(F.when(F.isnan(F.col(score).cast("double")), None).otherwise(F.col(score).cast("double")), F.lit(-1e9))
    counts = scored.groupBy(s.alias("threshold")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    totals = counts.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return running(counts.crossJoin(F.broadcast(totals)), "threshold", {"tp": "p", "fp": "n"}, descending=True)


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counting half."""
    return curve(scored, label, score).agg(
        (F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.first(F.col("pos") * F.col("neg"))).alias("auc")
    )


def youden(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The threshold of greatest TPR - FPR, the highest of several."""
    rated = curve(scored, label, score).withColumn("j", F.round(F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg"), 12))
    best = rated.agg(F.max(F.struct("j", "threshold")).alias("best"))
    return best.select(F.col("best.threshold").alias("threshold"), F.col("best.j").alias("j"))


def best_f1(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The threshold of greatest F1, the highest of several."""
    rated = curve(scored, label, score).withColumn("f1", F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos")), 12))
    best = rated.agg(F.max(F.struct("f1", "threshold")).alias("best"))
    return best.select(F.col("best.threshold").alias("threshold"), F.col("best.f1").alias("f1"))


def confusion(scored: DataFrame, keys: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy by keys; measures without a basis are 0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = scored.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}
    )


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two boolean judgements, 0 where chance agreement is whole; rows with a null don't count."""
    held = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    moments = held.agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return moments.select("n", F.round("po", 6).alias("agreed"), F.round(F.when(pe >= 1, 0.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


def krippendorff_ordinal(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """Krippendorff's alpha for ordinal values; units with one rating or none don't count.

    Coincidences come from counts of values within units, so that no unit is ever paired with itself row by row.
    """
    per = ratings.where(F.col(value).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    size = per.groupBy("u").agg(F.sum("k").alias("m")).where("m > 1")
    held = per.join(size, "u")
    margin = held.groupBy("v").agg(F.sum("k").cast("double").alias("n"))
    upto = margin.withColumn("c", F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)))  # one row per value of the scale
    a, b = upto.select(F.col("v").alias("v1"), F.col("n").alias("n1"), F.col("c").alias("c1")), upto.select(F.col("v").alias("v2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    # squared ordinal distance: what lies between two values, their own counts half
    gaps = a.join(b, F.col("v1") < F.col("v2")).withColumn("d", F.pow(F.col("c2") - F.col("c1") + F.col("n1") / 2 - F.col("n2") / 2, 2))
    expected = gaps.agg((2 * F.sum(F.col("n1") * F.col("n2") * F.col("d"))).alias("de"))
    x = held.select("u", "m", F.col("v").alias("v1"), F.col("k").alias("k1"))
    y = held.select("u", F.col("v").alias("v2"), F.col("k").alias("k2"))
    together = x.join(y, "u").where("v1 < v2").groupBy("v1", "v2").agg(F.sum(F.col("k1") * F.col("k2") / (F.col("m") - 1)).alias("o"))
    observed = together.join(gaps, ["v1", "v2"]).agg((2 * F.sum(F.col("o") * F.col("d"))).alias("do"))
    total = margin.agg(F.sum("n").alias("total"))
    return observed.crossJoin(expected).crossJoin(total).select(
        F.round(1 - (F.col("total") - 1) * F.coalesce("do", F.lit(0.0)) / F.col("de"), 6).alias("alpha")
    )


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the average rank of each value, from counts of distinct values."""
    counts = df.groupBy(value).agg(F.count("*").alias("_k"))
    ranks = running(counts, value, {"_upto": "_k"}).select(value, (F.col("_upto") - (F.col("_k") - 1) / 2).alias(name))
    return df.join(ranks, value)


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """Holm's step-down correction: adds p_holm."""
    order = W.orderBy(p)
    m = F.count("*").over(W.partitionBy())
    raised = tests.withColumn("_r", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return raised.withColumn("p_holm", F.max("_r").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_r")
