"""Fitting of polarity scores to labelled pairs: the gate of a score, and the weights of cues, by area under the curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions import lexicons, polarity as Y

GRID = [round(k / 10, 1) for k in range(1, 11)]
QUANTILES = [round(0.05 * k, 2) for k in range(20)]
#: Decimals that scores are compared to.
PLACES = 9


def auc_by(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """(keys, auc): the area under each group's curve, ties half; groups come from a grid, so there are few of them.

    Rows are reduced to counts of distinct scores before the window.
    """
    counts = df.groupBy(*keys, F.round(score, PLACES).alias("_s")).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    below = F.sum("n").over(W.partitionBy(*keys).orderBy("_s")) - F.col("n")
    summed = counts.withColumn("w", F.col("p") * (below + F.col("n") / 2)).groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return summed.select(*keys, F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("auc"))


def fit_gate(pairs: DataFrame, sim: str = "cos", delta: str = "delta", label: str = "label") -> DataFrame:
    """(gate, auc): of twenty quantiles of the similarity the gate behind which the difference of polarities separates best, the
    lowest of several."""
    cuts = pairs.agg(F.percentile(sim, F.array(*map(F.lit, QUANTILES))).alias("cuts"))
    tried = pairs.crossJoin(F.broadcast(cuts)).withColumn("gate", F.explode(F.array_distinct("cuts")))  # one row of twenty numbers
    scored = tried.select("gate", F.col(label).alias("label"), F.when(F.col(sim) >= F.col("gate"), F.abs(F.col(delta))).otherwise(0.0).alias("score"))
    best = auc_by(scored, ["gate"]).agg(F.max(F.struct(F.round("auc", 9).alias("auc"), (-F.col("gate")).alias("low"))).alias("x"))
    return best.select((-F.col("x.low")).alias("gate"), F.col("x.auc").alias("auc"))


def _score(families: dict[str, float], intensities: dict[str, float], cos: Column) -> Column:
    return F.abs(Y.strongest(F.col("b_cues"), families, intensities) - Y.strongest(F.col("a_cues"), families, intensities)) * cos


def fit_weights(pairs: DataFrame, rounds: int = 2, families: dict[str, float] | None = None, intensities: dict[str, float] | None = None) -> tuple[dict[str, float], dict[str, float], list[float]]:
    """(family weights, intensity weights, areas after each round): coordinate ascent on the area under the curve of the
    difference of polarities (v5) times cosine.

    pairs has a_cues, b_cues (of Y.analysis), cos and label. Each weight goes over GRID in one job that scores every value at
    once; a value is taken if it gains over 1e-6. Weights of cues that don't occur stay.
    """
    weights = {"family": dict(families or lexicons.FAMILY_WEIGHT), "intensity": dict(intensities or lexicons.INTENSITY_WEIGHT)}

    def areas(tries: list[dict]) -> list[float]:
        scores = F.array(*[_score(t["family"], t["intensity"], F.col("cos")) for t in tries])
        found = auc_by(pairs.select("label", F.posexplode(scores).alias("k", "score")), ["k"]).collect()  # a row per try
        by = {r.k: r.auc or 0.0 for r in found}
        return [by.get(k, 0.0) for k in range(len(tries))]

    best = areas([weights])[0]
    trace = [round(best, 4)]
    for _ in range(rounds):
        for group in sorted(weights):
            for key in sorted(weights[group]):
                tries = [{**weights, group: {**weights[group], key: value}} for value in GRID]
                for trial, area in zip(tries, areas(tries)):
                    if area > best + 1e-6:
                        best, weights = area, trial
        trace.append(round(best, 4))
    return weights["family"], weights["intensity"], trace
