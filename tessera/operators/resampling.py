"""Resampling inference from counts: one aggregation over the rows, then seeded draws of what resampling them would give.

Resampling n rows of 0 and 1 with replacement gives a binomial count, flipping signs of paired differences gives a
binomial count of the discordant pairs, and resampling groups gives multinomial counts of distinct group sums. So the
draws need the counts only, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def accuracy_interval(rows: DataFrame, correct: str, draws: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high) of a boolean or 0/1 column; nulls don't count."""
    got = rows.where(F.col(correct).isNotNull()).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("k")).first()
    if not got.n:
        return (float("nan"),) * 3
    means = np.random.default_rng(seed).binomial(got.n, got.k / got.n, draws) / got.n
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return got.k / got.n, float(low), float(high)


def paired_permutation(rows: DataFrame, a: str, b: str, draws: int = 10000, seed: int = 0) -> float:
    """Two-sided p-value that two systems are right equally often, smoothed by one."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    got = rows.agg(F.count_if(x > y).alias("more"), F.count_if(x < y).alias("less")).first()
    m, seen = got.more + got.less, abs(got.more - got.less)
    flipped = np.abs(2 * np.random.default_rng(seed).binomial(m, 0.5, draws) - m)
    return float((np.sum(flipped >= seen) + 1) / (draws + 1))


def cluster_interval(rows: DataFrame, group: str, value: str, draws: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high) of a column when whole groups are resampled; groups of equal sum and size are one class."""
    per = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.round(F.sum(F.col(value).cast("double")), 6).alias("s"), F.count("*").alias("n"))
    classes = per.groupBy("s", "n").count().orderBy("s", "n").collect()
    if not classes:
        return (float("nan"),) * 3
    s, n, k = (np.array([r[c] for r in classes], float) for c in ("s", "n", "count"))
    times = np.random.default_rng(seed).multinomial(int(k.sum()), k / k.sum(), draws)
    means = (times @ s) / np.maximum(times @ n, 1)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float((s * k).sum() / (n * k).sum()), float(low), float(high)
