"""Antonyms from word vectors: maps from a word's vector to its antonym's, candidates ranked by cosine, and a guarded answer.

Vectors and pairs are lexicons: training pairs (a few thousand) come to the driver as matrices, and candidates, a
vocabulary of bounded size, are scored on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions import vectors as V

#: Pairs that a plane needs at least.
LEAST_PAIRS = 20
#: Training pairs that are taken to the driver at most.
MOST_PAIRS = 50_000
LEAST_CONFIDENCE = 0.15


def training_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(word, antonym, pos, x, y): pairs of which both words have a vector, with unit vectors."""
    side = lambda name, col: vectors.select(F.col("word").alias(name), V.unit(F.col("vec")).alias(col))
    return pairs.join(side("word", "x"), "word").join(side("antonym", "y"), "antonym").select("word", "antonym", "pos", "x", "y")


def _matrices(held: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    found = held.orderBy("word", "antonym", "pos").limit(MOST_PAIRS).collect()
    return np.array([r.x for r in found], float), np.array([r.y for r in found], float), [r.pos for r in found]


def linear_map(held: DataFrame, alpha: float = 1.0) -> np.ndarray | None:
    """The ridge map W of least |XW - Y|^2 + alpha |W|^2; null without pairs. Its sums are aggregates: no pair moves."""
    first = held.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d
    cells = held.select(F.posexplode("x").alias("i", "xi"), "x", "y").select("i", "xi", F.posexplode(F.concat("x", "y")).alias("j", "v"))
    sums = np.zeros((d, 2 * d))
    for r in cells.groupBy("i", "j").agg(F.sum(F.col("xi") * F.col("v")).alias("s")).collect():  # 2 d^2 rows
        sums[r.i, r.j] = r.s
    return np.linalg.solve(sums[:, :d] + alpha * np.eye(d), sums[:, d:])


def ridge_alpha(held: DataFrame, alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)) -> float:
    """The alpha of least error on a fifth of the training pairs, set aside by a hash of the word."""
    aside = F.pmod(F.xxhash64("word"), F.lit(5)) == 0
    x, y, _ = _matrices(held.where(aside))
    fit = held.where(~aside)
    errors = [float(((x @ w - y) ** 2).sum()) if len(x) and (w := linear_map(fit, a)) is not None else np.inf for a in alphas]
    return alphas[int(np.argmin(errors))]


def reflections(held: DataFrame, rounds: int = 50) -> dict[str, tuple[np.ndarray, float]]:
    """(normal, offset) by part of speech of the plane that best mirrors words into their antonyms.

    For pairs (x, y) the mirrored x is x - 2 (x.n - b) n. The normal starts as the leading direction of the differences
    and is refined by alternating exact steps: the offset for a normal, then the normal by a step down the squared error.
    """
    x, y, pos = _matrices(held)
    out = {}
    for part in sorted(set(pos)):
        own = np.array([p == part for p in pos])
        if own.sum() >= LEAST_PAIRS:
            out[part] = _plane(x[own], y[own], rounds)
    return out


def mirrored(x: np.ndarray, normal: np.ndarray, offset: float) -> np.ndarray:
    return x - 2 * (x @ normal - offset)[:, None] * normal


def _plane(x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    normal = np.linalg.svd(x - y, full_matrices=False)[2][0]

    def best_offset(n: np.ndarray) -> float:
        return float(((x @ n) + (y @ n)).mean() / 2)

    def error(n: np.ndarray) -> float:
        return float(((mirrored(x, n, best_offset(n)) - y) ** 2).sum())

    step, now = 0.1, error(normal)
    for _ in range(rounds):
        gap, far = y - mirrored(x, normal, best_offset(normal)), x @ normal - best_offset(normal)
        slope = 4 * (gap * far[:, None]).sum(0) + 4 * ((gap @ normal)[:, None] * x).sum(0)
        trial = normal - step * (slope - (slope @ normal) * normal) / max(np.linalg.norm(slope), 1e-12)
        trial /= np.linalg.norm(trial)
        if (then := error(trial)) < now:
            normal, now, step = trial, then, step * 1.2
        else:
            step /= 2
    return normal, best_offset(normal)


def negated(vec: Column) -> Column:
    """The baseline that turns a vector round."""
    return F.transform(V.unit(vec), lambda x: -x)


def predicted(words: DataFrame, vectors: DataFrame, planes: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """(word, pos, vec): words (word, pos) mirrored at the plane of their part of speech; words without either drop out."""
    held = words.join(vectors.select("word", V.unit(F.col("vec")).alias("v")), "word")
    spec = [(p, [float(a) for a in n], float(b)) for p, (n, b) in planes.items()]
    known = held.sparkSession.createDataFrame(spec, "pos string, normal array<double>, b double")
    joined = held.join(F.broadcast(known), "pos").withColumn("k", 2 * (V.dot(F.col("v"), F.col("normal")) - F.col("b")))
    return joined.select("word", "pos", F.zip_with("v", "normal", lambda x, n: x - F.col("k") * n).alias("vec"))


def ranked(queries: DataFrame, candidates: DataFrame, top: int = 10) -> DataFrame:
    """(word, pos, rank, candidate, score): for each query (word, pos, vec) the candidates (word, vec) of greatest cosine but
    itself. The smaller side is a lexicon's queries, broadcast if Spark finds it small; ties go to the smaller word."""
    left = queries.select("word", "pos", V.unit(F.col("vec")).alias("q"))
    right = candidates.select(F.col("word").alias("candidate"), V.unit(F.col("vec")).alias("c"))
    scored = left.join(right, F.col("word") != F.col("candidate")).select("word", "pos", "candidate", F.round(V.dot(F.col("q"), F.col("c")), 9).alias("score"))
    place = F.row_number().over(W.partitionBy("word", "pos").orderBy(F.desc("score"), "candidate"))
    return scored.withColumn("rank", place).where(F.col("rank") <= top)


def rank_of(ranks: DataFrame, gold: DataFrame) -> DataFrame:
    """(word, pos, best_rank): the best rank of a gold antonym (word, pos, antonym); null where none was ranked."""
    hits = gold.join(ranks.withColumnRenamed("candidate", "antonym"), ["word", "pos", "antonym"], "left")
    return hits.groupBy("word", "pos").agg(F.min("rank").alias("best_rank"))


def precision_at(ranks: DataFrame, gold: DataFrame, synonyms: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(n, p_1, ..., synonym_1): share of queries with a gold antonym among the first k, and with a synonym in first place."""
    best = rank_of(ranks, gold)
    first = ranks.where("rank = 1").join(synonyms.withColumnRenamed("synonym", "candidate"), ["word", "candidate"], "left_semi").select("word", "pos").distinct().withColumn("syn", F.lit(1.0))
    rated = best.join(first, ["word", "pos"], "left")
    share = lambda k: F.round(F.avg(F.coalesce((F.col("best_rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"p_{k}")
    return rated.agg(F.count("*").alias("n"), *[share(k) for k in ks], F.round(F.avg(F.coalesce("syn", F.lit(0.0))), 6).alias("synonym_1"))


def confidence(best: Column, second: Column) -> Column:
    """How far the best stands out: four times its lead, 1 at most, times its score between 0 and 1."""
    lead = F.least(F.lit(1.0), F.greatest(F.lit(0.0), best - second) * 4)
    return lead * F.greatest(F.lit(0.0), F.least(F.lit(1.0), best))


def answers(ranks: DataFrame, vetoed: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(word, pos, antonym, confidence): the best candidate that is no synonym (word, synonym) and only letters; none below
    `least`. A word without a sure answer has no row: no answer is better than a guess."""
    fit = ranks.join(vetoed.select("word", F.col("synonym").alias("candidate")), ["word", "candidate"], "left_anti").where(F.col("candidate").rlike(r"^\p{L}+$"))
    place = F.row_number().over(W.partitionBy("word", "pos").orderBy("rank"))
    two = fit.withColumn("n", place).where("n <= 2").groupBy("word", "pos").agg(F.max_by("candidate", -F.col("n")).alias("antonym"), F.max("score").alias("best"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("second"))
    sure = two.withColumn("confidence", F.round(confidence(F.col("best"), F.coalesce("second", F.lit(0.0))), 4))
    return sure.where(F.col("confidence") >= least).select("word", "pos", "antonym", "confidence")


def counter_fitted(vectors: dict[str, np.ndarray], antonyms: list[tuple[str, str]], synonyms: list[tuple[str, str]], rounds: int = 20, rate: float = 0.1, on_round: Callable[[int, float], None] | None = None) -> dict[str, np.ndarray]:
    """Vectors moved so that antonyms part and synonyms meet, while each stays near where it was; words without pairs stay.

    A lexicon's vectors, on the driver. Each round moves antonyms apart up to a cosine of 0 and synonyms together, then pulls
    every moved vector back towards its start.
    """
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-12)
    start = {w: unit(np.asarray(v, float)) for w, v in vectors.items()}
    now = dict(start)
    for k in range(rounds):
        moved = 0.0
        for pairs, pull in ((antonyms, False), (synonyms, True)):
            for a, b in pairs:
                if a in now and b in now and a != b:
                    x, y = now[a], now[b]
                    cos = float(x @ y)
                    size = rate * ((1 - cos) if pull else max(cos, 0.0))
                    sign = 1 if pull else -1
                    now[a], now[b] = unit(x + sign * size * y), unit(y + sign * size * x)
                    moved += size
        now = {w: v if v is start[w] else unit(v + rate * 0.1 * (start[w] - v)) for w, v in now.items()}
        if on_round:
            on_round(k, moved)
    return now
