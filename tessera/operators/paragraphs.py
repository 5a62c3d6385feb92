"""Paragraph matching: similarity of every teacher and student sentence of an item, one-to-one assignment, verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.functions import text


def similarities(items: DataFrame) -> DataFrame:
    """(id, t, s, sim, negated): overlap of each sentence pair of an item and whether their cue parities differ.

    items has id, teacher array<string>, student array<string>; pairs stay within their item.
    """
    spread = items.select("id", F.posexplode("teacher").alias("t", "a"), "student").select("id", "t", "a", F.posexplode("student").alias("s", "b"))
    sim = text.overlap(text.token_set(F.col("a")), text.token_set(F.col("b")))
    differs = text.cue_count(F.col("a")) % 2 != text.cue_count(F.col("b")) % 2
    return spread.select("id", "t", "s", sim.alias("sim"), differs.alias("negated"))


def greedy(matrix: np.ndarray) -> list[tuple[int, int]]:
    """Pairs by falling similarity, each row and column once; ties go to the lower row, then column."""
    order = np.lexsort((np.tile(np.arange(matrix.shape[1]), matrix.shape[0]), np.repeat(np.arange(matrix.shape[0]), matrix.shape[1]), -matrix.ravel()))
    rows: set[int] = set()
    columns: set[int] = set()
    out = []
    for k in order:
        i, j = divmod(int(k), matrix.shape[1])
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((i, j))
    return sorted(out)


def optimal(matrix: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of greatest total similarity, by shortest augmenting paths over dual prices."""
    if matrix.shape[0] > matrix.shape[1]:
        return sorted((j, i) for i, j in optimal(matrix.T))
    cost = -matrix
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)
    for i in range(n):
        owner[m], at = i, m
        least, before, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] != -1:
            done[at] = True
            row = owner[at]
            open_ = np.flatnonzero(~done[:m])
            slack = cost[row, open_] - u[row] - v[open_]
            better = slack < least[open_]
            least[open_[better]], before[open_[better]] = slack[better], at
            nearest = open_[least[open_].argmin()]
            step = least[nearest]
            used = np.flatnonzero(done)
            u[owner[used]] += step
            v[used] -= step
            least[open_] -= step
            at = nearest
        while at != m:
            owner[at] = owner[before[at]]
            at = before[at]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] != -1)


def assign(pairs: DataFrame, least: float = 0.2, method: str = "optimal") -> DataFrame:
    """(id, t, s, sim, negated) of the chosen pairs: those below `least` can't be chosen."""
    choose = {"optimal": optimal, "greedy": greedy}[method]

    def one(item: pd.DataFrame) -> pd.DataFrame:
        matrix = np.zeros((item.t.max() + 1, item.s.max() + 1))
        matrix[item.t, item.s] = np.where(item.sim >= least, item.sim, 0.0)
        chosen = pd.DataFrame([(i, j) for i, j in choose(matrix) if matrix[i, j] > 0], columns=["t", "s"])
        return item.merge(chosen, on=["t", "s"])[["id", "t", "s", "sim", "negated"]]

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.groupBy("id").applyInPandas(one, f"id {kind}, t int, s int, sim double, negated boolean")  # sentences of one item


def verdicts(items: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, t, verdict) of every teacher sentence: covered, contradicted or missing; and (id, s) of extra student sentences."""
    asked = items.select("id", F.posexplode("teacher").alias("t", "sentence")).drop("sentence")
    said = items.select("id", F.posexplode("student").alias("s", "sentence")).drop("sentence")
    verdict = F.when(F.col("s").isNull(), "missing").when(F.col("negated"), "contradicted").otherwise("covered")
    return asked.join(matched, ["id", "t"], "left").select("id", "t", verdict.alias("verdict")), said.join(matched, ["id", "s"], "left_anti")
