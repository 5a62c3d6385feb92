"""Paragraph matching, the combiner and the command line."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import combiner, paragraphs


def test_optimal_against_all_assignments():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 3), (3, 2), (4, 4), (5, 3)]:
        matrix = rng.random((n, m))
        k = min(n, m)
        best = max(sum(matrix[i, j] for i, j in zip(rows, columns)) for rows in itertools.combinations(range(n), k) for columns in itertools.permutations(range(m), k))
        assert abs(sum(matrix[i, j] for i, j in paragraphs.optimal(matrix)) - best) < 1e-9
        assert len(paragraphs.greedy(matrix)) == k


def test_verdicts(spark):
    items = spark.createDataFrame(
        [("x", ["the sun is hot", "water is wet", "ice is cold"], ["the sun is not hot", "my cat sleeps", "water is wet"])], "id string, teacher array<string>, student array<string>"
    )
    for method in ("optimal", "greedy"):
        found, extra = paragraphs.verdicts(items, paragraphs.assign(paragraphs.similarities(items), method=method))
        assert {r.t: r.verdict for r in found.collect()} == {0: "contradicted", 1: "covered", 2: "missing"}
        assert [r.s for r in extra.collect()] == [1]


def test_combiner_learns(spark):
    rows = spark.range(600).select(
        "id", (F.col("id") % 40).alias("g"), F.rand(1).alias("x"), F.rand(2).alias("z")
    ).withColumn("label", (F.col("x") + 0.1 * F.col("z") > 0.55).cast("int"))
    model, threshold, _ = combiner.fit(rows, ["x", "z"], "g", penalties=(0.001,))
    right = combiner.predict(model, threshold, rows).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a")).first().a
    assert right > 0.95
    folds = combiner.with_folds(rows, "g").groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n").alias("n")).first().n
    assert folds == 1


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "in.txt").write_text("The door is open.\n\nEveryone left.\n")
    assert cli.main([str(tmp_path / "in.txt"), "-o", str(tmp_path / "out"), "--quiet"]) == 0
    assert {r.variant for r in spark.read.json(str(tmp_path / "out")).collect()} >= {"The door is not open.", "No one left."}
    assert cli.main([str(tmp_path / "none.txt"), "-o", str(tmp_path / "out2")]) == 2
