"""Combining pair features by a model: grouped folds, out-of-fold scores, threshold on them, refit on all."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tessera.operators import metrics


def _model(features: list[str], penalty: float) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
            LogisticRegression(featuresCol="_scaled", labelCol="label", regParam=penalty, probabilityCol="_p", rawPredictionCol="_m", predictionCol="_y"),
        ]
    )


def _scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows).withColumn("score", vector_to_array("_p")[1])
    return out.drop("_raw", "_scaled", "_m", "_p", "_y")


def with_folds(rows: DataFrame, group: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Adds `fold`; rows of one group share it."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(folds)).cast("int"))


def out_of_fold(rows: DataFrame, features: list[str], penalty: float, folds: int = 5) -> DataFrame:
    """The rows, each scored by a model that didn't see its fold."""
    parts = []
    for k in range(folds):
        fitted = _model(features, penalty).fit(rows.where(F.col("fold") != k))
        parts.append(_scored(fitted, rows.where(F.col("fold") == k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit(rows: DataFrame, features: list[str], group: str, penalties: tuple[float, ...] = (0.001, 0.01, 0.1)) -> tuple[PipelineModel, float, float]:
    """(model on all rows, threshold, penalty): the penalty of greatest out-of-fold Youden J, with its threshold."""
    held = with_folds(rows, group).persist()
    best = None
    for penalty in penalties:
        found = metrics.youden(out_of_fold(held, features, penalty)).first()
        if best is None or found.j > best[0]:
            best = (found.j, found.threshold, penalty)
    model = _model(features, best[2]).fit(held)
    held.unpersist()
    return model, best[1], best[2]


def predict(model: PipelineModel, threshold: float, rows: DataFrame) -> DataFrame:
    """Adds score and predicted."""
    return _scored(model, rows).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
