"""Connected components of rows that share a value."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F


def _kept(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read again, so that no round is computed twice."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/tessera-shared"
    path = f"{folder.rstrip('/')}/tessera-components/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_components(members: DataFrame, node: str, value: str, max_rounds: int = 50) -> DataFrame:
    """(node, component): nodes that share a value are one component, named by its least node.

    Labels go from nodes to values and back as minima, which pre-aggregate before each shuffle: a value that a
    third of the nodes share costs no more than others, and no pair of nodes is ever formed. Labels also jump to
    their label's label, so that chains shorten by half in each round.
    """
    edges = _kept(members.where(F.col(node).isNotNull() & F.col(value).isNotNull()).select(F.col(node).alias("node"), F.col(value).alias("value")).distinct())
    labels = _kept(edges.select("node").distinct().withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        by_value = edges.join(labels, "node").groupBy("value").agg(F.min("component").alias("low"))
        lower = edges.join(by_value, "value").groupBy("node").agg(F.min("low").alias("low"))
        stepped = labels.join(lower, "node").select("node", F.least("component", "low").alias("component"), F.col("component").alias("was"))
        jump = stepped.select(F.col("node").alias("component"), F.col("component").alias("root"))
        now = _kept(stepped.join(jump, "component", "left").select("node", F.coalesce("root", "component").alias("component"), "was"))
        labels = now.select("node", "component")
        if now.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
