"""Selecting, splitting and de-duplicating rows deterministically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def half(a: Column, b: Column) -> Column:
    """'fit' or 'select' by the parity of a pair's digest."""
    last = F.substr(F.sha1(F.concat(a, F.lit("\t"), b).cast("binary")), F.lit(40), F.lit(1))
    return F.when(last.isin(*"02468ace"), "fit").otherwise("select")


def hash_split(key: Column, share: float, seed: int = 0) -> Column:
    """Whether a key falls in a share of the key space: rows of one key go together, and no sort is needed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long") < int(share * (1 << 32))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds `place` (1 is kept) of each row among those of equal keys, in the order given."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def round_robin(df: DataFrame, group: str, stratum: str, order: list[Column], k: int) -> DataFrame:
    """k rows of each group, one of each stratum in turn; `order` ranks a stratum's rows, the first k of which do."""
    nth = F.row_number().over(W.partitionBy(group, stratum).orderBy(*order))
    ranked = df.withColumn("_n", nth).where(F.col("_n") <= k)
    place = F.row_number().over(W.partitionBy(group).orderBy("_n", stratum))
    return ranked.withColumn("_p", place).where(F.col("_p") <= k).drop("_n", "_p")


def quotas(counts: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, quota): shares of `total` in proportion to `count`, at least 1 each, what is left to the largest."""
    whole = F.sum("count").over(W.partitionBy())  # one row per stratum
    base = counts.withColumn("quota", F.greatest(F.floor(F.col("count") * total / whole), F.lit(1)).cast("long"))
    left = F.lit(total) - F.sum("quota").over(W.partitionBy())
    first = F.row_number().over(W.orderBy(F.desc("count"), stratum)) == 1
    return base.withColumn("quota", F.col("quota") + F.when(first, left).otherwise(0)).select(stratum, "quota")


def covering(df: DataFrame, candidate: str, item: str) -> DataFrame:
    """Candidates that have every item there is (relational division)."""
    had = df.groupBy(candidate).agg(F.countDistinct(item).alias("_had"))
    every = df.agg(F.countDistinct(item).alias("_every"))
    return had.join(F.broadcast(every), F.col("_had") == F.col("_every")).select(candidate)  # one row
