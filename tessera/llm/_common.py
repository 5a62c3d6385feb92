"""What the operators of this subpackage share: tables, durable cuts of lineage, text columns as bytes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Where spark.checkpoint.dir is unset and Spark runs in one process, as in tests.
SHARED_DEFAULT = "/tmp/tessera-shared"
#: A key is hot from this part of all rows on, so that fewer keys than this can be hot.
HOT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of one process does without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = SHARED_DEFAULT
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and reread from a table in the shared folder.

    Cuts the lineage: a lost executor loses nothing, and text is not read again for each use. The table belongs to the
    driver's process and goes when that ends, or earlier by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-tables/{uuid.uuid4().hex}"
    files, at = _hadoop_path(spark, path)
    files.deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a settled table that nothing reads any more."""
    files, at = _hadoop_path(df.sparkSession, df.settled_at)
    files.delete(at, True)


def spread_join(rows: DataFrame, known: DataFrame, key: str, total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with known, which has one row per key and in `n` about how many rows have it; `total` sums up `n`.

    Keys of more than total / HOT rows, fewer than HOT by counting, are broadcast, so that their rows stay where they
    are; the others are joined by a shuffle in which no key has more than that part of all rows. The column n goes.
    Whether there are such keys is looked up at once, so settle `known` before: without them the plan is one join.
    """
    if (known.agg(F.max(n)).first()[0] or 0) * HOT <= total:
        return rows.join(known.drop(n), key, how)
    hot = known.where(F.col(n) * HOT > total)
    cold = known.where(F.col(n) * HOT <= total).drop(n)
    held = rows.join(F.broadcast(hot.drop(n)), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return held.unionByName(rest)


def free_name(columns: list[str], wanted: str) -> str:
    """`wanted`, with underscores before it until no column has the name, whatever its case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def as_text(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A string column as str; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def bucket(column: str, modulus: int):
    """crc32 of a column as text, modulo `modulus`; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def runs(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about `limit` at most; a larger one stands alone."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            out.append((first, i))
            first, held = i, 0
        held += size
    if sizes:
        out.append((first, len(sizes)))
    return out


def ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of the counts, one after the other."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(firsts - total + counts, counts)
