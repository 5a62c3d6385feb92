"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws -ln(u) / weight from a hash of the key and the child's name, and the least
draw wins. A child's draws depend on its own name and weight alone, so a changed weight moves keys only into
or out of the subtree that changed, and a new shard, which joins as a region of its own, takes rows only into
itself. Everything is a column expression: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.llm._common import settled

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
#: Racks in a region and shards in a rack.
RACKS, SHARDS = 2, 4


def tree(founded: int, added: int = 0) -> Tree:
    """Shards 0 to founded - 1 in regions of 2 racks of 4 shards, the last ones as full as the number allows, and each shard
    added later in a region of its own.

    tree(n, 1) equals tree(n) plus one region, whatever n, so that growth by one shard moves rows into that shard only.
    """
    out: Tree = {}
    for s in range(founded):
        rack = s // SHARDS
        out.setdefault(f"r{rack // RACKS}", {}).setdefault(f"k{rack % RACKS}", {})[s] = 1.0
    return out | {f"x{s}": {"k0": {s: 1.0}} for s in range(founded, founded + added)}


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of rate `weight`, fixed by the key and the child's name."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def _least(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """What stands for the child with the least draw; a child of no weight never wins."""
    live = {name: x for name, x in children.items() if x[0] > 0}
    if len(live) == 1:
        return next(iter(live.values()))[1]
    drawn = F.array_min(F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, (w, _)) in enumerate(live.items())]))["i"]
    out = None
    for i, (_, value) in enumerate(live.values()):
        out = F.when(drawn == i, value) if out is None else out.when(drawn == i, value)
    return out


def shard_of(key: Column, nodes: Tree) -> Column:
    """The shard of a key: three draws down the tree. A null key is hashed like any other value."""
    regions = {}
    for region, racks in nodes.items():
        below = {}
        for rack, shards in racks.items():
            leaves = {f"{region}/{rack}/{s}": (w, F.lit(s)) for s, w in shards.items()}
            below[f"{region}/{rack}"] = (sum(shards.values()), _least(key, leaves))
        regions[region] = (sum(w for w, _ in below.values()), _least(key, below))
    return _least(key, regions)


def shard_rows(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 its unsigned CRC-32 (null: null). grown_shard is
    the shard with one shard more. Slots run from 0 without gaps in each shard, in input order. Equal ids share a
    shard; null ids are one more key; repeated rows each get a slot; an empty table gives no rows. Only the two
    columns named are read, so further columns may have any names.
    """
    key = F.col("id")
    rows = settled(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .select(
            "id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("split"),
            F.monotonically_increasing_id().alias("ord"),
        )
        .withColumns({"shard": shard_of(key, tree(n_shards)), "grown_shard": shard_of(key, tree(n_shards, 1))})
    )
    # A group is a shard's rows of one input split, so no group grows with the shard.
    counts = rows.groupBy("shard", "split").count()
    before = counts.select("shard", "split", (F.sum("count").over(W.partitionBy("shard").orderBy("split")) - F.col("count")).alias("before"))
    placed = rows.withColumn("nth", F.row_number().over(W.partitionBy("shard", "split").orderBy("ord")))
    return placed.join(before, ["shard", "split"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
