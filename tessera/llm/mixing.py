"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's rows fall into BLOCKS blocks by a hash of their id, and a source's blocks have a permuted order
of its own. A source's quota is a number of block draws: whole passes over its blocks, then a last pass that takes, in
permuted order, every block that still fits (or leaves them out, where that is the smaller part). What is missing then
is filled by finer cuts of the ids left, each by a hash of its own, and last by single ids. The quotas of all sources are
split among the output shards from the root of a binary tree down: each node draws its left half's share of
every source from the multivariate hypergeometric law, so that the shards partition the quotas exactly. A
source's draws are then dealt to the shards in order, which keeps the shards' blocks disjoint; within a shard
rows are ordered by a hash.

Per source there is one small row (target, passes, blocks taken, finer cuts, shard boundaries); rows find their decision from it
by arithmetic on their block, so that no text moves and a source of any share is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm._common import as_bytes, free_name, settled

BLOCKS = 1024
SHARDS = 16
SHARE = 1.5
WEIGHTS = (3.0, 1.0, 2.0)
CEILING = 2.0
#: A finer cut's slots hold about this part of what is missing.
FINER = 64
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _words(text: bytes) -> int:
    """Runs of other bytes than x20 and x09-x0D."""
    blank = BLANK[np.frombuffer(b" " + text, np.uint8)]
    return int((blank[:-1] & ~blank[1:]).sum())


def word_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size): words of each text, 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([_words(t) for t in as_bytes(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["id", "source", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, source string, size long")


def targets(sizes: list[int], share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING) -> list[float]:
    """Words wanted of each source: `share` of all by repeating weights, none above `ceiling` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        rate = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if rate * weight[i] > ceiling * sizes[i]}
        if not full:
            for i in open_:
                out[i] = rate * weight[i]
            break
        for i in full:
            out[i] = ceiling * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[source] block draws, split into out[source, shard]; shards are as even in all as can be."""
    if shards == 1:
        return quotas[:, None]
    left = shards // 2
    draws = int(quotas.sum())
    taken = rng.multivariate_hypergeometric(quotas, draws * left // shards, method="marginals") if draws else quotas * 0
    return np.hstack([split_tree(taken, left, rng), split_tree(quotas - taken, shards - left, rng)])


def _block(seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(BLOCKS))


def _rank(seed: int):
    """Place of a row's block in its source's permuted order: an affine map with an odd factor is a permutation."""
    h = F.xxhash64(F.lit(seed + 1), F.col("source"))
    factor = F.pmod(h, F.lit(BLOCKS // 2)) * 2 + 1
    shift = F.pmod(F.shiftright(h, 20), F.lit(BLOCKS))
    return F.pmod(_block(seed) * factor + shift, F.lit(BLOCKS))


RECIPE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("passes", T.IntegerType()),
        T.StructField("skips", T.BooleanType()),
        T.StructField("goal", T.DoubleType()),
        T.StructField("prefix", T.IntegerType()),
        T.StructField("places", T.ArrayType(T.ShortType())),
        T.StructField("bounds", T.ArrayType(T.LongType())),
    ]
)


def fitting(words: np.ndarray, goal: float) -> np.ndarray:
    """Which of the parts are taken: in order, each that the goal still has room for."""
    taken, left = np.zeros(len(words), bool), goal
    for i, w in enumerate(words.tolist()):
        if w <= left:
            taken[i], left = True, left - w
    return taken


def recipe(sized: DataFrame, seed: int = 17, shards: int = SHARDS) -> DataFrame:
    """One row per source: its target and how its rows are drawn. `sized` has id, source, size."""
    spark = sized.sparkSession
    blocks = sized.groupBy("source", _rank(seed).alias("rank")).agg(F.sum("size").alias("words"))
    # One row per source, BLOCKS words counts at most in each: as many sources as the mix names, whatever the rows.
    per = blocks.groupBy("source").agg(
        F.sum("words").alias("source_size"), F.sort_array(F.collect_list(F.struct("rank", "words"))).alias("blocks")
    )
    rows = sorted(per.collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    wanted = targets([r.source_size for r in rows])
    plan = []
    for r, target in zip(rows, wanted):
        passes = int(target // r.source_size) if r.source_size else 0
        goal = target - passes * r.source_size
        # of a last pass that takes more than half, what it leaves out is chosen: the fewer words are the choice
        if skips := goal > r.source_size / 2:
            passes, goal = passes + 1, r.source_size - goal
        words = np.zeros(BLOCKS, np.int64)
        for b in r.blocks:
            words[b["rank"]] = b["words"]
        taken = fitting(words, goal) if goal > 0 else np.zeros(BLOCKS, bool)
        # the blocks that are taken come first, so that they are a prefix of the places
        places = np.empty(BLOCKS, int)
        places[np.argsort(~taken, kind="stable")] = np.arange(BLOCKS)
        plan.append((r.source, r.source_size, target, passes, skips, goal, int(taken.sum()), places.tolist()))
    quotas = np.array([p[3] * BLOCKS + (-p[6] if p[4] else p[6]) for p in plan], np.int64)
    dealt = split_tree(quotas, shards, np.random.default_rng(seed)) if plan else np.zeros((0, shards), np.int64)
    # written, so that its small size is known and the rows need no shuffle to meet it
    return settled(spark.createDataFrame([(*p, np.cumsum(d).tolist()) for p, d in zip(plan, dealt)], RECIPE))


def _decide(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds to rows (id, source, ...) their source's recipe and `rank`, the place of their block."""
    named = sources.withColumnRenamed("source", "of")
    return rows.join(named, rows["source"].eqNullSafe(named["of"]), "left").drop("of").withColumn("rank", F.get("places", _rank(seed).cast("int")).cast("long"))


def _slot(seed: int, level, modulus):
    """Slot of an id in the finer cut `level`."""
    return F.pmod(F.xxhash64(F.lit(seed + 3), level, F.col("id")), modulus)


def _is_fit(seed: int):
    """Whether a row that no block takes is taken by a finer cut of its source or by itself."""
    in_cut = F.exists("cuts", lambda c: F.array_contains(c["slots"], _slot(seed, c["level"], c["modulus"])))
    return F.coalesce(in_cut | (F.col("id").isNotNull() & F.coalesce(F.array_contains("singles", F.col("id")), F.lit(False))), F.lit(False))


def _fits(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(source, cuts, singles): what brings each source nearer its goal than its blocks do, until no id does.

    A cut deals the ids left into slots by a new hash and looks at BLOCKS of them, which it takes in order where they
    fit; the less is missing, the more slots there are, and so the fewer words in each. Cuts end when one takes nothing
    of any source; then each round adds the best-fitting id to every source that an id brings nearer its goal.
    """
    spark = sized.sparkSession
    ids = settled(
        _decide(sized, sources, seed)
        .where("goal > 0 AND size > 0")
        .groupBy("source", "goal", "id")
        .agg(F.sum("size").alias("size"), F.sum(F.when(F.col("rank") < F.col("prefix"), F.col("size")).otherwise(0)).alias("drawn"))
    )
    gaps = {
        r.source: r.gap
        for r in ids.groupBy("source").agg((F.first("goal") - F.sum("drawn")).alias("gap")).collect()
    }
    kind = sized.schema["id"].dataType
    cut = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("modulus", T.LongType()), T.StructField("slots", T.ArrayType(T.LongType()))])
    chosen: dict = {source: ([], []) for source in gaps}
    shape = T.StructType(
        [T.StructField("of", T.StringType()), T.StructField("gap", T.DoubleType()), T.StructField("cuts", T.ArrayType(cut)), T.StructField("singles", T.ArrayType(kind))]
    )

    def left():
        """The ids that nothing takes yet, with their source's gap."""
        wanted = spark.createDataFrame([(s, float(g), *chosen[s]) for s, g in gaps.items() if g > 0], shape)
        return ids.where("drawn = 0").join(F.broadcast(wanted), ids["source"].eqNullSafe(wanted["of"])).where(~_is_fit(seed))

    level, took = 0, any(g > 0 for g in gaps.values())
    while took:
        level, took = level + 1, False
        fit = F.col("size") <= F.col("gap")
        rated = left().groupBy("source", "gap").agg(F.sum(F.when(fit, F.col("size"))).alias("words"), F.count(F.when(~fit, 1)).alias("larger"))
        # few slots hold one of the larger ids
        sizes = [(r.source, max(BLOCKS, int(FINER * r.words / r.gap), r.larger)) for r in rated.collect() if r.words]
        if not sizes:
            break
        moduli = spark.createDataFrame(sizes, "name string, modulus long")
        slots = left().join(F.broadcast(moduli), F.col("source").eqNullSafe(F.col("name"))).withColumn("slot", _slot(seed, F.lit(level), F.col("modulus")))
        # BLOCKS slots of a source at most, whatever the rows
        parts: dict = {}
        for r in slots.where(F.col("slot") < BLOCKS).groupBy("source", "modulus", "slot").agg(F.sum("size").alias("words")).collect():
            parts.setdefault((r.source, r.modulus), []).append((r.slot, r.words))
        for (source, modulus), found in parts.items():
            found.sort()
            words = np.array([w for _, w in found])
            if (taken := fitting(words, gaps[source])).any():
                chosen[source][0].append((level, modulus, [f[0] for f, t in zip(found, taken) if t]))
                gaps[source] -= int(words[taken].sum())
                took = True
    while any(g > 0 for g in gaps.values()):
        best = (
            left()
            .where("id IS NOT NULL AND size < 2 * gap")
            .groupBy("source")
            .agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "id", "size")).alias("best"))
            .collect()
        )
        if not best:
            break
        for r in best:
            chosen[r.source][1].append(r.best["id"])
            gaps[r.source] -= r.best["size"]
    shape = T.StructType([T.StructField("source", T.StringType()), *shape.fields[2:]])
    return settled(spark.createDataFrame([(s, *c) for s, c in chosen.items()], shape))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, shards: int = SHARDS, carry: bool = False
) -> DataFrame:
    """One row per input row: id, source_size, target, copies int, shards array<int> (one for each copy), size.

    copies is 0 to 2. A source's drawn words come so near its target that no further id brings them nearer. Null sources are one source, last in order; texts without words and sources without words are drawn
    with copies that add no words; equal ids share their decision; reruns agree as all draws are seeded. An empty
    table gives no rows. With carry, the row's own columns come as the struct `row`, whatever their names.
    """
    sized = settled(word_sizes(docs, id_col, text_col, source_col))
    sources = recipe(sized, seed, shards)
    fits = _fits(sized, sources, seed).withColumnRenamed("source", "of_fits")
    rows = sized
    if carry:
        rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.struct("*").alias("row"))
    known = _decide(rows, sources, seed)
    known = known.join(fits, known["source"].eqNullSafe(fits["of_fits"]), "left")
    in_block = F.col("rank") < F.col("prefix")
    beside = ~in_block & F.coalesce(_is_fit(seed), F.lit(False))
    last = F.col("passes") - 1
    # numbers of a row's draws among its source's: pass by pass, in the permuted order of blocks
    whole = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.when((k < F.col("passes")) & ~(F.col("skips") & (k == last)), k * BLOCKS + F.col("rank")))
    extra = F.when(F.col("skips") & ~in_block & ~beside, last * BLOCKS + F.col("rank") - F.col("prefix")).when(~F.col("skips") & in_block, F.col("passes") * BLOCKS + F.col("rank"))
    draws = F.concat(whole, F.array(extra))
    to_shard = lambda d: F.size(F.filter(F.col("bounds"), lambda b: b <= d)).cast("int")
    placed = F.transform(F.array_compact(draws), lambda d: F.least(to_shard(d), F.lit(shards - 1)))
    # what is taken beside the blocks goes to any shard
    single = F.when(~F.col("skips") & beside, F.pmod(F.xxhash64(F.lit(seed + 4), F.col("id")), F.lit(shards)).cast("int"))
    placed = F.concat(placed, F.array_compact(F.array(single)))
    out = known.withColumn("shards", placed).withColumn("copies", F.size("shards"))
    head = ["row"] if carry else [F.col("id").alias(id_col), F.col("size")]
    return out.select(*head, "source_size", "target", "copies", "shards")


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, shards: int) -> DataFrame:
    """(row, shard, order): every row as often as it is drawn."""
    plan = mix_plan(docs, id_col, text_col, source_col, seed, shards, carry=True)
    copies = plan.select("row", F.posexplode("shards").alias("copy", "shard"))
    own = F.col("row")
    return copies.withColumn("order", F.xxhash64(F.lit(seed + 2), own.getField(id_col), own.getField(text_col).cast("string"), "copy"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, shards: int = SHARDS) -> DataFrame:
    """The mix itself: every row as often as it is drawn, with mix_shard int and mix_order long (place in the shard).

    A name that `docs` has already gets underscores before it until it is free.
    """
    names = free_name(docs.columns, "mix_shard"), free_name(docs.columns, "mix_order")
    return _copies(docs, id_col, text_col, source_col, seed, shards).select("row.*", F.col("shard").alias(names[0]), F.col("order").alias(names[1]))


def mix_in_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, shards: int = SHARDS) -> DataFrame:
    """The mix with the columns of `docs` alone, dealt out to partitions by shard and shuffled within each shard.

    Partitions, and the files they are written to, follow the shards; a shard of many rows has several.
    """
    copies = _copies(docs, id_col, text_col, source_col, seed, shards)
    return copies.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select("row.*")
