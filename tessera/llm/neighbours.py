"""Approximate nearest neighbours: inverted lists with an adaptive scan of dimensions.

Every vector goes to the list of its nearest centre; a query is held against the lists of its nearest centres, as many
as a sample needs for RECALL. There are about sqrt(rows) lists, so that a list and the queries that probe it grow
slowly. Vectors are rotated at random, so that any first d of D columns are a sample of the distance. Within a list the
candidates are scanned in blocks of columns; after each block those are abandoned whose distance, scaled up from
the columns seen, is beyond the k-th best known by more than chance (1 + EPSILON / sqrt(d)) and rounding allow; the
k that set the bound always stay. A query's nearest list is scanned first; the k-th best found there bounds the scans of
its other lists from the start. Survivors are measured exactly on the original vectors. A long list is cut into chunks
and many queries of a list into blocks, so that a task holds a bounded number of both.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.llm._common import runs, settled
from tessera.llm.lattice import _length, _unpacked, marked_vectors

#: Lists are this times the root of the rows, and at most a 16th of the sample.
LISTS = 1.0
#: Vectors that the centres are fitted to at most, and of them the queries that the number of probed lists is fitted to.
SAMPLE, ASKED = 20000, 400
#: Recall within the sample that fixes how many lists are probed.
RECALL = 0.95
#: Rows, and queries, of a list that a task holds.
CHUNK = 16384
COLUMNS = 16
EPSILON = 2.1
#: Rounding allowed for in a squared distance, as a part of both squared lengths and for each column.
ROUNDING = 8 * np.finfo(float).eps
SEED = 3


def fit_centres(vectors: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """k-means centres; as many as the sample bears (16 vectors for each)."""
    n = max(1, min(lists, len(vectors) // 16))
    rng = np.random.default_rng(SEED)
    centres = vectors[rng.choice(len(vectors), n, replace=False)]
    for _ in range(rounds):
        near = nearest(vectors, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        counts = np.bincount(near, minlength=n)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each vector, nearest first."""
    gaps = (centres**2).sum(1)[None] - 2 * vectors @ centres.T
    return np.argsort(gaps, axis=1, kind="stable")[:, :k]


def fit_probed(vectors: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = ASKED) -> int:
    """The least number of lists that hold `recall` of the k nearest of the sample's vectors.

    The first `asked` of the sample are queries.
    """
    own = nearest(vectors, centres, 1)[:, 0]
    queries = vectors[:asked]
    gaps = (vectors**2).sum(1)[None] - 2 * queries @ vectors.T
    gaps[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    m = min(k, len(vectors) - 1)
    if not m:
        return len(centres)
    near = np.argpartition(gaps, m - 1, axis=1)[:, :m]
    order = nearest(queries, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None], 1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


@functools.lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scan(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, distance): the k nearest of the rows for each query, but for rows of the query's own id.

    known is a distance for each query that k other rows are known not to exceed: rows beyond it may be left out.
    """
    if not len(rows) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    dim = queries.shape[1]
    turn = rotation(dim)
    q_all, x = queries @ turn, rows @ turn
    x_long = (x**2).sum(1)
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, (1 << 20) // max(1, len(rows)))
    for at in range(0, len(queries), step):
        q, original, ids = q_all[at : at + step], queries[at : at + step], query_ids[at : at + step]
        width = min(COLUMNS, dim)
        part = (q[:, :width] ** 2).sum(1)[:, None] + (x[:, :width] ** 2).sum(1)[None] - 2 * q[:, :width] @ x[:, :width].T
        part[ids[:, None] == row_ids[None]] = np.inf
        # the k that look nearest so far, measured in full, bound the k-th best
        m = min(k, len(rows))
        lead = np.argpartition(part, m - 1, axis=1)[:, :m]
        full = ((q[:, None, :] - x[lead]) ** 2).sum(2)
        full[np.isinf(np.take_along_axis(part, lead, 1))] = np.inf
        bound = full.max(1)
        if known is not None:
            bound = np.minimum(bound, known[at : at + step] ** 2 * (1 + 1e-9))
        room = ROUNDING * dim * ((q**2).sum(1)[:, None] + x_long[None])
        leads = np.zeros(part.shape, bool)
        np.put_along_axis(leads, lead, True, 1)
        i, j = np.nonzero(leads | (part * (dim / width) <= bound[:, None] * (1 + EPSILON / np.sqrt(width)) ** 2 + room))
        seen = part[i, j]
        own = np.isfinite(seen)
        i, j, seen = i[own], j[own], seen[own]
        room, leads = room[i, j], leads[i, j]
        while width < dim:
            upto = min(width + COLUMNS, dim)
            for lo in range(0, len(i), 1 << 16):
                a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                seen[lo : lo + (1 << 16)] += ((q[a, width:upto] - x[b, width:upto]) ** 2).sum(1)
            width = upto
            # all columns seen: only rounding is left to allow for
            slack = (1 + EPSILON / np.sqrt(width)) ** 2 if width < dim else 1 + 1e-9
            stay = leads | (seen * (dim / width) <= bound[i] * slack + room)
            i, j, seen, room, leads = i[stay], j[stay], seen[stay], room[stay], leads[stay]
        exact = np.sqrt(((original[i] - rows[j]) ** 2).sum(1))
        order = np.lexsort((row_ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        found.append((ids[i[best]], row_ids[j[best]], exact[best]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, lists: float = LISTS, recall: float = RECALL
) -> DataFrame:
    """query_id long, rank int from 1, vec_id long, score double: the k nearest found by Euclidean distance.

    Queries are the rows whose id is divisible by `every`, candidates all rows of other ids. All rows are indexed;
    the centres and the number of lists that a query probes are fitted to at most SAMPLE of them, picked by a hash of the
    id. Ties go to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components take no part,
    nor do null ids, nor vectors of another length than most of the sample. Repeated rows are found as often as they are
    there. A query whose probed lists hold fewer than k candidates is held against all lists, so that it gets k or all
    that there are; an empty table gives no rows.
    """
    good = settled(
        marked_vectors(vectors, id_col, vec_col).where("key IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vec")
    )
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    raw = [bytes(r.vec) for r in good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()]
    if not raw:
        return spark.createDataFrame([], shape)
    dim = int(pd.Series([_length(r) for r in raw]).mode().iloc[0])
    picked = _unpacked([r for r in raw if _length(r) == dim])
    centres = fit_centres(picked, int(np.ceil(lists * np.sqrt(good.count()))))
    probed = fit_probed(picked, centres, k, recall)

    def assign(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vecs = batch.column(1).to_pylist()
                keep = [i for i, v in enumerate(vecs) if _length(v) == dim]
                if keep:
                    near = nearest(_unpacked([vecs[i] for i in keep]), centres, count).astype(np.int32)
                    own = batch.take(pa.array(keep))
                    lists_of = pa.FixedSizeListArray.from_arrays(pa.array(near.reshape(-1)), count).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists_of], ["id", "vec", "lists"])

        return run

    named = "id long, vec binary, lists array<int>"
    rows = settled(good.mapInArrow(assign(1), named).select("id", "vec", F.element_at("lists", 1).alias("list")))
    # one query for each id
    asked = good.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    queries = settled(asked.mapInArrow(assign(probed), named))
    counts = sorted((r["list"], r["count"]) for r in rows.groupBy("list").count().collect())  # one row per list
    if not counts:
        return spark.createDataFrame([], shape)
    # a shelf is a run of short lists or one long one, which is cut into chunks
    shelf_of, chunks_of = {}, []
    for lo, hi in runs([n for _, n in counts], CHUNK):
        shelf_of |= {name: len(chunks_of) for name, _ in counts[lo:hi]}
        chunks_of.append(-(-sum(n for _, n in counts[lo:hi]) // CHUNK))
    as_map = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    shelf = as_map(shelf_of.items())
    salt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = ["shelf", "chunk", "block"]

    def held(group: pa.Table, against: pa.Table) -> pa.Table:
        parts = []
        if len(group) and len(against):
            own, query = (_unpacked(t.column("vec").to_pylist()) for t in (group, against))
            own_id, query_id, known = group.column("id").to_numpy(), against.column("id").to_numpy(), against.column("known").to_numpy()
            own_list = group.column("list").to_numpy()
            flat = against.column("lists").combine_chunks()
            probe, probed_by = flat.flatten().to_numpy(), np.repeat(np.arange(len(query)), np.diff(flat.offsets.to_numpy()))
            for name in np.unique(own_list):
                mine, asking = np.flatnonzero(own_list == name), probed_by[probe == name]
                parts.append(scan(query[asking], query_id[asking], own[mine], own_id[mine], k, known[asking]))
        found = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(["query_id", "vec_id", "score"], found)))

    def best_in(probes: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): of each probe (id, vec, lists, known) what its lists hold nearer than `known`, k at most of a list's chunk."""
        shelves = F.array_distinct(F.transform(F.filter("lists", lambda x: shelf[x].isNotNull()), lambda x: shelf[x]))
        spread = probes.withColumn("shelf", F.explode(shelves)).withColumn("lists", F.filter("lists", lambda x: shelf[x] == F.col("shelf")))
        asking = {r["shelf"]: -(-r["count"] // CHUNK) for r in spread.groupBy("shelf").count().collect()}  # one row per shelf
        chunks = as_map(enumerate(chunks_of))[F.col("shelf")]
        blocks = as_map((x, asking.get(x, 1)) for x in range(len(chunks_of)))[F.col("shelf")]
        left = rows.withColumn("shelf", shelf[F.col("list")]).withColumn("chunk", salt(chunks)).withColumn("block", each(blocks))
        right = spread.withColumn("block", salt(blocks)).withColumn("chunk", each(chunks)).select(*keys, "id", "vec", "lists", "known")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(held, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    far = F.lit(float("inf"))
    first = settled(ranked(best_in(queries.withColumn("lists", F.slice("lists", 1, 1)).withColumn("known", far))))
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    others = queries.withColumn("lists", F.slice("lists", 2, probed)).join(bounds, "id", "left").withColumn("known", F.coalesce("bound", far)).drop("bound")
    found = first.drop("rank")
    if probed > 1:
        found = found.union(best_in(others))
    found = settled(ranked(found))
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = settled(asked.join(full, "id", "left_anti"))
    if short.isEmpty():
        return found
    everywhere = short.mapInArrow(assign(len(centres)), named).withColumn("known", far)
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id").select(found.columns).union(ranked(best_in(settled(everywhere))))
