"""Near-duplicate embeddings by lattice hashing: E8 cells of random projections, neighbouring cells, exact cosine.

A table projects unit vectors by 16 rows of a random rotation and decodes the two groups of 8 numbers to their
nearest E8 points; the pair of points is the vector's cell. Each vector is entered in its own cell and in the two
cells that differ by the nearest other lattice point of either group. Vectors that meet in any cell of any table
are compared by cosine in double precision. A pair that meets often is counted only where it meets first, so links
are counted exactly without listing pairs; what leaves a task are counts and a spanning forest of its links.
Equal vectors are one class with a multiplicity. A cell of many entries is cut into tiles that are compared pair by
pair in separate tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import ranges, runs, settled, spread_join
from tessera.llm.components import connected_components, forest

TABLES = 8
#: Side of a lattice cell in units of a unit vector.
SCALE = 0.24
TILE = 2048
SEED = 5


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points (rows of 8)."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def next_e8(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The nearest E8 points other than `point`, the nearest: it is one of its 240 neighbours."""
    rest = x - point
    size, sign = np.abs(rest), np.where(rest >= 0, 1.0, -1.0)
    rows = np.arange(len(x))
    top = np.argsort(-size, axis=1)
    two = np.zeros_like(x)
    for k in (0, 1):
        two[rows, top[:, k]] = sign[rows, top[:, k]]
    halves = sign / 2
    odd = np.flatnonzero((sign < 0).sum(1) % 2 != 0)
    halves[odd, top[odd, -1]] *= -1
    better = ((rest * two).sum(1) >= (rest * halves).sum(1))[:, None]
    return point + np.where(better, two, halves)


@functools.lru_cache(4)
def _rotations(dim: int, tables: int) -> np.ndarray:
    """Rows of random rotations, 16 for each table."""
    rng = np.random.default_rng(SEED)
    rows: list[np.ndarray] = []
    width = max(16, dim)
    while len(rows) < 16 * tables:
        q, r = np.linalg.qr(rng.standard_normal((width, width)))
        rows += list((q * np.sign(np.diag(r))).T[: width - width % 16, :dim])
    return np.array(rows[: 16 * tables])


def cells(unit: np.ndarray, tables: int = TABLES, scale: float = SCALE) -> np.ndarray:
    """(n, tables, 3) cell numbers of unit vectors: the own cell and two neighbours."""
    n, dim = unit.shape
    out = np.empty((n, tables, 3), np.int64)
    mix = np.random.default_rng(SEED + 1).integers(-(1 << 62), 1 << 62, (tables, 16)) | 1
    # the factor makes up for what 16 of few dimensions span
    flat = (unit @ _rotations(dim, tables).T) * (1 / scale)
    with np.errstate(over="ignore"):
        for t in range(tables):
            a, b = flat[:, 16 * t : 16 * t + 8], flat[:, 16 * t + 8 : 16 * t + 16]
            pa_, pb = nearest_e8(a), nearest_e8(b)
            key = lambda p, m: ((2 * p).astype(np.int64) * m).sum(1)
            ka, kb = key(pa_, mix[t, :8]), key(pb, mix[t, 8:])
            out[:, t, 0] = ka + kb
            out[:, t, 1] = key(next_e8(a, pa_), mix[t, :8]) + kb
            out[:, t, 2] = ka + key(next_e8(b, pb), mix[t, 8:])
    return out


def entry_cells(unit: np.ndarray, tables: int = TABLES, scale: float = SCALE) -> np.ndarray:
    """cells(), told apart by table and dimension."""
    with np.errstate(over="ignore"):
        return cells(unit, tables, scale) * np.int64(31) + np.arange(tables)[None, :, None] * np.int64(1000003) + np.int64(unit.shape[1])


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _valid(row) -> np.ndarray | None:
    """A vector in double precision; None if it is null, empty, zero or holds what is not finite."""
    if row is None:
        return None
    vector = np.array(row, np.float64)
    return vector if len(vector) and np.isfinite(vector).all() and vector.any() else None


def _packed(vector: np.ndarray) -> bytes:
    """A vector's bytes: single precision (marked 4) where that loses nothing, else double (marked 8)."""
    single = vector.astype("<f4")
    return b"4" + single.tobytes() if (single == vector).all() else b"8" + vector.astype("<f8").tobytes()


def _unpacked(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.array([np.frombuffer(r, "<f4" if r[:1] == b"4" else "<f8", offset=1).astype(np.float64) for r in raw])


def _units_of(raw: list[bytes]) -> np.ndarray:
    return units(_unpacked(raw))


def _length(raw: bytes) -> int:
    return (len(raw) - 1) // int(raw[:1])


def marked_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key binary, vec binary): key is a digest of the vector's components, null if it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_valid(row) for row in batch.column(1).to_pylist()]
            raw = [None if v is None else _packed(v) for v in found]
            key = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "vec"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).mapInArrow(run, f"id {kind}, key binary, vec binary")


def _entries(classes: DataFrame, tables: int, scale: float) -> DataFrame:
    """A row (cell, node) for each class, table and cell. Vectors stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            lengths = np.array([_length(r) for r in raw])
            for dim in np.unique(lengths):
                members = np.flatnonzero(lengths == dim)
                per = entry_cells(_units_of([raw[i] for i in members]), tables, scale).reshape(len(members), -1)
                yield pa.RecordBatch.from_arrays([pa.array(per.reshape(-1)), pa.array(np.repeat(node[members], per.shape[1]))], ["cell", "node"])

    return classes.select("node", "vec").mapInArrow(run, "cell long, node long")


def _pairs_of(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within each run of rows of the given sizes, in blocks of bounded size."""
    stops = np.cumsum(sizes)
    # row k of a run pairs with all that follow it in the run
    after = np.repeat(stops, sizes) - np.arange(stops[-1] if len(stops) else 0) - 1
    for lo, hi in runs(after.tolist(), 1 << 17):
        yield np.repeat(np.arange(lo, hi), after[lo:hi]), ranges(np.arange(lo, hi) + 1, after[lo:hi])


class _Compare:
    """Compares the entries of whole cells: counts of links by node, and a spanning forest of them."""

    def __init__(self, least: float, tables: int, scale: float):
        self.least, self.tables, self.scale = least, tables, scale

    def groups(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """rows: (cell, low, high, tile, node, weight, vec), each cell's tile pair together."""
        cell, low, high, tile, node, weight = (rows.column(k).to_numpy() for k in range(6))
        new = np.append(True, (cell[1:] != cell[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(cell)))
        group = np.repeat(np.arange(len(begins)), sizes)
        keep = np.flatnonzero(sizes[group] > 1)
        if not len(keep):
            return
        vecs = rows.column(6).take(pa.array(keep)).to_pylist()
        lengths = np.array([_length(v) for v in vecs])
        for dim in np.unique(lengths):
            own = np.flatnonzero(lengths == dim)
            at = keep[own]
            yield from self._compare(_units_of([vecs[i] for i in own]), cell[at], group[at], low[at], high[at], tile[at], node[at], weight[at])

    def _candidates(self, unit, group, low, high, tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of cosine `least` or more."""
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(begins, len(group)))
        small = (sizes <= 64)[np.repeat(np.arange(len(sizes)), sizes)] & (low == high)
        few = np.flatnonzero(small)
        for i, j in _pairs_of(sizes[(sizes <= 64) & (low == high)[begins]]):
            near = np.einsum("ij,ij->i", unit[few[i]], unit[few[j]]) >= self.least
            yield few[i[near]], few[j[near]]
        for begin, size in zip(begins, sizes):
            if small[begin]:
                continue
            span = np.arange(begin, begin + size)
            same = low[begin] == high[begin]
            left = span if same else span[tile[span] == low[begin]]
            right = span if same else span[tile[span] == high[begin]]
            step = max(1, (1 << 20) // max(1, len(right)))
            for k in range(0, len(left), step):
                i, j = np.nonzero(unit[left[k : k + step]] @ unit[right].T >= self.least)
                if same:
                    ahead = i + k < j
                    i, j = i[ahead], j[ahead]
                yield left[i + k], right[j]

    def _compare(self, unit, cell, group, low, high, tile, node, weight) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(unit), np.int64)
        # rows of the same vector stand for one node
        _, row_node = np.unique(node, return_inverse=True)

        def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in self._candidates(unit, group, low, high, tile):
                for at in range(0, len(i), 1 << 15):
                    a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                    both, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                    named = entry_cells(unit[both], self.tables, self.scale)
                    x, y = named[back[: len(a)]], named[back[len(a) :]]
                    shared = (x[:, :, :, None] == y[:, :, None, :]).any(3)  # which of a's cells are b's too
                    table = shared.any(2).argmax(1)
                    pick = np.arange(len(a))
                    # counted where they meet first: the first table, and there the least shared cell
                    first = np.where(shared[pick, table], x[pick, table], np.iinfo(np.int64).max).min(1)
                    ours = (first == cell[a]) & (node[a] != node[b])
                    a, b = a[ours], b[ours]
                    np.add.at(count, a, weight[b])
                    np.add.at(count, b, weight[a])
                    yield row_node[a], row_node[b]

        names = np.unique(node)
        parent = forest(len(names), met())
        moved, linked = np.flatnonzero(parent != np.arange(len(names))), np.flatnonzero(count)
        if len(linked):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([node[linked], names[moved]])),
                    pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(names[parent[moved]])]),
                    pa.array(np.concatenate([count[linked], np.zeros(len(moved), np.int64)])),
                ],
                ["a", "b", "count"],
            )


def vector_links(classes: DataFrame, least: float = 0.95, tables: int = TABLES, scale: float = SCALE, tile: int = TILE) -> DataFrame:
    """Links of distinct vectors (node long, weight long, vec binary), as rows (a, b, count).

    b is null: a has so many linked vectors more, counted by weight. b is not null: an edge of a spanning forest.
    """
    entries = settled(_entries(classes, tables, scale))
    # most cells hold one entry: only the others are looked up, and only for their entries do vectors move
    shared = settled(entries.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / tile).cast("int")))
    held = spread_join(entries, shared, "cell", entries.count())
    vectors = classes.select("node", "weight", "vec")
    placed = held.withColumn("tile", F.pmod(F.xxhash64("node"), "parts").cast("int")).join(vectors, "node")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("cell", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "weight", "vec")
    compare = _Compare(least, tables, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group, which may go on in the next batch
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]).combine_chunks() if held is not None else now
            if not len(now):
                continue
            cell, low, high = (now.column(k).to_numpy() for k in range(3))
            last = np.flatnonzero((cell != cell[-1]) | (low != low[-1]) | (high != high[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from compare.groups(now.slice(0, cut).combine_chunks())
            held = now.slice(cut)
        if held is not None:
            yield from compare.groups(held.combine_chunks())

    keys = ["cell", "low", "high"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, count long")


def vector_groups(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, tables: int = TABLES, scale: float = SCALE, tile: int = TILE
) -> DataFrame:
    """One row per input row: id long, n_links long, component_id long, kept boolean.

    n_links counts the other vectors linked directly (cosine `least` or more, found by the tables), component_id
    is the least id reachable over links, kept whether that is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing; vectors of unlike length don't link. Equal vectors link
    always; a null id takes part, but names no component. Ties and repeated rows count each. Other columns don't
    matter; an empty table gives no rows.
    """
    marked = settled(marked_vectors(vectors, id_col, vec_col).withColumn("id", F.col("id").cast("long")))
    # Classes of equal vectors; a class is known by a number of its own digest, so that null ids need no care.
    node = F.xxhash64("key")
    classes = settled(
        marked.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec")).withColumn("node", node)
    )
    links = settled(vector_links(classes, least, tables, scale, tile))
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("count").alias("links"))
    groups = connected_components(links.where("b IS NOT NULL").select("a", "b"))
    known = settled(classes.select("key", "node", "least", "weight").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")))
    n_classes = known.count()
    least_of = settled(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    rated = spread_join(known, least_of, "root", n_classes).join(counts, "node", "left")
    rated = settled(rated.select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.col("weight").alias("n")))
    out = spread_join(marked.where("key IS NOT NULL").select("id", "key"), rated, "key", marked.count()).select("id", "n_links", "component_id")
    out = out.union(marked.where("key IS NULL").select("id", F.lit(0).cast("long"), "id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
