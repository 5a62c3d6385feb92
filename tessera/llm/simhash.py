"""SimHash near-duplicates: fingerprints, then a tiled exact comparison within a Hamming radius.

Distinct fingerprints are dealt into tiles of like population count. Two fingerprints whose population
counts differ by more than the radius can't link, so such tile pairs are never formed. A tile pair is
compared whole by exclusive-or and bit counts, and only a spanning forest of its links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm._common import as_bytes, ranges, runs, settled, spread_join
from tessera.llm._xxh64 import xxh64
from tessera.llm.components import connected_components, forest

SEED = 42
TILE = 32768
#: Comparisons held at once by a task.
BLOCK = 1 << 19
#: Bytes of text hashed at once.
GROUP = 1 << 20
#: Bits that mark ids which may go, whatever their number.
SLOTS = 1 << 23
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER[BLANK] = 0x20


def _shingles(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of the texts one after the other, and each text's number of them."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = BLANK[raw]
    after = np.concatenate([[True], blank[:-1]])
    begins, ends = np.flatnonzero(~blank & after), np.flatnonzero(blank & ~after)
    kept = ~(blank & after)
    place = np.cumsum(kept) - 1
    line = LOWER[raw][kept]  # words with one blank after each
    edges = np.cumsum([0, *[len(t) + 1 for t in texts]])
    n_words = np.diff(np.searchsorted(begins, edges))
    size = np.minimum(n_words, shingle)
    counts = np.where(n_words > 0, n_words - size + 1, 0)
    first = ranges(np.cumsum(n_words) - n_words, counts)
    begin, end = place[begins[first]], place[ends[first + np.repeat(size, counts) - 1]]
    return xxh64(line, begin, end - begin, SEED), counts


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes set."""
    n = len(hashes)
    rows = -(-n // 255)
    held = np.zeros(rows * 255, np.uint64)
    held[:n] = hashes
    # a byte for each bit, added eight bytes at a time: 255 ones fit a byte
    bits = np.unpackbits(held.view(np.uint8), bitorder="little").view(np.uint64).reshape(rows, 255, 8)
    ones = np.add.reduce(bits, axis=1).view(np.uint8).reshape(rows, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]


def text_fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """The 64-bit fingerprint (uint64) of each text."""
    found = np.zeros(len(texts), np.uint64)
    for first, last in runs([len(t) for t in texts], GROUP):
        hashes, counts = _shingles(texts[first:last], shingle)
        stops = np.cumsum(counts)
        for i in np.flatnonzero(counts):
            found[first + i] = _majority(hashes[stops[i] - counts[i] : stops[i]])
    return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) per row: the fingerprint's 64 bits as a signed long. Null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_fingerprints(as_bytes(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _links(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, of one tile (right is None) or of two; indices of the right follow the left's."""
    other, shift = (left, 0) if right is None else (right, len(left))
    rows = max(1, BLOCK // max(1, len(other)))
    buffer = np.empty((rows, len(other)), np.uint64)
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        first = at if right is None else 0
        held = np.bitwise_xor.outer(part, other[first:], out=buffer[: len(part), first:] if first == 0 else None)
        near = np.bitwise_count(held) <= radius
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        yield i + at, j + first + shift


def link_forest(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect the same distinct fingerprints as all links within the radius do.

    `prints` has one row per distinct fingerprint (fp long). The counts by population count are at most
    65 rows; they are all that the driver sees.
    """
    rated = prints.select("fp", F.bit_count("fp").alias("pop"))
    parts = {r["pop"]: -(-r["count"] // tile) for r in rated.groupBy("pop").count().collect()}
    if not parts:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    starts = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist()))
    numbers = F.create_map(*[F.lit(x) for p in parts for x in (p, parts[p])])
    firsts = F.create_map(*[F.lit(x) for p in parts for x in (p, starts[p])])
    tiles = (
        rated.withColumn("tile", F.element_at(firsts, F.col("pop")) + F.pmod(F.xxhash64("fp"), F.element_at(numbers, F.col("pop"))).cast("int"))
        .groupBy("tile", "pop")
        .agg(F.collect_list("fp").alias("fps"))  # about `tile` values, whatever the data
    )
    near = F.filter(F.array(*[F.lit(p) for p in sorted(parts)]), lambda p: F.abs(p - F.col("pop")) <= radius)
    partners = F.flatten(F.transform(near, lambda p: F.sequence(F.element_at(firsts, p), F.element_at(firsts, p) + F.element_at(numbers, p) - 1)))
    pairs = tiles.select("tile", "fps", F.explode(partners).alias("other")).select(
        F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "fps"
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [np.asarray(x, np.int64) for x in rows.sort_values("tile").fps]
        every = np.concatenate(sides)
        bits = [x.view(np.uint64) for x in sides]
        parent = forest(len(every), _links(bits[0], bits[1] if len(bits) > 1 else None, radius))
        moved = np.flatnonzero(parent != np.arange(len(every)))
        return pd.DataFrame({"a": every[moved], "b": every[parent[moved]]})

    return pairs.groupBy("low", "high").applyInPandas(compare, "a long, b long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, tile: int = TILE
) -> DataFrame:
    """One row per document: id, fp long, component_id (least id reachable over links, its own included).

    Words are runs of other than x20 and x09-x0D after A-Z are lowered; a text of fewer words than `shingle`
    is one shingle. A bit is 1 if over half of the shingle hashes (XXH64, seed 42, repeats counted) set it.
    Null, empty and wordless texts have fingerprint 0 and link like any other; equal texts share a
    fingerprint, repeated rows stay repeated, a null id counts as no id (null component if its group has
    none else). Other columns of `docs` don't matter, whatever their names; an empty table gives no rows.
    """
    marked = settled(fingerprints(docs, id_col, text_col, shingle))
    classes = settled(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    groups = settled(connected_components(link_forest(classes.select("fp"), radius, tile)).withColumnRenamed("node", "fp"))
    # only classes that link are looked up; of a component's least id there is one row
    roots = settled(classes.drop("n").join(groups, "fp"))
    least = settled(roots.groupBy("root").agg(F.min("least").alias("group_least"), F.count("*").alias("n")))
    moved = spread_join(roots, least, "root", groups.count()).select("fp", "group_least")
    known = settled(classes.join(moved, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("component_id"), "n"))
    return spread_join(marked, known, "fp", marked.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def _identity(id_col: str, text_col: str) -> Column:
    """What tells rows apart: id and text. Least first: rows with an id before those without, then by id and a hash of the text."""
    held = F.col(text_col).cast("string")
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), held.isNull().alias("no_text"), F.xxhash64(held).alias("text"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """The rows, with their own columns, of one document of each group: the one of least id, one with an id if there is one.

    Rows are told apart by id and text, so that rows of different groups never compete, whether their ids are equal or
    missing; of rows of a group that share an id, the one of the least text hash stays. Only rows that may go are moved
    for the exact join: a bitmap of SLOTS bits, the same at every size, marks the hashes of rows that go or repeat, and
    rows that it doesn't mark stay where they are. The more it marks, the more rows are joined; the result is the same.
    `docs` is read three times, so write it before if it is costly.
    """
    keyed = docs.select(_identity(id_col, text_col).alias("_tessera_key"), F.col(text_col).alias("_tessera_text"))
    groups = settled(simhash_groups(keyed, "_tessera_key", "_tessera_text", shingle, radius, tile).select("_tessera_key", "component_id"))
    repeated = groups.groupBy("_tessera_key").count().where("count > 1").select("_tessera_key")
    flagged = groups.where("NOT (_tessera_key <=> component_id)").select("_tessera_key").union(repeated)
    words = flagged.groupBy(F.shiftright(_slot("_tessera_key"), 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _slot("_tessera_key").bitwiseAND(63).cast("int"))).alias("bits"))
    bitmap = np.zeros(SLOTS // 64, np.int64)
    for row in words.toLocalIterator():  # SLOTS / 64 rows at most
        bitmap[row["at"]] = row["bits"]

    @F.arrow_udf("boolean")
    def marked(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(bitmap[at >> 6] >> (at & 63) & 1 == 1)

    rows = docs.select(_identity(id_col, text_col).alias("_tessera_key"), F.struct("*").alias("_tessera_row"))
    may_go = marked(_slot("_tessera_key"))
    untouched = rows.where(~may_go).select("_tessera_row.*")
    stay = groups.where("_tessera_key <=> component_id").where(may_go).groupBy("_tessera_key").agg(F.count("*").alias("_tessera_n"))
    joined = rows.where(may_go).join(stay, "_tessera_key")
    # repeated rows are one key: partial aggregation holds one of them, a window would gather them all
    once = joined.where("_tessera_n > 1").groupBy("_tessera_key").agg(F.first("_tessera_row").alias("_tessera_row"))
    return untouched.union(joined.where("_tessera_n = 1").select("_tessera_row.*")).union(once.select("_tessera_row.*"))
