"""SentencePiece encoding and decoding: sampled segmentations that a row's key reproduces.

A text, with blanks written as U+2581 and one put before it, is a lattice of the vocabulary's pieces. Pieces hold
U+2581 at their start only, so the lattice falls apart where one follows another character, and each such word is
its own lattice. Forward filtering sums the weights of all ways to each place of every distinct word; backward
sampling then draws each occurrence's pieces from the word's end to its start, with uniforms hashed from the row's
key, the occurrence and the step. A character that is no piece is spelled by its UTF-8 byte pieces, and so is a
U+2581 that the text itself holds: decoding gives back every text exactly.

The vocabulary has merge ranks rather than probabilities, so a piece of rank r weighs 1 / (r + 2), to the power
`alpha` (0: all segmentations alike; large: the best one).
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import as_text, ranges, runs

BLANK = 0x2581
OWN_BLANK = 0x110000
#: Characters sampled at once.
GROUP = 1 << 18
#: Places of filtered words kept by a worker, but for those of one group; beyond that it forgets them.
KEPT = 1 << 18
WORDS = regex.compile(" +[^ ]*|[^ ]+")
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Vocabulary:
    """The pieces of a SentencePiece model: weights, a trie for matching, bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        words: list[tuple[str, int]] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(chr(BLANK), " ").encode()
                words.append((piece, i))
        first = min((i for _, i in words), default=0)
        self.log_weight = -np.log(np.maximum(np.arange(size) - first, 0) + 2.0)
        self.byte_weight = -np.log(size + 2.0)
        # the trie: the first character by table, further ones by a sorted list of (node, character)
        nodes: dict[tuple[int, int], int] = {}
        ends = {0: -1}
        for piece, i in words:
            at = 0
            for c in map(ord, piece):
                at = nodes.setdefault((at, c), len(nodes) + 1)
            ends[at] = i
        self.first = np.full(OWN_BLANK + 1, -1, np.int32)
        for (at, c), to in nodes.items():
            if at == 0:
                self.first[c] = to
        deep = sorted((at << 21 | c, to) for (at, c), to in nodes.items() if at)
        self.keys = np.array([k for k, _ in deep], np.int64)
        self.to = np.array([t for _, t in deep], np.int32)
        self.end = np.array([ends.get(k, -1) for k in range(len(nodes) + 1)], np.int32)

    def edges(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the words: (place, length, id); stop[p] is the end of the word that place p is in.

        A place without a piece of its own character gets an edge with id -1, for its byte pieces.
        """
        place = np.arange(len(codes))
        node = self.first[codes]
        alone = np.where(node >= 0, self.end[node], -1)
        found = [(place, np.ones(len(codes), np.int64), alone)]
        size = 1
        live = np.flatnonzero(node >= 0)
        node = node[live]
        while len(live):
            more = live + size < stop[live]
            live, node = live[more], node[more]
            key = node.astype(np.int64) << 21 | codes[live + size]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            live, node = live[hit], self.to[at[hit]]
            size += 1
            whole = self.end[node] >= 0
            found.append((live[whole], np.full(int(whole.sum()), size), self.end[node[whole]]))
        return tuple(np.concatenate(x) for x in zip(*found))


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _uniform(seed: np.ndarray, occurrence: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) hashed from a row's seed, the word's place in the row and the step."""
    with np.errstate(over="ignore"):
        x = seed + (occurrence.astype(np.uint64) << np.uint64(20)) * MULTIPLIERS[0] + np.uint64(step + 1) * MULTIPLIERS[0]
        x = (x ^ (x >> np.uint64(30))) * MULTIPLIERS[1]
        x = (x ^ (x >> np.uint64(27))) * MULTIPLIERS[2]
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _by_depth(depth: np.ndarray, target: np.ndarray, weight: np.ndarray, piece: np.ndarray, n_nodes: int) -> np.ndarray:
    """The order of edges by depth, then target, then the heaviest first; of equal weight, by piece."""
    span = int(piece.max(initial=0)) + 2
    if not len(depth) or int(depth.max()) * n_nodes * span > 1 << 62:
        return np.lexsort((piece, -weight, target, depth))
    # weights fall with the piece's number; what is spelled by bytes comes last
    return np.argsort((depth * n_nodes + target) * span + np.where(piece >= 0, piece, span - 1))


def _filtered(vocab: Vocabulary, words: list[str], alpha: float) -> tuple[np.ndarray, ...]:
    """Forward filtering: for every place of the distinct words, its edges and their cumulated probabilities.

    Place 0 of a word is a node, and so is every place behind a character. Returns the words' last nodes, and
    by node the first of its edges; by edge the cumulated probability, the node it comes from, the piece and,
    for byte pieces, the character.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    codes = np.where(codes == 0x20, BLANK, np.where(codes == BLANK, OWN_BLANK, codes))
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    place, size, piece = vocab.edges(codes, ends[word])
    width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    width[codes == OWN_BLANK] = 3
    weight = alpha * np.where(piece >= 0, vocab.log_weight[piece], vocab.byte_weight * width[place])
    origin = place + word[place]  # one more node than characters in each word
    target = origin + size
    depth = target - (ends - sizes + np.arange(len(words)))[word[place]]
    order = _by_depth(depth, target, weight, piece, len(codes) + len(words))
    origin, target, piece, weight, depth = origin[order], target[order], piece[order], weight[order], depth[order]
    char = codes[place[order]]
    n_nodes = len(codes) + len(words)
    total = np.zeros(n_nodes)
    heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
    first = np.zeros(n_nodes, np.int64)
    first[target[heads]] = heads
    layers = np.searchsorted(depth[heads], np.arange(1, (depth[-1] if len(depth) else 0) + 2))
    chance = np.empty(len(weight))
    for a, b in zip(layers[:-1], layers[1:]):
        lo, hi = heads[a], heads[b] if b < len(heads) else len(weight)
        value = total[origin[lo:hi]] + weight[lo:hi]
        at = heads[a:b] - lo
        span = np.diff(np.append(at, hi - lo))
        top = np.maximum.reduceat(value, at)
        part = np.exp(value - np.repeat(top, span))
        mass = np.add.reduceat(part, at)
        total[target[heads[a:b]]] = top + np.log(mass)
        chance[lo:hi] = part / np.repeat(mass, span)
    # summed within each node alone, so that no other word has a part in the rounding
    upto, spans = chance, np.diff(np.append(heads, len(weight)))
    for k in range(1, int(spans.max(initial=0))):
        at = heads[spans > k] + k
        upto[at] += upto[at - 1]
    upto[np.append(heads[1:], len(weight)) - 1 if len(heads) else []] = 2.0  # the last edge takes what is left
    return ends + np.arange(len(words)), first, upto, origin, piece, char


class Lattices:
    """Forward-filtered words that a worker keeps: frequent words are filtered once, not once for every group."""

    def __init__(self, vocab: Vocabulary, alpha: float):
        self.vocab, self.alpha = vocab, alpha
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.start, self.last, self.first, self.origin, self.piece, self.char = (np.zeros(0, np.int32) for _ in range(6))
        self.upto = np.zeros(0)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of the words; self.start and self.last hold their nodes."""
        if len(self.first) > KEPT:
            self.forget()
        number, known = self.number, len(self.number)  # a new word gets the next number
        found = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if len(number) > known:
            new = list(itertools.islice(number, known, None))
            last, first, upto, origin, piece, char = _filtered(self.vocab, new, self.alpha)
            nodes, edges = len(self.first), len(self.upto)
            grown = [("last", last + nodes), ("start", last - np.array([len(w) for w in new]) + nodes), ("first", first + edges), ("origin", origin + nodes), ("piece", piece), ("char", char)]
            for name, values in grown:
                setattr(self, name, np.concatenate([getattr(self, name), values.astype(np.int32)]))
            self.upto = np.concatenate([self.upto, upto])
        return found


@functools.lru_cache(2)
def lattices(path: str, alpha: float) -> Lattices:
    return Lattices(vocabulary(path), alpha)


def sample(texts: list[str], seeds: np.ndarray, path: str, alpha: float) -> Iterator[np.ndarray]:
    """The sampled piece ids of each text; seeds (uint64) are the rows' keys, hashed."""
    vocab, known = vocabulary(path), lattices(path, alpha)
    for first_text, last_text in runs([len(t) for t in texts], GROUP):
        parts = [WORDS.findall(" " + text) if text else [] for text in texts[first_text:last_text]]
        per = np.array([len(own) for own in parts], np.int64)
        word = known.numbers([w for own in parts for w in own])
        first, upto, origin, piece, char = known.first, known.upto, known.origin, known.piece, known.char
        occurrence = ranges(np.zeros(len(per), np.int64), per)
        seed = np.repeat(seeds[first_text:last_text], per)
        node, start = known.last[word], known.start[word]
        live, steps, drawn = np.arange(len(word)), [], []
        taken = np.zeros(len(word), np.int64)
        while len(live):
            u = _uniform(seed[live], occurrence[live], len(steps))
            edge = first[node[live]]
            todo = np.flatnonzero(u >= upto[edge])
            while len(todo):
                edge[todo] += 1
                todo = todo[u[todo] >= upto[edge[todo]]]
            steps.append(live)
            drawn.append(edge)
            taken[live] += 1
            node[live] = origin[edge]
            live = live[node[live] > start[live]]
        stop = np.cumsum(taken)
        edges = np.empty(stop[-1] if len(stop) else 0, np.int32)
        for k, (which, edge) in enumerate(zip(steps, drawn)):
            edges[stop[which] - 1 - k] = edge
        ids = piece[edges]
        by_text = np.add.reduceat(np.append(taken, 0), np.minimum(np.cumsum(per) - per, len(taken))) * (per > 0)
        spelled = ids < 0
        if spelled.any():
            code = np.where(char[edges] == OWN_BLANK, BLANK, char[edges])
            width = np.where(spelled, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
            text_of = np.repeat(np.arange(len(per)), by_text)
            raw = "".join(map(chr, code[spelled].tolist())).encode()
            ids = np.repeat(ids, width)
            ids[np.repeat(spelled, width)] = vocab.byte_id[np.frombuffer(raw, np.uint8)]
            by_text = np.bincount(text_of, weights=width, minlength=len(per)).astype(np.int64)
        yield from np.split(ids.astype(np.int32), np.cumsum(by_text)[:-1])


def decode_ids(ids: list[int], path: str) -> str:
    """The text of a sequence of piece ids; unknown and control ids stand for nothing."""
    table = vocabulary(path).bytes
    return b"".join([table[i] for i in ids])[1:].decode("utf-8", "replace")


def _picked(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(flat))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.5, seed: int = 11) -> DataFrame:
    """(id, pieces array<int>): a sampled segmentation of each text, fixed by the row's id and `seed`.

    path names a SentencePiece model with byte pieces that every executor has. Null and empty texts have no
    pieces; texts are taken whole; rows with equal ids and texts have equal pieces; a null id is one more key.
    Other columns of `docs` don't matter; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy().view(np.uint64)
            found = list(sample(as_text(batch.column(1)), keys, path, alpha))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], ["id", "pieces"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _picked(docs, id_col, text_col, seed).mapInArrow(run, f"id {kind}, pieces array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(id, text): the texts of piece ids; a null or empty array is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids or [], path) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.5, seed: int = 11) -> DataFrame:
    """encode() and decode() in one pass: id, pieces array<int>, n_pieces, pieces_crc32, text_crc32 (decoded), lossless.

    pieces_crc32 is over the ids as little-endian 32-bit integers. lossless: the decoded text equals the row's
    text, null counting as empty. Rows as for encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column(1))
            table = vocabulary(path).bytes
            found, crc, text_crc, same = [], [], [], []
            for text, ids in zip(texts, sample(texts, batch.column(2).to_numpy().view(np.uint64), path, alpha)):
                back = b"".join([table[i] for i in ids.tolist()])[1:]
                found.append(ids)
                crc.append(zlib.crc32(ids.astype("<i4").tobytes()))
                text_crc.append(zlib.crc32(back))
                same.append(back == text.encode())
            columns = [_lists(found), pa.array(map(len, found), pa.int64()), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "pieces", "n_pieces", "pieces_crc32", "text_crc32", "lossless"])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, pieces array<int>, n_pieces long, pieces_crc32 long, text_crc32 long, lossless boolean"
    return _picked(docs, id_col, text_col, seed).mapInArrow(run, shape).withColumnRenamed("id", id_col)
