"""Token counts by finite-state transducers whose transitions carry emitted-token counts.

Two deterministic transducers, compiled from a byte-level BPE vocabulary file:

* the word splitter, over symbols (character class, lookahead, contraction). It has eight states. A text is cut
  into chunks; each chunk's map from entry state to exit state is run from all states until the map is constant,
  and the maps compose by a parallel prefix scan, which gives every chunk its entry state.
* the merge transducer, over the bytes of a word. A transition's output is the change in the number of tokens of
  the prefix read so far. For every prefix the last token of its encoding is unique: the one that ends the prefix
  and stays whole beside the last token of what precedes it. A state holds that token for every place that a
  longer token could still begin at, so it is finite and fixes all that follows. States and transitions are
  compiled when first met and kept in a table of bounded size; all words of a batch step through it at once.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import as_text, runs

L, N, O, SP, WS = range(5)
FRESH, IN_L, IN_N, IN_O, JOIN, IN_WS, ONE_MORE, TWO_MORE = STATES = range(8)
CHUNK = 1024
#: Characters handled at once.
GROUP = 1 << 20
#: Slots of the transition table, a power of two; it begins anew when half full.
SLOTS = 1 << 21
# Code points of the White_Space property.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, O, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}", L), (r"\p{N}", N)):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    out[SPACES] = WS
    out[0x20] = SP
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol * 8 + state] and begins[...]; symbol = (class * 2 + a non-space follows) * 3 + contraction length - 1."""
    move, begins = np.zeros(30 * 8, np.uint8), np.zeros(30 * 8, bool)
    for kind in range(5):
        for follows in (0, 1):
            for con in (0, 1, 2):
                for state in STATES:
                    at = ((kind * 2 + follows) * 3 + con) * 8 + state
                    if state in (ONE_MORE, TWO_MORE):
                        to, new = (ONE_MORE, False) if state == TWO_MORE else (FRESH, False)
                    elif kind in (L, N):
                        run = IN_L if kind == L else IN_N
                        to, new = run, state not in (run, JOIN)
                    elif kind == O:
                        if con and state not in (IN_O, JOIN):
                            to, new = (ONE_MORE if con == 1 else TWO_MORE), True
                        else:
                            to, new = IN_O, state not in (IN_O, JOIN)
                    elif follows:
                        to, new = (JOIN if kind == SP else FRESH), True
                    else:
                        to, new = IN_WS, state != IN_WS
                    move[at], begins[at] = to, new
    return move, begins


def _symbols(codes: np.ndarray) -> np.ndarray:
    """The splitter's input: every character with what it needs to see of those after it. -1 parts texts."""
    kinds = char_classes()[np.maximum(codes, 0)]
    kinds[codes < 0] = WS
    after = np.append(codes[1:], -1)
    follows = np.append(kinds[1:], WS) < SP
    contraction = np.zeros(len(codes), np.uint8)
    quotes = np.flatnonzero((codes == 0x27))
    if len(quotes):
        a = after[quotes]
        b = np.append(after[1:], -1)[quotes]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        contraction[quotes] = np.where(short, 1, np.where(long, 2, 0))
    return ((kinds * 2 + follows) * 3 + contraction) * 8


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Marks the characters that begin a word. A code of -1 parts texts and is a word of its own."""
    move, begins = splitter()
    n = len(codes)
    symbols = _symbols(codes)
    rows = -(-n // CHUNK)
    grid = np.zeros(rows * CHUNK, np.uint8)
    grid[:n] = symbols
    parted = np.zeros(rows * CHUNK, bool)
    parted[:n] = codes < 0
    grid, parted = grid.reshape(rows, CHUNK).T.copy(), parted.reshape(rows, CHUNK).T.copy()
    # each chunk's map of states: from all entries until the map is constant, then from one
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    open_ = np.arange(rows)
    single = np.zeros(rows, np.uint8)
    since = np.zeros(rows, np.int64)
    for k in range(CHUNK):
        if not len(open_):
            break
        m = move[grid[k, open_, None] + maps[open_]]
        m[parted[k, open_]] = FRESH
        maps[open_] = m
        flat = (m == m[:, :1]).all(1)
        single[open_[flat]], since[open_[flat]] = m[flat, 0], k + 1
        open_ = open_[~flat]
    first = int(since[since > 0].min()) if (since > 0).any() else CHUNK
    for k in range(first, CHUNK):
        go = (since > 0) & (since <= k)
        to = move[grid[k] + single]
        to[parted[k]] = FRESH
        single = np.where(go, to, single)
    constant = since > 0
    maps[constant] = single[constant, None]
    # prefix scan: maps[i] becomes the composition of all maps up to chunk i
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.append(np.uint8(FRESH), maps[:-1, FRESH])
    out = np.zeros((CHUNK, rows), bool)
    for k in range(CHUNK):
        at = grid[k] + state
        out[k] = begins[at]
        state = move[at]
        state[parted[k]] = FRESH
    marks = out.T.reshape(-1)[:n]
    marks[codes < 0] = True
    return marks


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTransducer:
    """Counts the tokens of byte words. Tokens are numbered by merge rank: bytes first, then merges in order."""

    START = -1

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        byte = _byte_alphabet()
        parts = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.tokens: list[bytes] = [bytes([b]) for b in range(256)]
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.number = {t: i for i, t in enumerate(self.tokens)}
        for left, right in parts:
            a, b = (bytes(byte[c] for c in x) for x in (left, right))
            self.halves.append((self.number[a], self.number[b]))
            self.number.setdefault(a + b, len(self.tokens))
            self.tokens.append(a + b)
        self.merged = {pair: i for i, pair in enumerate(self.halves) if i >= 256}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.beside = functools.lru_cache(1 << 18)(self._beside)
        self.whole = [self._whole(i) for i in range(len(self.tokens))]
        self._empty()

    def _empty(self) -> None:
        self.states: list[tuple[bytes, tuple]] = []
        self.ids: dict[tuple[bytes, tuple], int] = {}
        self._state((b"", ((self.START, 0),)))
        self.keys = np.full(SLOTS, -1, np.int64)
        self.next = np.zeros(SLOTS, np.int32)
        self.gain = np.zeros(SLOTS, np.int16)
        self.used = 0

    def _state(self, what: tuple[bytes, tuple]) -> int:
        if what not in self.ids:
            self.ids[what] = len(self.states)
            self.states.append(what)
        return self.ids[what]

    def _whole(self, token: int) -> bool:
        """Whether a token's bytes alone encode to it."""
        if token < 256:
            return True
        parts = list(self.tokens[token])
        while len(parts) > 1:
            best, at = min((self.merged.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 30:
                return False
            pair = (parts[at], parts[at + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(best)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts == [token]

    def _beside(self, left: int, right: int) -> bool:
        """Whether two whole tokens stay apart when their bytes are encoded together.

        Undoes the merges that touch the border, latest first; a merge across the border, of parts that lie
        side by side at the time, is one that would have come before the merge undone last.
        """
        limit = 1 << 30
        while True:
            if self.merged.get((left, right), 1 << 30) < limit:
                return False
            if left > right:
                limit = left
                if left < 256:
                    return True
                left = self.halves[left][1]
            else:
                limit = right + 1
                if right < 256:
                    if left < 256:
                        return True
                    limit = left
                    left = self.halves[left][1]
                else:
                    right = self.halves[right][0]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change in the number of tokens."""
        tail, lasts = self.states[state]
        text = tail + bytes([byte])
        for size in range(len(text), 0, -1):
            token = self.number.get(text[-size:])
            if token is None:
                continue
            before, count = lasts[size - 1]
            if self.whole[token] if before == self.START else self.beside(before, token):
                break
        else:
            raise AssertionError("a byte is always a token")
        gain = count + 1
        keep = next(k for k in range(len(text), -1, -1) if text[len(text) - k :] in self.prefixes)
        held = ((token, 0), *((t, c - gain) for t, c in lasts[:keep]))
        return self._state((text[len(text) - keep :], held)), gain

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 where missing."""
        slot = (keys * np.int64(-7046029254386353131)) >> np.int64(20) & (SLOTS - 1)
        got = self.keys[slot]
        out = np.where(got == keys, slot, -1)
        todo = np.flatnonzero((got != keys) & (got != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            got = self.keys[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (got != -1)]
        return out

    def _insert(self, key: int, to: int, gain: int) -> None:
        slot = (key * -7046029254386353131 & (1 << 64) - 1) >> 20 & (SLOTS - 1)
        while self.keys[slot] != -1:
            slot = (slot + 1) & (SLOTS - 1)
        self.keys[slot], self.next[slot], self.gain[slot] = key, to, gain
        self.used += 1

    def counts(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word buffer[start : start + length]; longest words first."""
        step = SLOTS // 4
        return np.concatenate([np.zeros(0, np.int64), *(self._counts(buffer, starts[k : k + step], lengths[k : k + step]) for k in range(0, len(starts), step))])

    def _counts(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """counts() of no more words than a quarter of the table's slots."""
        state = np.zeros(len(starts), np.int64)
        total = np.zeros(len(starts), np.int64)
        ends = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        for k, n in enumerate(ends):
            if self.used > SLOTS // 2 or len(self.states) > SLOTS // 2:
                # begin a new table with the states that are under way
                under_way = [self.states[s] for s in state[:n]]
                self._empty()
                state[:n] = [self._state(s) for s in under_way]
            keys = state[:n] << 8 | buffer[starts[:n] + k]
            slots = self._find(keys)
            if (missing := slots < 0).any():
                for key in np.unique(keys[missing]).tolist():
                    self._insert(key, *self._compile(key >> 8, key & 255))
                slots[missing] = self._find(keys[missing])
            state[:n] = self.next[slots]
            total[:n] += self.gain[slots]
        return total


@functools.lru_cache(2)
def transducer(path: str) -> MergeTransducer:
    return MergeTransducer(path)


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library that the vocabulary file is for counts them."""
    machine = transducer(path)
    out: list[int] = []
    special = regex.compile("|".join(map(regex.escape, machine.specials))) if machine.specials else None
    for first, last in runs([len(t) for t in texts], GROUP):
        parts, owner, extra = [], [], [0] * (last - first)
        for i, text in enumerate(texts[first:last]):
            pieces = special.split(text) if special else [text]
            extra[i] = len(pieces) - 1  # a special token's string is one token and parts what surrounds it
            for piece in pieces:
                parts.append(piece)
                owner.append(i)
        lengths = np.array([len(p) for p in parts])
        joined = np.frombuffer("\0".join(parts + [""]).encode("utf-32-le", "surrogatepass"), "<i4").astype(np.int32)
        edges = np.cumsum(lengths + 1) - 1
        codes = joined.copy()
        codes[edges] = -1
        marks = np.flatnonzero(word_starts(codes))
        width = 1 + (joined > 0x7F) + (joined > 0x7FF) + (joined > 0xFFFF)
        place = np.append(0, np.cumsum(width))
        buffer = np.frombuffer(joined.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        begins = place[marks]
        sizes = np.diff(np.append(begins, place[-1]))
        real = codes[marks] >= 0
        marks, begins, sizes = marks[real], begins[real], sizes[real]
        order = np.argsort(-sizes, kind="stable")
        found = np.empty(len(order), np.int64)
        found[order] = machine.counts(buffer, begins[order], sizes[order])
        owners = np.array(owner)[np.searchsorted(edges, marks)] if len(marks) else np.zeros(0, int)
        sums = np.bincount(owners, weights=found, minlength=last - first).astype(np.int64)
        out += (sums + np.array(extra)).tolist()
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes long (UTF-8), n_tokens long, over_limit boolean.

    path names a byte-level BPE vocabulary (tokenizers JSON) that every executor has. Null and empty texts have 0 of
    both; texts of any length are counted whole; null ids and repeated rows pass through; other columns of `docs`
    don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column(1))
            counts = pa.array(count_tokens(texts, path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = picked.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
