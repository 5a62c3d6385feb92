"""XXH64 of many slices of one byte buffer at once, in numpy (the published algorithm; fixed values below)."""

from __future__ import annotations

import numpy as np

# Fixed values of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Hashes (uint64) of buffer[start : start + length]; buffer is uint8."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buffer) + 1,), "<u8", padded.data, strides=(1,))
    at, left = starts.astype(np.int64), lengths.astype(np.int64)
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        out = np.full(len(at), s + P5)
        live = np.flatnonzero(left >= 32)
        if len(live):
            v = [np.full(len(live), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
            n = left[live] >> 5
            todo, step = np.arange(len(live)), 0
            while len(todo):
                base = at[live[todo]] + 32 * step
                for k in range(4):
                    v[k][todo] = _mix(v[k][todo], words[base + 8 * k])
                step += 1
                todo = todo[n[todo] > step]
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _mix(np.uint64(0), x)) * P1 + P4
            out[live] = h
            at = at + (left & ~31)
        out += lengths.astype(np.uint64)
        left = left & 31
        for k in range(3):
            live = np.flatnonzero(left >= 8 * (k + 1))
            out[live] = _rotl(out[live] ^ _mix(np.uint64(0), words[at[live] + 8 * k]), 27) * P1 + P4
        at, left = at + (left & ~7), left & 7
        live = np.flatnonzero(left >= 4)
        out[live] = _rotl(out[live] ^ ((words[at[live]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at, left = at + (left & 4), left & 3
        for k in range(3):
            live = np.flatnonzero(left > k)
            out[live] = _rotl(out[live] ^ (padded[at[live] + k].astype(np.uint64) * P5), 11) * P1
        out ^= out >> np.uint64(33)
        out *= P2
        out ^= out >> np.uint64(29)
        out *= P3
        out ^= out >> np.uint64(32)
    return out
