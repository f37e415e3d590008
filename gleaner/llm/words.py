"""Vectorised words: numpy finds and hashes the words of many documents in one pass over an Arrow buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text that are hashed at once; a longer document is a chunk of its own
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240613)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        p = _P if kind == "up" else pow(_P, -1, 2**64)
        out = np.full(max(n, min(2 * n, CHUNK)), p, np.uint64)
        out[0] = 1
        _powers[kind] = np.multiply.accumulate(out)
    return _powers[kind][:n]


def binary(column: pa.Array) -> pa.Array:
    """Texts as bytes; null is empty."""
    return column.fill_null("").cast(pa.large_binary())


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``CHUNK`` bytes."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK, "right")) - 1)
        yield lo, min(hi, len(texts))
        lo = hi


def scan(texts: pa.Array, lo: int, hi: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents lo..hi: bytes, starts and ends of words in them, and the first word of each document (hi-lo+1)."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)[lo : hi + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if lower:
        buf = _LOWER[buf]
    black = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[ends] = True
    before = np.concatenate(([False], black[:-1])) & ~cut[:-1] if len(buf) else black
    after = np.concatenate((black[1:], [False])) & ~cut[1:] if len(buf) else black
    starts, stops = np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1
    return buf, starts, stops, np.searchsorted(starts, ends)


def hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * _power("up", len(buf)), out=total[1:])
        return mix((total[stops] - total[starts]) * _power("down", len(buf) + 1)[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes (of a shorter array: none)."""
    with np.errstate(over="ignore"):
        out = h[: max(0, len(h) - n + 1)].copy()
        for i in range(1, n):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i])
        return out
