"""Hashes of words and of runs of words, for whole batches of texts at a time."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 20


def mixed_hash(h: np.ndarray) -> np.ndarray:
    """A finaliser in which every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 2**64))
        done += k
    return out


_UP, _DOWN = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def hashed_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and how many each text has."""
    parts, counts, held, size = [], [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        held.append(raw.translate(_LOWER) if lower else raw)
        size += len(raw) + 1
        if size >= _CHUNK:
            h, c = _hashed(held)
            parts.append(h)
            counts.append(c)
            held, size = [], 0
    if held:
        h, c = _hashed(held)
        parts.append(h)
        counts.append(c)
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(parts), np.concatenate(counts)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    if len(_UP) < len(raw):
        _UP, _DOWN = _powers(_P, len(raw)), _powers(_P_INVERSE, len(raw))
    gap = _SPACE[raw]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    with np.errstate(over="ignore"):
        # Prefix sums of byte times power: a word's is the difference, moved back to position 0.
        sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], dtype=np.uint64)
        words = mixed_hash((sums[ends - 1] - sums[starts - 1]) * _DOWN[starts] + (ends - starts).astype(np.uint64))
    edges = np.cumsum([1, *[len(t) + 1 for t in texts]])
    at = np.searchsorted(starts, edges)
    return words, np.diff(at)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, whichever texts they are in."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            out = out * np.uint64(_P) + words[j : j + n]
        return mixed_hash(out)
