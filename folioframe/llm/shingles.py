"""Sets of hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
PIECE = 1 << 20  # bytes that one pass handles; a longer text is a pass of its own

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        _powers = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BACK)
        )
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit integers (finaliser of a multiply-and-shift generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of a byte string."""
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    forth, back = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[: len(data)])])
    return start, mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > PIECE:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each UTF-8 text, in order.

    Words are runs without ASCII white space, A-Z lower-cased.  A text with fewer words
    than ``width`` has its whole sequence as its one shingle; without words, none.
    """
    for _, part in _pieces(texts):
        start, word = _words(b"\n".join(part))
        ends = np.cumsum([len(t) + 1 for t in part])
        upto = np.searchsorted(start, ends)
        low = 0
        for high in upto:
            w = word[low:high]
            low = high
            n = len(w)
            if n == 0:
                yield w
                continue
            k = min(n, width)
            h = np.full(n - k + 1, k, np.uint64)
            for j in range(k):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[j : n - k + 1 + j])
            yield np.unique(h)
