"""Vectorised scans of many texts at once, used inside Arrow batches.

Texts are laid end to end as code points, each followed by one newline, so one numpy pass finds the
words or lines of a whole block. Spans are hashed by a polynomial prefix sum modulo 2**64.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

BLOCK_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * BLOCK_CHARS:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def blocks(texts: list[str | None], size: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``size`` characters, one text at least."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


class Flat:
    """Code points of ``texts`` end to end; ``starts[i]`` is where text i begins."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        joined = "\n".join(texts) + "\n" if texts else ""
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.starts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.starts[1:])
        self._prefix: np.ndarray | None = None

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the maximal runs of True; a run never crosses a text."""
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        return edge[0::2], edge[1::2]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(self.cp == 10)
        return np.concatenate(([0], ends[:-1] + 1)).astype(np.int64), ends

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One 64-bit hash a span."""
        if self._prefix is None:
            n = len(self.cp)
            self._prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.cp.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=self._prefix[1:])
        inverse = _power(_BASE_INVERSE, len(self.cp) + 1)
        return mix((self._prefix[end] - self._prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


@lru_cache(maxsize=4)
def table(kind: str) -> np.ndarray:
    """A property of every code point as a bool array, by the names below."""
    test: dict[str, Callable[[str], bool]] = {"alnum": str.isalnum, "alpha": str.isalpha}
    f = test[kind]
    return np.fromiter((f(chr(i)) for i in range(0x110000)), dtype=bool, count=0x110000)


def ascii_space(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13))


def window_hashes(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n consecutive items of one owner, with the index of its first item."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : len(h) - n + 1 + j]
    first = np.flatnonzero(owner[: len(h) - n + 1] == owner[n - 1 :])
    return mix(out[first]), first
