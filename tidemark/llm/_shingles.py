"""Word shingles of whole texts as 64-bit hashes, made by array operations over Arrow buffers.

Words are runs of bytes that aren't ASCII white space, with A-Z lower-cased. A word's hash is a
polynomial over a mixed byte table, taken from running sums of the whole buffer; a shingle's mixes
its words' hashes. Texts of fewer words than a shingle make one shingle of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ._bpe import slices

U = np.uint64
ODD = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
WORD_SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Hash and white-space flag of every byte, upper case folded."""
    codes = np.arange(256, dtype=np.uint64)
    fold = codes.copy()
    fold[65:91] += U(32)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    with np.errstate(over="ignore"):
        return mix((fold + U(1)) * U(ODD)), space


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a string column; empty for null and wordless texts."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    hashes, spaces = _tables()
    seeds = np.array([WORD_SEEDS[k % len(WORD_SEEDS)] + 2 * k for k in range(words)], np.uint64) | U(1)
    with np.errstate(over="ignore"):
        for a, b in slices([range(n) for n in np.diff(starts).tolist()], 1 << 20):
            lo, hi = int(starts[a]), int(starts[b])
            buf = data[lo:hi]
            edge = starts[a : b + 1] - lo
            inside = np.concatenate([[False], ~spaces[buf], [False]])
            first = inside[1:-1] & ~inside[:-2]
            last = inside[1:-1] & ~inside[2:]
            full = edge[:-1] < edge[1:]  # words don't run across texts
            at = edge[:-1][full]
            first[at] = inside[1:-1][at]
            at = edge[1:][full] - 1
            last[at] = inside[1:-1][at]
            begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            up, down = _power(len(buf) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[buf] * up[: len(buf)])])
            word = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
            m = len(word)
            acc = np.zeros(max(0, m - words + 1), np.uint64)
            for k in range(words):
                acc += word[k : k + len(acc)] * seeds[k]
            shingle = mix(acc + U(words))
            own = np.searchsorted(begin, edge)
            for s, e in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
                n = e - s
                if n >= words:
                    x = np.sort(shingle[s : e - words + 1])
                    keep = np.ones(len(x), bool)
                    np.not_equal(x[1:], x[:-1], out=keep[1:])
                    yield x[keep]
                elif n:
                    yield mix(np.atleast_1d((word[s:e] * seeds[:n]).sum(dtype=np.uint64) + U(n)))
                else:
                    yield np.zeros(0, np.uint64)
