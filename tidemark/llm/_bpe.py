"""Byte-level BPE over whole texts by cached units.

A single space between two characters that aren't white space always starts a new match of the
split pattern, so a text falls into units at such places and each unit's ids don't depend on the
rest. Units repeat; each worker keeps the ids of those it has seen, up to a bound.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept by a worker, and the longest unit worth keeping.
CACHE_UNITS, CACHE_CHARS = 200_000, 48
#: White space but the space and the line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def library(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


class UnitEncoder:
    """Texts to ids (little-endian unsigned 32-bit, as bytes). ``resolve`` encodes a list of new units; ``keep`` are kept."""

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], keep: int = CACHE_UNITS):
        self.resolve, self.keep, self.cache = resolve, keep, {}

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        cache, split, todo = self.cache, [], {}
        if len(cache) > self.keep:
            cache.clear()
        for text in texts:
            units = self._units(text)
            for u in units:
                if u not in cache:
                    todo[u] = None
            split.append(units)
        if todo:
            cache.update(zip(todo, self.resolve(list(todo)), strict=True))
        get = cache.__getitem__
        out = [b"".join(map(get, units)) for units in split]
        for u in todo:
            if len(u) > CACHE_CHARS:
                del cache[u]
        return out

    @staticmethod
    def _units(text: str) -> list[str]:
        """Units whose concatenation is ``text``."""
        parts = text.split(" ")
        if len(parts) == 1:
            return parts if text else []
        units = [parts[0], *[" " + p for p in parts[1:]]]
        if "  " not in text and text[0] != " " and text[-1] != " " and " \n" not in text and "\n " not in text and not OTHER_SPACE.search(text):
            return units
        out, joined = [], False  # joined: the next unit belongs to the one before
        for k, part in enumerate(parts):
            rough = not part or part[0].isspace() or part[-1].isspace()
            if (joined or rough) and out:
                out[-1] += units[k]
            else:
                out.append(units[k])
            joined = rough
        return [u for u in out if u]


REGULAR = re.compile(r" [^\s](?:.*[^\s])?", re.S)


@lru_cache(maxsize=4)
def unit_encoder(path: str) -> UnitEncoder:
    """One encoder per worker and vocabulary, which resolves units with the tiktoken library."""
    encode, ranks = library(path).encode_ordinary, read_ranks(path)
    token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        token_bytes[rank] = len(token)

    def resolve(units: list[str]) -> list[bytes]:
        # regular units can stand in a row: their borders are borders of matches, and so of ids
        regular = [u for u in units if REGULAR.fullmatch(u)]
        ids = np.array(encode("".join(regular)), dtype="<u4")
        cuts = np.searchsorted(np.cumsum(token_bytes[ids]), np.cumsum([len(u.encode()) for u in regular])) + 1
        raw, ends = ids.tobytes(), iter((4 * cuts).tolist())
        out, start = [], 0
        of_regular = {}
        for u in regular:
            end = next(ends)
            of_regular[u] = raw[start:end]
            start = end
        for u in units:
            out.append(of_regular[u] if u in of_regular else np.array(encode(u), dtype="<u4").tobytes())
        return out

    return UnitEncoder(resolve)


def slices(texts: list[str], chars: int = 1 << 21) -> Iterable[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters, at least one text each."""
    start = total = 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_slices(column: pa.Array, chars: int = 1 << 20) -> Iterable[tuple[int, int, list[str]]]:
    """(start, end, texts) of runs of a string column of about ``chars`` bytes; null texts are empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices([range(n) for n in sizes], chars):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
