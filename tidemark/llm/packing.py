"""Operator 4 - best-fit packing of documents into token sequences by bin completion.

Documents are encoded whole, ended by id 0 and, where longer than a sequence, cut into full pieces
after a first, shorter one. Only lengths matter for packing, and there are at most ``capacity`` of
them: the histogram of lengths, bounded whatever the corpus, is solved on the driver. A filling is
built around the largest length left; fillings that fit beside it are searched depth first, larger
lengths first, skipping dominated ones (a filling whose part could be swapped for one larger length
that fits) and pruned by the waste of the best so far, which starts as the best-fit filling. The
filling is repeated as often as the counts allow, so a step uses up a length. Whole solutions
compete too: pure best fit is the first incumbent, and each further search order is given up once
its waste exceeds the incumbent's.

While the incumbent is above the lower bound, branch-and-bound takes parts of it to pieces: the
sequences with waste and some full ones (``PARTS`` in turn) are packed anew into one sequence less. There it
branches over all undominated fillings around the largest length left, by their waste, and returns
from a filling when the waste that the bound leaves is used up (:func:`fewer`). Such a search is exact
unless it ends by ``BRANCHES``; it is repeated until the bound is met or ``TRIES`` parts in a row have
given nothing. Packing is NP-hard: nothing is lost when a search ends, at worst a sequence more stays.

Pieces then take their places by their rank within their length; ranks are found bucket by bucket
(``rank_within``), so one length may hold any share of the rows.

Null texts are empty documents of one token; repeated rows are documents of their own. Texts of any
length are cut, none is left out. An empty table gives an empty result. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import text_slices, unit_encoder
from ._frames import modest_batches, rank_within, staged, trim

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CAPACITY, END = 2048, 0
#: Fillings looked at around one largest document before the best one found is taken.
NODES = 3000
#: Sequences that are packed anew at a time, fillings that such a search tries, and searches in a row without success.
PARTS, BRANCHES, TRIES = (8, 12, 16, 24), 2000, 80


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """``doc_id, piece, start, length, ids``: ids as little-endian unsigned 32-bit integers.

    ``ranks`` holds the same vocabulary as ``vocabulary``; texts that spell a special token go
    through the tokenizers library, which reads it as one id.
    """
    modest_batches(df.sparkSession)
    kind = df.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    with open(vocabulary) as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encoder = unit_encoder(ranks)
        for batch in batches:
            for a, _, texts in text_slices(batch.column(1)):
                owner, number, start, length, ids = [], [], [], [], []
                for k, (text, raw) in enumerate(zip(texts, encoder.encode_batch(texts), strict=True), a):
                    if any(s in text for s in special):
                        raw = np.array(tokenizer(vocabulary).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                    raw += END.to_bytes(4, "little")
                    n = len(raw) // 4
                    at, end, piece = 0, (n - 1) % capacity + 1, 0
                    while at < n:
                        owner.append(k), number.append(piece), start.append(at), length.append(end - at), ids.append(raw[4 * at : 4 * end])
                        at, end, piece = end, end + capacity, piece + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


Filling = tuple[int, ...]


def complete(room: int, counts: dict[int, int], lengths: list[int], nodes: int = NODES) -> Filling:
    """The lengths (longest first) that leave the least of ``room``; ``lengths`` are those at hand, longest first."""
    fits = [x for x in lengths if x <= room]
    best: list[int] = []
    rest, used = room, {}
    for x in fits:  # best fit: the longest that fits, again and again
        n = min(rest // x, counts[x])
        best += [x] * n
        rest -= n * x
    waste, seen = rest, 0
    have = set(fits)

    def search(k: int, rest: int, chosen: list[int]) -> None:
        nonlocal waste, best, seen
        if rest < waste:
            waste, best = rest, list(chosen)
        if not waste or seen > nodes or k >= len(fits):
            return
        if rest in have and counts[rest] > used.get(rest, 0) and rest <= fits[k]:  # one length fills the rest: dominates any split of it
            waste, best = 0, [*chosen, rest]
            return
        for j in range(k, len(fits)):
            x = fits[j]
            if x > rest or used.get(x, 0) >= counts[x]:
                continue
            seen += 1
            used[x] = used.get(x, 0) + 1
            chosen.append(x)
            search(j, rest - x, chosen)
            chosen.pop()
            used[x] -= 1
            if not waste or seen > nodes:
                return

    if waste:
        search(0, room, [])
    return tuple(best)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Fillings with how often each is used; together they use every length exactly as often as it occurs."""
    total = sum(x * n for x, n in histogram.items())
    least = -(-total // capacity)
    incumbent, bins = None, float("inf")
    for effort in (0, nodes, 8 * nodes):  # best fit alone, then bin completion, then a longer search
        counts, lengths = dict(histogram), sorted((x for x, n in histogram.items() if n), reverse=True)
        out, used, waste = [], 0, 0
        while lengths:
            top = lengths[0]
            counts[top] -= 1
            beside = complete(capacity - top, counts, lengths, effort)
            counts[top] += 1
            filling = (top, *beside)
            need = {x: filling.count(x) for x in set(filling)}
            times = min(counts[x] // n for x, n in need.items())
            for x, n in need.items():
                counts[x] -= n * times
            lengths = [x for x in lengths if counts[x]]
            out.append((filling, times))
            used += times
            waste += times * (capacity - sum(filling))
            if waste > (bins - 1) * capacity - total:  # it can't use fewer sequences than the incumbent
                break
        else:
            incumbent, bins = out, used
        if bins <= least:
            break
    return improved(incumbent, capacity, least) if incumbent and bins > least else incumbent or []


def undominated(room: int, counts: dict[int, int], lengths: list[int], budget: int, most: int = 400) -> list[tuple[int, Filling]]:
    """(waste, lengths) of the fillings of ``room`` with at most ``budget`` of waste, least first.

    Left out are fillings that leave room for a length at hand, and those in which a longer one could
    take a length's place: whatever they allow, the other allows too.
    """
    found: list[tuple[int, Filling]] = []
    have = [x for x in lengths if counts[x] and x <= room]
    used: dict[int, int] = {}

    def free(low: int, high: int) -> bool:
        """Is a length above ``low`` and up to ``high`` left over?"""
        return any(low < x <= high and counts[x] > used.get(x, 0) for x in have)

    def search(k: int, rest: int, chosen: list[int]) -> None:
        if len(found) >= most:
            return
        for j in range(k, len(have)):
            x = have[j]
            if x <= rest and used.get(x, 0) < counts[x]:
                used[x] = used.get(x, 0) + 1
                chosen.append(x)
                search(j, rest - x, chosen)
                chosen.pop()
                used[x] -= 1
        if rest <= budget and not free(0, rest) and not any(free(x, x + rest) for x in set(chosen)):
            found.append((rest, tuple(chosen)))

    search(0, room, [])
    return sorted(found, key=lambda f: (f[0], [-x for x in f[1]]))


def fewer(items: dict[int, int], bins: int, capacity: int, branches: int = BRANCHES) -> list[Filling] | None:
    """All of ``items`` in at most ``bins`` fillings by depth-first branch-and-bound, or None."""
    counts, out, left = dict(items), [], branches
    lengths = sorted(counts, reverse=True)

    def go(budget: int) -> bool:
        nonlocal left
        top = next((x for x in lengths if counts[x]), None)
        if top is None:
            return True
        counts[top] -= 1
        for waste, beside in undominated(capacity - top, counts, lengths, budget):
            left -= 1
            if left < 0:
                break
            for x in beside:
                counts[x] -= 1
            out.append((top, *beside))
            if go(budget - waste):
                return True
            out.pop()
            for x in beside:
                counts[x] += 1
        counts[top] += 1
        return False

    budget = bins * capacity - sum(x * n for x, n in items.items())
    return out if budget >= 0 and go(budget) else None


def improved(solution: list[tuple[Filling, int]], capacity: int, least: int, tries: int = TRIES) -> list[tuple[Filling, int]]:
    """``solution`` with sequences saved by packing parts of it anew."""
    fillings: dict[Filling, int] = {}
    for f, n in solution:
        fillings[f] = fillings.get(f, 0) + n
    rng, failed, turn = random.Random(5), 0, 0
    while sum(fillings.values()) > least and failed < tries:
        part, turn = PARTS[turn % len(PARTS)], turn + 1
        loose = sorted((f for f in fillings if sum(f) < capacity), key=sum)
        chosen: list[Filling] = []
        for f in loose:  # the emptiest first, until a sequence could be saved
            chosen += [f] * min(fillings[f], part - len(chosen))
            if len(chosen) >= part // 2 and sum(capacity - sum(c) for c in chosen) >= capacity:
                break
        names = sorted(fillings)
        while len(chosen) < min(part, sum(fillings.values())):
            f = rng.choice(names)
            if chosen.count(f) < fillings[f]:
                chosen.append(f)
        items: dict[int, int] = {}
        for f in chosen:
            for x in f:
                items[x] = items.get(x, 0) + 1
        again = fewer(items, len(chosen) - 1, capacity)
        failed = 0 if again else failed + 1
        if again is None and failed % 2 and len(chosen) > 4:  # other neighbours next time: shuffle what has waste
            again = fewer(items, len(chosen), capacity, BRANCHES // 4)
        if again:
            for f in chosen:
                fillings[f] -= 1
            for f in again:
                fillings[f] = fillings.get(f, 0) + 1
            fillings = {f: n for f, n in fillings.items() if n}
    return list(fillings.items())


def places(solution: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks of each length, sorted by (length, first rank), with first sequence and offset."""
    rows, taken, sequence = [], {}, 0
    for filling, times in solution:
        offset = 0
        for x in filling:
            rows.append((x, taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, length, ...``; staged, as it is read three times)."""
    counted = cut.groupBy("length").count().collect()  # a row a length, at most capacity rows
    table = places(solve({r["length"]: r["count"] for r in counted}, capacity, nodes))
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    ranked = rank_within(cut, ["length"], order, "rank")

    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(table["key"], (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(table["sequence"][k] + rank - table["rank"][k]), pa.array(table["offset"][k])], names=[*names, "sequence_id", "offset"])

    schema = cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.select(*cut.columns, "rank").mapInArrow(run, schema)


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of ``df`` with their places; ``keep_ids`` also returns each piece's ids."""
    cut = pieces(df, doc_id, text).withColumn("ids_crc32", F.crc32("ids"))
    return pack(staged(cut if keep_ids else cut.drop("ids")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
