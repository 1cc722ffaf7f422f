"""Operator 1 - near-duplicate documents by a MinHash LSH forest.

Documents with equal shingle sets are one class. A class's signature has one minimum per bin of its
hashed set; while bins are empty the set is hashed anew, so that short texts agree in a place as
likely, and as independently, as long ones. Each of ``TREES`` trees reads a run of ``DEEP`` places as a
string and sorts all classes by it: range partitions of (tree, string, class), so that a string shared
by many classes spans several tasks. Neighbours in the order are compared place by place; classes with
a longest common prefix of ``d`` places form a region of depth ``d``.

The depth asked for adapts to the region: the shallowest from ``SHALLOW`` places on at which no more
than ``ROOM`` classes share the prefix, and the full depth wherever there are more. Whatever the
crowd, a region never asks for more than the full depth, at which a pair at the threshold meets in no
tree with probability ``(1 - s^depth)^TREES``; that is kept under ``MISS`` (8 at 0.85, 6 at 0.8).
Shallower regions only add candidates.

Candidates are the pairs that share a region in some tree, and only these are compared, on full sets.
Classes that met, directly or by others, travel together to bounded units; a breadth-first search
over exact intersections returns the links that connect a unit's candidates. A family beyond a unit is
dealt over units twice at random, which finds nearly all of its links; then regions that still hold
several components are compared whole, in pairs of bounded tiles (:mod:`._tiles`), without the pairs
that are connected already. No cap limits partners, and no pair is confirmed by signatures.
Components of these links are the result.

Null texts and texts without words have empty sets and link with nothing; repeated rows are copies;
rows that share a ``doc_id`` are one document, which links with whatever one of them links to. Rows
with null ``doc_id`` are returned unlinked. Texts of any length are read whole. An empty table gives an
empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import drop_staged, maybe_broadcast, modest_batches, shuffle_partitions, spread_join, staged
from ._graph import components
from ._shingles import ODD, U, mix, shingle_sets
from ._tiles import units

TREES, DEEP, SHALLOW, ROOM = 32, 8, 5, 16
MISS = 1e-4
BINS = TREES * DEEP
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 18
#: Rows of a range partition of the sorted orders, about.
ORDER_ROWS = 1 << 20
#: Rehashes of a set are as many as leave an empty bin with this chance, about.
LEFT = 0.25


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of rehashes and of bins that stay empty, and the order in which trees read bins."""
    rounds = math.ceil(BINS * math.log(BINS / LEFT)) + 1
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, rounds + BINS + 1, dtype=np.uint64) * U(ODD))
    seeds[0] = 0
    return seeds[:rounds], seeds[rounds:], np.random.default_rng(23).permutation(BINS)


BIN_BITS = BINS.bit_length() - 1  # of a key: the bin, the rehash in 12 bits, the value
VALUE_BITS = U(64 - BIN_BITS - 12)


def signature(x: np.ndarray) -> np.ndarray:
    """16 bits for the minimum of each bin of a non-empty set of sorted hashes, in the order in which trees read bins.

    A bin holds the least hash of the first rehash that fills it, so two sets agree in a bin with the
    chance of their similarity, short ones too.
    """
    seeds, late, order = _draws()
    rounds = max(1, math.ceil(BINS * math.log(BINS / LEFT) / len(x)))
    value_mask = (U(1) << VALUE_BITS) - U(1)
    top = ~((U(1) << U(64 - BIN_BITS)) - U(1))
    with np.errstate(over="ignore"):
        if rounds == 1:
            keys = (x & top) | (x >> U(12)) & value_mask
        else:
            h = np.concatenate([x[None], mix(x[None] ^ seeds[1:rounds, None])])
            keys = np.sort(((h & top) | (np.arange(rounds, dtype=np.uint64)[:, None] << VALUE_BITS) | (h >> U(12)) & value_mask).ravel())
        edges = np.arange(BINS, dtype=np.uint64) << U(64 - BIN_BITS)
        at = np.searchsorted(keys, edges)
        full = np.append(at[1:], len(keys)) > at
        least = keys[np.minimum(at, len(keys) - 1)]
        for b in np.flatnonzero(~full).tolist():
            least[b] = mix(x ^ late[b]).min()
        return (mix(least ^ edges) >> U(48)).astype(">u2")[order]


def full_depth(percent: int) -> int:
    """Places that must agree where a region is crowded."""
    s = percent / 100
    return max([1, *[d for d in range(1, DEEP + 1) if (1 - s**d) ** TREES <= MISS]])


def sketch(df: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, same, strings`` of rows ``doc_id, text``: ``same`` names the set, ``strings`` are those of all trees; null if empty."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, same, strings = [], [], []
            for x in shingle_sets(batch.column(1), words):
                sizes.append(len(x))
                same.append(xxhash.xxh3_128_hexdigest(x.astype("<u8").tobytes()) if len(x) else None)
                strings.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.string()), pa.array(strings, pa.binary())], names=["doc_id", "n_shingles", "same", "strings"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, same string, strings binary")


def full_sets(df: DataFrame, words: int) -> DataFrame:
    """``doc_id, same, hashes``: each row's whole set as sorted little-endian 64-bit integers."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                sets = [x.astype("<u8").tobytes() for x in shingle_sets(part.column(1), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_hexdigest(x) for x in sets], pa.string()), pa.array(sets, pa.binary())], names=["doc_id", "same", "hashes"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, same string, hashes binary")


def leaves(tree: np.ndarray, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: the depth of each row's region, where regions start, and rows whose region may go on beyond the ends."""
    n = len(tree)
    equal = (strings[1:] == strings[:-1]) & (tree[1:] == tree[:-1])[:, None]
    prefix = np.concatenate([[0], np.logical_and.accumulate(equal[:, :depth], axis=1).sum(1)])  # longest common one with the row before
    leaf, first = np.zeros(n, np.int64), np.ones(n, bool)
    for d in range(min(SHALLOW, depth), depth + 1):
        starts = prefix < d
        run = np.cumsum(starts) - 1
        size = np.bincount(run)[run]
        pick = (leaf == 0) & ((size <= ROOM) | (d == depth))
        leaf[pick] = d
        first[pick] = starts[pick]
    run = np.cumsum(prefix < min(SHALLOW, depth)) - 1
    return leaf, first, (run == run[0]) | (run == run[-1])


def region_of(tree: np.ndarray, strings: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's prefix."""
    with np.errstate(over="ignore"):
        acc = mix(tree.astype(np.uint64) * U(ODD) + leaf.astype(np.uint64))
        for k in range(strings.shape[1]):
            acc = np.where(k < leaf, mix(acc * U(0xA0761D6478BD642F) + strings[:, k].astype(np.uint64)), acc)
    return acc.view(np.int64)


def meetings(classes: DataFrame, depth: int) -> DataFrame:
    """``node, region, leader`` (staged) of classes (``node, strings``) in each tree where their region holds others; ``leader`` is one of them."""
    width = 2 * DEEP
    runs = f"posexplode(transform(sequence(0, {TREES - 1}), i -> substring(strings, i * {width} + 1, {width}))) as (tree, s)"
    parts = max(shuffle_partitions(classes.sparkSession), math.ceil(classes.count() * TREES / ORDER_ROWS))
    ordered = classes.selectExpr("node", runs).repartitionByRange(parts, "tree", "s", "node").sortWithinPartitions("tree", "s", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()  # about ORDER_ROWS rows of some 40 bytes
        node, tree = table.column("node").to_numpy(), table.column("tree").to_numpy()
        raw = table.column("s").chunk(0)
        start = raw.offset * width
        strings = np.frombuffer(raw.buffers()[2], np.uint8)[start : start + len(raw) * width].view(">u2").reshape(-1, DEEP)
        leaf, first, open_ = leaves(tree, strings, depth)
        region = region_of(tree, strings, leaf)
        group = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        alone = np.bincount(group)[group] == 1
        closed, rest = np.flatnonzero(~open_ & ~alone), np.flatnonzero(open_)
        made = pa.array(region[closed]), pa.array(node[begin[group[closed]]])
        yield pa.RecordBatch.from_arrays([pa.array(node[closed]), *made, pa.nulls(len(closed), pa.int32()), pa.nulls(len(closed), pa.binary())], names=["node", "region", "leader", "tree", "s"])
        yield pa.RecordBatch.from_arrays([pa.array(node[rest]), pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array(tree[rest]), raw.take(pa.array(rest))], names=["node", "region", "leader", "tree", "s"])

    met = staged(ordered.mapInArrow(run, "node long, region long, leader long, tree int, s binary"))
    # regions at the ends of a partition may go on in the next: their depth follows from counts over all of them
    rows = staged(met.where("s is not null").select("node", "tree", "s", F.lit(depth).alias("leaf")))
    for d in range(depth - 1, min(SHALLOW, depth) - 1, -1):
        prefix = F.xxhash64("tree", F.lit(d), F.expr(f"substring(s, 1, {2 * d})"))
        named = staged(rows.withColumn("prefix", prefix))
        crowded = named.groupBy("prefix").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > ROOM)
        drop_staged(rows)
        rows = staged(spread_join(named, crowded, "prefix").select("node", "tree", "s", F.when(F.col("crowd").isNull(), F.lit(d)).otherwise(F.col("leaf")).alias("leaf")))
        drop_staged(named)
    named = staged(rows.select("node", F.xxhash64("tree", F.col("leaf"), F.expr("substring(s, 1, 2 * leaf)"), F.lit(1)).alias("region")))
    heads = named.groupBy("region").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    at_ends = spread_join(named, heads, "region").where("leader is not null").select("node", "region", "leader")
    out = staged(met.where("s is null").select("node", "region", "leader").unionByName(at_ends))
    for x in (met, rows, named):
        drop_staged(x)
    return out


def _similar(inter: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def connect(sets: list[np.ndarray], regions: list[np.ndarray], side: np.ndarray, known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what candidates connect: a breadth-first search over exact intersections.

    Candidates share a region, aren't of the same ``known`` component, and are of different sides (0, 1) unless the side is 2.
    """
    sizes = np.array([len(x) for x in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    values, code = np.unique(flat, return_inverse=True)
    code = code.astype(np.int32)
    mark = np.zeros(len(values), np.int32)
    owner = np.repeat(np.arange(len(sets)), [len(r) for r in regions])
    names, which = np.unique(np.concatenate(regions), return_inverse=True)
    members = np.split(owner[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which))[:-1]) if len(names) else []
    own = np.split(which, np.cumsum([len(r) for r in regions])[:-1])
    done = np.zeros(len(sets), bool)
    edges: list[tuple[int, int]] = []
    for seed in range(len(sets)):
        if done[seed]:
            continue
        done[seed] = True
        queue = [seed]
        while queue:
            i = queue.pop()
            mine = []
            for r in own[i].tolist():
                rows = members[r]
                gone = done[rows]
                if gone.any():  # rows that a component holds are never asked for again
                    rows = members[r] = rows[~gone]
                mine.append(rows)
            near = np.unique(np.concatenate(mine)) if mine else np.zeros(0, int)
            if side[i] != 2:
                near = near[side[near] != side[i]]
            near = near[known[near] != known[i]]
            small, large = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
            near = near[100 * small >= percent * large]
            if not len(near):
                continue
            mark[code[starts[i] : starts[i + 1]]] = 1
            codes = np.concatenate([code[starts[j] : starts[j + 1]] for j in near])
            inter = np.add.reduceat(mark[codes], np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            mark[code[starts[i] : starts[i + 1]]] = 0
            hit = near[_similar(inter, int(sizes[i]), sizes[near], percent)]
            done[hit] = True
            edges += [(i, int(j)) for j in hit]
            queue += hit.tolist()
    return edges


def compared(dealt: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b`` (staged): links of the rows of each unit; ``dealt`` has ``node, unit, side, regions, known``, staged."""
    needed = staged(reps.join(dealt.select("node").distinct(), "node", "left_semi"))  # node, doc_id, same
    some = docs.select("doc_id", "text").join(maybe_broadcast(needed.select("doc_id").distinct(), 48), "doc_id", "left_semi")
    # of rows that share a doc_id and a set any will do
    sets = full_sets(some, words).join(maybe_broadcast(needed, 96), ["doc_id", "same"]).select("node", "hashes")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["node"]).sort_values(["side", "node"])
        node = part["node"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in part["hashes"]]
        found = connect(sets, part["regions"].tolist(), part["side"].to_numpy(), part["known"].to_numpy(), percent) if len(part) > 1 else []
        return pd.DataFrame({"a": node[[e[0] for e in found]], "b": node[[e[1] for e in found]]})

    met = staged(sets.join(dealt, "node").groupBy("unit").applyInPandas(compare, "a long, b long"))
    drop_staged(needed)
    return met


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: confirmed links between classes (``node, doc_id, same, n_shingles, strings``), enough to connect every component."""
    met = meetings(classes.select("node", "strings"), full_depth(percent))
    reps = classes.select("node", "doc_id", "same")
    found = met.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    own = met.groupBy("node").agg(F.collect_list("region").alias("regions"))  # one a tree, at most
    family = staged(components(found).withColumnRenamed("component", "family").join(classes.select("node", "n_shingles"), "node").join(own, "node"))
    sums = family.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("weight"))
    parts = F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("weight") / TILE_SHINGLES)).cast("int")
    rows = staged(spread_join(family, sums.select("family", parts.alias("parts")), "family"))
    # small families share units: only rows with a region in common are compared
    total = rows.where("parts = 1").agg(F.sum("n_shingles"), F.count(F.lit(1))).first()
    bundles = max(1, math.ceil((total[0] or 0) / (TILE_SHINGLES / 2)), math.ceil(total[1] / (TILE_ROWS / 2)))
    never = F.col("node").alias("known")  # no two of a unit are known to be connected
    small = rows.where("parts = 1").select("node", F.pmod(F.xxhash64("family"), F.lit(bundles)).alias("unit"), F.lit(2).alias("side"), "regions", never)
    large = rows.where("parts > 1")
    deals = [large.select("node", F.xxhash64("family", F.lit(k), F.pmod(F.xxhash64("node", F.lit(k)), F.col("parts"))).alias("unit"), F.lit(2).alias("side"), "regions", never) for k in (1, 2)]
    dealt = staged(small.unionByName(deals[0]).unionByName(deals[1]))
    edges = compared(dealt, reps, docs, words, percent)
    drop_staged(dealt)
    if not large.isEmpty():
        edges = edges.unionByName(_rest(docs, met, large, reps, edges, words, percent))
    for x in (met, family, rows):
        drop_staged(x)
    return edges


def _rest(docs: DataFrame, met: DataFrame, large: DataFrame, reps: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """Links within regions of large families that still hold several components."""
    roots = components(edges).withColumnRenamed("component", "known")
    known = staged(large.select("node", "n_shingles").join(roots, "node", "left").select("node", "n_shingles", F.coalesce("known", "node").alias("known")))
    inside = staged(met.select("node", "region").join(known, "node"))
    mixed = inside.groupBy("region").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("region", F.lit(True).alias("mixed"))
    # sets that can be similar differ in size by less than a band
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-math.log(percent / 100))).cast("int")
    rows = staged(spread_join(inside, mixed, "region").where("mixed").drop("mixed").withColumn("band", band))
    dealt = staged(units(rows, "region", "band", F.col("n_shingles"), F.col("node"), TILE_ROWS, TILE_SHINGLES).select("node", "unit", "side", F.array("region").alias("regions"), "known"))
    out = compared(dealt, reps, docs, words, percent)
    for x in (known, inside, rows, dealt):
        drop_staged(x)
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; sets link from ``percent`` of their union on."""
    modest_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = staged(sketch(docs, words).withColumn("row", F.monotonically_increasing_id()))
    linked = F.col("same").isNotNull() & F.col("doc_id").isNotNull()
    some = rows.where(linked)
    classes = staged(some.groupBy("same").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("strings").alias("strings")))
    edges = links(docs, classes, words, percent)
    # rows of one doc_id join the classes of their texts
    twice = some.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low < high").select("doc_id", "low")
    if not twice.isEmpty():
        pairs = staged(spread_join(some.select("doc_id", "same"), twice, "doc_id").where("low is not null").select("same", "low").distinct())
        name = classes.select("same", F.col("node").alias("a"))
        other = classes.select(F.col("same").alias("low"), F.col("node").alias("b"))
        edges = edges.unionByName(pairs.join(name, "same").join(other, "low").select("a", "b"))
    roots = components(edges).withColumnRenamed("component", "root")
    classed = classes.select("same", "doc_id", "node").join(roots, "node", "left").select("same", "doc_id", F.coalesce("root", "node").alias("root"))
    classed = staged(classed)
    least = classed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = staged(spread_join(classed, least, "root").select("same", "component_id"))
    joined = spread_join(some.select("doc_id", "n_shingles", "same"), named, "same").select("doc_id", "n_shingles", "component_id")
    rest = rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if not twice.isEmpty():  # an empty text of a document that has others
        whole = staged(joined.unionByName(rest))
        own = whole.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("own"))
        found = spread_join(whole, own, "doc_id").select("doc_id", "n_shingles", F.coalesce("own", "component_id").alias("component_id"))
    else:
        found = joined.unionByName(rest)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each group, the document with the least id stays.

    Rows without a ``doc_id`` stay; of rows that share one, the one with the least text stays.
    """
    gone = staged(near_duplicates(df, doc_id, text, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct())
    out = df.join(maybe_broadcast(gone, 48), df[doc_id] == F.col("__gone"), "left_anti")
    twice = df.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__twice")).count().where("count > 1").select("__twice")
    if twice.isEmpty():
        return out
    twice = maybe_broadcast(staged(twice), 48)
    alone = out.join(twice, out[doc_id] == F.col("__twice"), "left_anti")
    shared = out.join(twice, out[doc_id] == F.col("__twice"), "left_semi")
    whole = F.struct(*[F.col(c) for c in df.columns])
    one = shared.groupBy(F.col(doc_id).alias("__id")).agg(F.min_by(whole, F.struct(F.col(text), F.xxhash64(*[F.col(c) for c in df.columns]))).alias("__row"))
    return alone.unionByName(one.select("__row.*"))
