"""Operator 3 - approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a hash string of ``BITS`` bits, the signs of as many random projections
(orthogonal ones, within a tree), and keeps the strings sorted. A query descends each tree to its
string's place; the neighbours there share its longest prefix, however long it is. Then all trees
ascend together, from the length that half of the trees match on: at length ``l`` the candidates are
the rows that share the first ``l`` bits in any tree, each a range of a sorted array. The ascent ends
at the longest ``l`` at which a row as near as the query's ``K``-th best would have been met with
probability ``RECALL``: ``1 - (1 - p^l)^TREES``, with ``p`` the chance that such a row agrees in one
bit. Lengths in between are passed at once, as the ranges of a shorter prefix hold those of longer
ones. So vectors with close neighbours stop early, and no cap cuts the candidates off. Candidates are
ranked by exact inner products of the original vectors in double precision.

What is known of the ``K``-th best before a search is its nearness among ``SAMPLE`` rows, drawn by hash
of the id: a bound that can't exceed the true one. It improves with what the first matches find.

Largest inner product is turned into least angle by one more dimension for index rows,
``sqrt(M^2 - |x|^2)`` with ``M`` the largest norm of the table.

Every row is indexed, in one of the index's blocks of about ``INDEX_ROWS``; a block's sorted arrays are
built once, by one task, and the queries stream past them in batches. Nothing is fitted to the data.

Rows whose vector is null, zero or not finite, or not of the commonest length, take no part. Rows that
share an id are one vector, the least of theirs by component. Ties go to the smaller id. Fewer rows
than ``k`` give as many neighbours as there are; an empty table, or one without queries, gives an empty
result. Other columns are not read. Measured recall against brute force stands in the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .embedding_dedup import of_commonest_length, usable

K, TREES, BITS, RECALL = 20, 192, 32, 0.9
INDEX_ROWS, SAMPLE, SEED = 8192, 16_384, 17
#: Queries that descend at a time.
TOGETHER = 128


def planes(dimensions: int, trees: int, bits: int, seed: int) -> np.ndarray:
    """Directions of all trees, the same in every worker: orthogonal within a tree as far as there are dimensions."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        parts = [np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0] for _ in range(-(-bits // dimensions))]
        out.append(np.hstack(parts)[:, :bits])
    return np.hstack(out)


class Forest:
    """Sorted arrays of hash strings over one block of vectors."""

    def __init__(self, x: np.ndarray, largest: float, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.x, self.trees, self.bits, self.largest = x, trees, bits, largest
        self.planes = planes(x.shape[1] + 1, trees, bits, seed)
        extra = np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))
        codes = self._codes(np.hstack([x, extra[:, None]]))
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """(tree, row): hash strings as integers, first bit highest."""
        out = np.zeros((self.trees, len(x)), np.int64)
        for lo in range(0, len(x), 1024):
            signs = (x[lo : lo + 1024] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            weights = np.left_shift(np.int64(1), np.arange(self.bits - 1, -1, -1, dtype=np.int64))
            out[:, lo : lo + 1024] = (signs @ weights).T
        return out

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """(tree, query): the length of the longest prefix that a query shares with a row."""
        n = len(self.x)
        out = np.zeros(codes.shape, np.int64)
        for t, own in enumerate(self.sorted):
            at = np.searchsorted(own, codes[t])
            apart = np.minimum(own[np.minimum(at, n - 1)] ^ codes[t], own[np.maximum(at - 1, 0)] ^ codes[t])
            out[t] = self.bits - np.frexp(apart.astype(float))[1]
        return out

    def ranges(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tree, query): the range of the rows that share a query's first ``length`` bits."""
        step = np.left_shift(np.int64(1), self.bits - length)
        low = codes // step * step
        at = lambda v: np.stack([np.searchsorted(own, x) for own, x in zip(self.sorted, v, strict=True)])
        return at(low), at(low + step)

    def enough(self, kth: np.ndarray, norms: np.ndarray, recall: float) -> np.ndarray:
        """The longest prefix at which a row with that inner product is met with probability ``recall``."""
        cosine = np.clip(kth / np.maximum(norms * self.largest, 1e-300), -1, 1)
        p = np.clip(1 - np.arccos(cosine) / math.pi, 1e-9, 1 - 1e-12)
        share = 1 - (1 - recall) ** (1 / self.trees)  # of a tree
        return np.clip(np.floor(math.log(share) / np.log(p)), 0, self.bits).astype(np.int64)

    def met(self, codes: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
        """The rows that each query shares ``length`` bits with in some tree."""
        n = len(self.x)
        first, last = (x.T for x in self.ranges(codes, length))
        size = (last - first).ravel()
        begin = (first + n * np.arange(self.trees)).ravel()
        spot = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
        ends = np.cumsum((last - first).sum(1)).tolist()
        every = self.order.ravel()[spot]
        seen = np.zeros(n, bool)
        for a, b in zip([0, *ends], ends, strict=False):
            seen[every[a:b]] = True
            rows = np.flatnonzero(seen)
            seen[rows] = False
            yield rows

    def search(self, q: np.ndarray, k: int, floor: np.ndarray, recall: float = RECALL) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, inner products) met for each query, all of them exact; ``floor`` bounds the k-th best from below."""
        out = []
        norms = np.linalg.norm(q, axis=1)
        for lo in range(0, len(q), TOGETHER):
            part = q[lo : lo + TOGETHER]
            codes = self._codes(np.hstack([part, np.zeros((len(part), 1))]))
            begin = np.median(self.longest(codes), axis=0).astype(np.int64)
            kth = floor[lo : lo + TOGETHER].copy()
            for j, rows in enumerate(self.met(codes, begin)):
                if len(rows) >= k:
                    kth[j] = max(kth[j], np.partition(self.x[rows] @ part[j], -k)[-k])
            end = np.minimum(begin, self.enough(kth, norms[lo : lo + TOGETHER], recall))
            for j, rows in enumerate(self.met(codes, end)):
                out.append((rows, self.x[rows] @ part[j]))
        return out


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, dimensions)


def nearest(df: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of every row where ``queries`` holds."""
    spark = df.sparkSession
    good = of_commonest_length(df.where(usable(vector) & F.col(vec_id).isNotNull()), vector)
    rows = good.select(F.col(vec_id).alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"), F.max(F.size("v")).alias("d")).first()
    kind = rows.schema["vec_id"].dataType.simpleString()
    out_schema = f"query_id {kind}, vec_id {kind}, score double"
    if not stats["n"]:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    blocks, d, largest = math.ceil(stats["n"] / INDEX_ROWS), stats["d"], float(stats["largest"]) * (1 + 1e-12)
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow().combine_chunks()  # a bounded sample
    handle = spark.sparkContext.broadcast((drawn.column("vec_id").to_numpy(), _vectors(drawn.column("v").chunk(0), d)))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = handle.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                dots = _vectors(part.column(1), d) @ x.T
                dots[part.column(0).to_numpy(zero_copy_only=False)[:, None] == ids[None]] = -np.inf
                floor = np.partition(dots, -k, 1)[:, -k] if len(x) >= k else np.full(len(part), -np.inf)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor)], names=["vec_id", "v", "floor"])

    asked = rows.where("asks").select("vec_id", "v").mapInArrow(floors, f"vec_id {kind}, v array<double>, floor double")
    index = rows.select("vec_id", "v", F.lit(None).cast("double").alias("floor"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, in a block first the index and then the queries."""
        block, held, forest, ids = None, [], None, None
        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("asks").to_numpy(zero_copy_only=False))) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                if part.column("block")[0].as_py() != block:
                    block, held, forest = part.column("block")[0].as_py(), [], None
                if not part.column("asks")[0].as_py():
                    held.append((part.column("vec_id").to_numpy(zero_copy_only=False), _vectors(part.column("v"), d)))
                    continue
                if not held:  # no row was dealt to this block
                    continue
                if forest is None:
                    ids, forest = np.concatenate([i for i, _ in held]), Forest(np.concatenate([x for _, x in held]), largest, trees)
                own, q = part.column("vec_id").to_numpy(zero_copy_only=False), _vectors(part.column("v"), d)
                query, near, score = [], [], []
                for r, (at, dots) in enumerate(forest.search(q, k + 1, part.column("floor").to_numpy(), recall)):
                    other = ids[at] != own[r]
                    at, dots = at[other], dots[other]
                    if len(at) > k:
                        some = dots >= np.partition(dots, -k)[-k]
                        at, dots = at[some], dots[some]
                    best = np.lexsort((ids[at], -dots))[:k]
                    query.append(np.full(len(best), own[r])), near.append(ids[at[best]]), score.append(dots[best])
                columns = [np.concatenate(c) if c else np.zeros(0) for c in (query, near, score)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    made = pa.schema([("query_id", drawn.schema.field("vec_id").type), ("vec_id", drawn.schema.field("vec_id").type), ("score", pa.float64())])
    sorted_ = index.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "vec_id")
    found = sorted_.mapInArrow(search, out_schema)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
