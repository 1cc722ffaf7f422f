"""Subsamples of fixed length for embedding models, as array expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

NAMES = ("beginning", "end", "middle", "random-subsample", "non-overlapping-windows")

#: Query vectors that ``similar`` broadcasts at a time.
QUERY_BLOCK = 10_000


def subsamples(series: Column, size: int, how: str | Sequence[str], key: Column | None = None, seed: int = 0) -> Column:
    """``array<array<observation>>``: one subsample, one per window, or those of several reductions in turn."""
    if not isinstance(how, str):
        return F.concat(*[subsamples(series, size, h, key, seed) for h in how])
    n = F.size(series)
    k = F.lit(int(size))
    if how == "beginning":
        return F.array(F.slice(series, 1, k))
    if how == "end":
        return F.array(F.slice(series, F.greatest(n - k, F.lit(0)) + 1, k))
    if how == "middle":
        start = F.greatest(F.lit(0), F.least(F.floor(n / 2) - F.lit(size // 2), (n - k).cast("long"))).cast("int")
        return F.array(F.slice(series, start + 1, k))
    if how == "random-subsample":  # the least hashes, in order of time
        marked = F.transform(series, lambda x, i: F.struct(F.xxhash64(F.lit(seed), key if key is not None else F.lit(0), i).alias("h"), i.alias("i"), x.alias("x")))
        chosen = F.slice(F.array_sort(F.transform(marked, lambda y: F.struct(y["h"], y["i"], y["x"]))), 1, k)
        ordered = F.array_sort(F.transform(chosen, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x"))))
        return F.array(F.transform(ordered, lambda y: y["x"]))
    if how == "non-overlapping-windows":
        last = F.greatest(F.ceil(n / k).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda w: F.slice(series, w * k + 1, k))
    raise ValueError(f"unknown reduction {how!r}; there are {', '.join(NAMES)}")


def reduce_series(df: DataFrame, size: int, how: str | Sequence[str] = "end", seed: int = 0) -> DataFrame:
    """``object_id, step, lc``: a row per subsample of each object of a long table."""
    series = df.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("t", "m", "sigma", "band"))).alias("s"))
    return series.select("object_id", F.posexplode(subsamples(F.col("s"), size, how, F.col("object_id"), seed)).alias("step", "lc"))


def padded(lc: Column, size: int, field: str, left: bool = False, fill: float = 0.0) -> Column:
    """One field of a subsample at a fixed length, zeros (or ``fill``) after, or before, what is there."""
    have = F.transform(lc, lambda x: x[field])
    rest = F.array_repeat(F.lit(float(fill)), F.lit(size) - F.size(lc))
    return F.concat(rest, have) if left else F.concat(have, rest)


def mask(lc: Column, size: int) -> Column:
    """True where an observation is, False on padding."""
    return F.concat(F.array_repeat(F.lit(True), F.size(lc)), F.array_repeat(F.lit(False), F.lit(size) - F.size(lc)))


def mean_over_windows(df: DataFrame, keys: Sequence[str], vector: str = "embedding", name: str = "embedding") -> DataFrame:
    """Mean of vectors by key, place by place."""
    flat = df.select(*keys, F.posexplode(vector).alias("k", "x"))
    return flat.groupBy(*keys, "k").agg(F.avg("x").alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).select(*keys, F.transform("v", lambda p: p["x"]).alias(name))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as doubles; None where one is null or holds a null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.values, column.offsets.to_numpy()
    x = flat.to_numpy(zero_copy_only=False).astype(float)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]) if flat.null_count else np.zeros(len(x) + 1, int)
    return [x[i:j] if ok and gaps[i] == gaps[j] else None for i, j, ok in zip(at[:-1], at[1:], known, strict=True)]


def _sum(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added up from the first place to the last."""
    return np.cumsum(x, 1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _units(vectors: Sequence[np.ndarray | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the vectors, and the vectors divided by their norms."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(-1 if v is None else len(v), []).append(i)
    out = {}
    for size, at in by.items():
        x = np.stack([vectors[i] for i in at]) if size >= 0 else np.empty((len(at), 0))
        out[size] = np.array(at), x / np.sqrt(_sum(x * x))[:, None]
    return out


def _nine_places(x: np.ndarray) -> np.ndarray:
    """Rounded to nine decimal places, halves away from zero, as the engine rounds."""
    y = x * 1e9
    out = np.rint(y)
    for i in np.flatnonzero(np.abs(np.abs(y - np.trunc(y)) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return out / 1e9 + 0.0


#: Rows and queries of a tile of products, and by how much a product of matrices may differ from a cosine that is rounded.
TILE_ROWS, TILE_QUERIES, SLACK = 2048, 1024, 2e-9
#: Scores of pairs without a cosine (a null, another length), which come last, and of those that are NaN, which come first.
NONE, NAN = -2.0, np.inf


def _tile(ids: np.ndarray, rows: dict, asked: np.ndarray, wanted: dict, first: int, last: int, best: tuple[np.ndarray, np.ndarray], k: int) -> None:
    """Take the rows of a tile that are among the ``k`` best of queries ``first`` to ``last`` into ``best``."""
    score, name = best
    for size, (at, units) in wanted.items():
        some = np.flatnonzero((at >= first) & (at < last))
        if not len(some):
            continue
        at, units = at[some], units[some]
        near = np.full((len(at), len(ids)), NONE)
        here, mine = rows.get(size, (np.empty(0, int), np.empty((0, max(size, 0))))) if size >= 0 else (np.empty(0, int), None)
        if len(here):
            near[:, here] = units @ mine.T
        near[np.isnan(near)] = NAN
        near[asked[at][:, None] == ids] = -np.inf
        least = score[at, k - 1]
        if not np.isfinite(least).all() and len(ids) > k:
            least = np.maximum(least, np.partition(near, len(ids) - k, 1)[:, len(ids) - k])
        q, r = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
        if not len(q):
            continue
        exact = near[q, r]
        real = np.isfinite(exact) & (exact != NONE)
        place = np.zeros(len(ids), int)
        place[here] = np.arange(len(here))
        for chunk in np.array_split(np.flatnonzero(real), real.sum() // 65536 + 1):
            exact[chunk] = _nine_places(_sum(units[q[chunk]] * mine[place[r[chunk]]])) if len(chunk) else exact[chunk]
        held = np.unique(q)
        owner = np.concatenate([q, np.repeat(held, k)])
        marks, names = np.concatenate([exact, score[at[held]].ravel()]), np.concatenate([ids[r], name[at[held]].ravel()])
        order = np.lexsort((np.unique(names, return_inverse=True)[1], -marks, owner))
        owner = owner[order]
        begin = np.searchsorted(owner, held)
        chosen = order[(begin[:, None] + np.arange(k)).ravel()]
        score[at[held]], name[at[held]] = marks[chosen].reshape(-1, k), names[chosen].reshape(-1, k)


def similar(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, cosine`` of the ``k`` nearest of every query vector, its own left out.

    Queries are broadcast in blocks of ``QUERY_BLOCK`` and every row meets them in one pass: tiles of rows
    times queries are products of matrices, a task keeps each query's ``k`` best, and those of the tasks are ranked.
    What a product brings near the best is added up again place by place, so that ties to nine places fall by id.
    """
    spark = df.sparkSession
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q")).where("query_id is not null").toArrow()
    blocks = [spark.sparkContext.broadcast((b.column("query_id").to_numpy(), _units(_vectors(b.column("q"))))) for b in (asked.slice(i, QUERY_BLOCK) for i in range(0, len(asked), QUERY_BLOCK))]
    q_kind = pa.schema([asked.schema.field("query_id")])
    tile_rows, tile_queries = TILE_ROWS, TILE_QUERIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = []
        kind = None
        for batch in batches:
            for at in range(0, batch.num_rows, tile_rows):
                part = batch.slice(at, tile_rows)
                ids, kind = part.column(0).to_numpy(zero_copy_only=False), part.schema.field(0).type
                with np.errstate(all="ignore"):
                    rows = _units(_vectors(part.column(1)))
                    for b, block in enumerate(blocks):
                        asked, wanted = block.value
                        if len(best) == b:
                            best.append((np.full((len(asked), k), -np.inf), np.full((len(asked), k), ids[0], ids.dtype)))
                        for first in range(0, len(asked), tile_queries):
                            _tile(ids, rows, asked, wanted, first, first + tile_queries, best[b], k)
        for block, (score, name) in zip(blocks, best, strict=False):
            q, j = np.nonzero(score > -np.inf)
            s = score[q, j]
            cosine = pa.array(np.where(s == NAN, np.nan, s), mask=s == NONE)
            yield pa.RecordBatch.from_arrays([pa.array(block.value[0][q], q_kind.field(0).type), pa.array(name[q, j], kind), cosine], ["query_id", "vec_id", "cosine"])

    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null")
    schema = StructType([StructField("query_id", queries.schema[key].dataType), StructField("vec_id", df.schema[key].dataType), StructField("cosine", DoubleType())])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return rows.mapInArrow(run, schema).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")
