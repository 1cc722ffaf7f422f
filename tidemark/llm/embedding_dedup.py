"""Operator 9 - embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label are one class. Unit vectors are rotated onto the principal axes of the
whole table (its 64 x 64 moment matrix is summed on the executors), so that leading dimensions carry
the most of a dot product. Rows fall in bands of the leading coordinate as wide as two linked
vectors can differ; tiles of neighbouring bands meet. In a pair of tiles, dot products grow stage
by stage over leading dimensions; a pair goes on only while its partial sum plus the product of both
suffix norms (the most that the rest can add) reaches the threshold. What is left is decided by the
cosine of the original vectors in double precision.

Each unit returns counts by vector and the edges of a spanning forest, not its pairs. Rows with null
label, and null, zero or non-finite vectors, or vectors not of the commonest length, link with
nothing. Rows of one ``vec_id`` are one vector, the least usable of theirs by label and components, and
all get its result. Rows with null ``vec_id`` are returned unlinked. An empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import drop_staged, spread_join, staged
from ._graph import components
from ._tiles import units

THRESHOLD = 0.98
TILE, STAGES = 1024, (8, 16, 32)


def usable(vector: str):
    """True for vectors that are there, finite in every component and not zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def of_commonest_length(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has the length that most rows' have; of equally common ones, the largest."""
    first = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()  # a row a length
    return df.where(F.size(vector) == (first["d"] if first else 0))


def principal_axes(vectors: DataFrame, name: str) -> np.ndarray:
    """Columns: principal axes of the unit vectors, by descending second moment about their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = batch.column(0)
            if len(rows):
                x = np.asarray(rows.flatten()).astype(float).reshape(len(rows), -1)
                x /= np.linalg.norm(x, axis=1)[:, None]
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    got = vectors.select(name).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # (dimensions + 1) squared rows
    d = math.isqrt(len(got))
    if not d:
        return np.zeros((0, 0))
    m = np.array([r["v"] for r in got]).reshape(d, d)
    n, mean = m[-1, -1], m[:-1, -1] / m[-1, -1]
    return np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1]


def _linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in ``a`` and ``b`` (original vectors) of the pairs with cosine at least ``threshold``."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ya, yb = a / na[:, None] @ axes, b / nb[:, None] @ axes
    cuts = [0, *[s for s in STAGES if s < axes.shape[1]], axes.shape[1]]
    norms = lambda y, c: np.sqrt(np.maximum((y[:, c:] ** 2).sum(1), 0))
    found = [], []
    slack = 1e-9
    for lo in range(0, len(a), 256):
        y = ya[lo : lo + 256]
        dots = y[:, : cuts[1]] @ yb[:, : cuts[1]].T
        i, j = np.nonzero(dots + np.outer(norms(y, cuts[1]), norms(yb, cuts[1])) >= threshold - slack)
        dots = dots[i, j]
        for c, d in zip(cuts[1:-1], cuts[2:], strict=True):
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                dots[part] += np.einsum("ij,ij->i", y[i[part], c:d], yb[j[part], c:d])
            keep = dots + norms(y, d)[i] * norms(yb, d)[j] >= threshold - slack
            i, j, dots = i[keep], j[keep], dots[keep]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)]
            exact = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= threshold
            found[0].append(p[exact]), found[1].append(q[exact])
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, int)
    return join(found[0]), join(found[1])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the given ones over ``n`` nodes."""
    root = np.arange(n)
    while True:  # least neighbour's root, until nothing changes
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low), np.minimum.at(new, root[j], low)
        new = new[new[new]]
        if (new == root).all():
            break
        root = new[root]
    while (root[root] != root).any():
        root = root[root]
    return [(int(k), int(r)) for k, r in enumerate(root) if k != r]


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``.

    ``n_links`` counts the other rows linked to a row. A null ``vec_id`` has no component and is kept.
    """
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    good = of_commonest_length(rows.where(usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()), "v")
    if not rows.groupBy("vec_id").count().where("vec_id is not null and count > 1").isEmpty():
        good = good.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.v", "x.label")
    kind = rows.schema["vec_id"].dataType.simpleString()
    # a class: equal vectors of a label, named by 128 bits of hash; its least id stands for it
    keyed = staged(good.select("vec_id", "label", "v", F.struct(F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "v", "label")).alias("same")))
    classes = staged(keyed.groupBy("same").agg(F.first("label").alias("label"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    axes = principal_axes(classes, "v")
    if not len(axes):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = math.sqrt(2 * (1 - threshold)) + 1e-9  # unit vectors with that cosine are no further apart on any axis
    first = axes[:, 0]
    dot = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(c)) for c in first]), lambda x, c: x.cast("double") * c), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    banded = classes.withColumn("band", F.floor(dot / norm / F.lit(width)).cast("int"))
    dealt = units(banded, "label", "band", F.lit(1), F.col("same"), TILE, TILE)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["side", "id"])
        x = np.array(part["v"].tolist(), float)
        side, ids, copies = part["side"].to_numpy(), part["id"].to_numpy(), part["copies"].to_numpy()
        own = bool((side == 2).any())
        cut = 0 if own else int((side == 0).sum())
        i, j = _linked(x if own else x[:cut], x[cut:], axes, threshold)
        j = j + cut
        if own:
            i, j = i[i != j], j[i != j]
            counts = np.bincount(i, copies[j], len(ids))
        else:
            counts = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        edges = forest(i, j, len(ids))
        hit = np.flatnonzero(counts)
        return pd.DataFrame({"a": np.concatenate([ids[hit], ids[[e[0] for e in edges]]]) if len(hit) else ids[:0], "b": np.concatenate([ids[hit], ids[[e[1] for e in edges]]]) if len(hit) else ids[:0], "n": np.concatenate([counts[hit], np.zeros(len(edges))]).astype("int64") if len(hit) else np.zeros(0, "int64")})

    met = staged(dealt.select("unit", "side", "id", "copies", "v").groupBy("unit").applyInPandas(compare, f"a {kind}, b {kind}, n long"))
    counts = met.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    roots = components(met.where("a <> b"))
    classed = classes.select("id", "same", "copies").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    classed = staged(classed.select("same", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("root")))
    linked = staged(spread_join(keyed.select("vec_id", "same"), classed, "same").select("vec_id", "links", "root"))
    for x in (keyed, classes, met, classed):
        drop_staged(x)
    known = rows.where("vec_id is not null").select("vec_id").join(linked, "vec_id", "left")
    out = known.unionByName(rows.where("vec_id is null").select("vec_id", F.lit(None).cast("long").alias("links"), F.col("vec_id").alias("root")))
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
