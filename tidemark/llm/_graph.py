"""Connected components of an edge table by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import drop_staged, spread_join, staged

#: Edges that one task contracts, some 100 bytes each while it does; more are contracted round by round until so few are left.
AT_ONCE = 1 << 19


def least_reachable(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 to ``n`` - 1 that each can reach over the edges between ``x`` and ``y``."""
    to = np.arange(n)
    while len(x):
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (ahead := to[to]).tobytes() != to.tobytes():
            to = ahead
        x, y = to[x], to[y]
        x, y = x[x != y], y[x != y]
    return to


def _at_once(edges: DataFrame) -> DataFrame:
    """``node, component`` (staged) of at most ``AT_ONCE`` edges, in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        a, b = (pa.concat_arrays([x.column(k) for x in got]) for k in (0, 1))
        names = pc.unique(pa.concat_arrays([a, b]))
        names = names.take(pc.array_sort_indices(names))
        x, y = (pc.index_in(ends, value_set=names).to_numpy() for ends in (a, b))
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(least_reachable(x, y, len(names))))], names=["node", "component"])

    return staged(edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"))


def _followed(known: DataFrame, point: DataFrame) -> DataFrame:
    """``known`` (staged) with its components replaced by what ``point`` says of them."""
    step = point.select(F.col("node").alias("component"), F.col("component").alias("next"))
    out = staged(spread_join(known, step, "component").select("node", F.coalesce("next", "component").alias("component")))
    drop_staged(known), drop_staged(point)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the least node reachable) of every node of ``edges``.

    Each round points every node at its least neighbour or itself, follows the pointers twice, and
    contracts the edges; staged tables end the lineage of every round. Chains at least halve a
    round, stars vanish at once. The centre of a star may be a third of all rows: its rows are joined
    where they lie (:func:`._frames.spread_join`). As soon as no more than ``AT_ONCE`` edges are left, one
    task contracts them: rounds of many small jobs would cost more than the edges, the driver's memory
    too. Nothing but the number of edges returns to the driver.
    """
    edges = staged(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") < F.col("b")).distinct())
    known: DataFrame | None = None
    while (left := edges.count()) > AT_ONCE:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        point = staged(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("to")))
        for _ in range(2):
            ahead = point.select(F.col("node").alias("to"), F.col("to").alias("ahead"))
            old, point = point, staged(spread_join(point, ahead, "to").select("node", F.coalesce("ahead", "to").alias("to")))
            drop_staged(old)
        left, right = point.select(F.col("node").alias("a"), F.col("to").alias("x")), point.select(F.col("node").alias("b"), F.col("to").alias("y"))
        half = staged(spread_join(edges, left, "a").select("b", "x"))
        met = spread_join(half, right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where(F.col("a") < F.col("b")).distinct()
        old, edges = edges, staged(met)
        drop_staged(old), drop_staged(half)
        point = point.withColumnRenamed("to", "component")
        known = point if known is None else _followed(known, point)
    if left:
        point = _at_once(edges)
        drop_staged(edges)
        known = point if known is None else _followed(known, point)
    if known is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return known
