"""dm-dt maps: counts or smeared mass of all ordered pairs of a series on a grid of time and value steps.

Pairs of an object are generated from its series, within the grid's time range only, and counted
before any row leaves the task; a map travels as its non-empty cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import erf, erf_approximate


@dataclass(frozen=True)
class Grid:
    """Cells [edge, next edge); ``kind`` is linear, log or array, found by ``of`` if it isn't given."""

    edges: tuple[float, ...]
    kind: str

    @classmethod
    def of(cls, edges: Sequence[float], kind: str = "auto") -> Grid:
        x = np.asarray(edges, float)
        if len(x) < 2 or not np.all(np.diff(x) > 0):
            raise ValueError("edges must be ascending, two at least")
        if kind not in ("auto", "linear", "log", "asis"):
            raise ValueError("kind is auto, linear, log or asis")
        close = lambda v: np.allclose(np.diff(v), np.diff(v)[0], rtol=1000 * np.finfo(float).eps * len(v), atol=0)
        if kind == "auto":
            kind = "linear" if close(x) else "log" if x[0] > 0 and close(np.log10(x)) else "asis"
        return cls(tuple(x.tolist()), kind)

    @property
    def cells(self) -> int:
        return len(self.edges) - 1

    def index(self, x: Column) -> Column:
        """Cell number of a value, null outside the grid."""
        lo, hi = self.edges[0], self.edges[-1]
        if self.kind == "asis":
            k = F.size(F.filter(F.array(*[F.lit(e) for e in self.edges]), lambda e: e <= x)) - 1
        elif self.kind == "linear":
            k = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / self.cells))
        else:
            k = F.floor((F.log10(x) - F.lit(math.log10(lo))) / F.lit((math.log10(hi) - math.log10(lo)) / self.cells))
        return F.when((x >= F.lit(lo)) & (x < F.lit(hi)), F.least(F.greatest(k, F.lit(0)), F.lit(self.cells - 1)).cast("int"))


@dataclass(frozen=True)
class DmDt:
    """``norm`` may hold ``dt`` (share of the pairs of a time cell) and ``max`` (after it)."""

    dt: Grid
    dm: Grid
    norm: tuple[str, ...] = field(default=())
    approx_erf: bool = False

    def __post_init__(self):
        if set(self.norm) - {"dt", "max"}:
            raise ValueError("norm holds dt, max")

    @classmethod
    def of(cls, dt: Sequence[float], dm: Sequence[float], *, dt_type: str = "auto", dm_type: str = "auto", norm: Sequence[str] = (), approx_erf: bool = False) -> DmDt:
        return cls(Grid.of(dt, dt_type), Grid.of(dm, dm_type), tuple(norm), approx_erf)

    @classmethod
    def from_borders(cls, min_lgdt: float, max_lgdt: float, max_abs_dm: float, lgdt_size: int, dm_size: int, **how) -> DmDt:
        """Logarithmic time steps, symmetric linear value steps."""
        return cls.of(np.logspace(min_lgdt, max_lgdt, lgdt_size + 1), np.linspace(-max_abs_dm, max_abs_dm, dm_size + 1), dt_type="log", dm_type="linear", **how)

    @property
    def shape(self) -> tuple[int, int]:
        return self.dt.cells, self.dm.cells

    def _pairs(self, df: DataFrame) -> DataFrame:
        """``object_id, i, j``: cells of all pairs in the time range; ``j`` is null outside the value range."""
        series = df.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("t", "m"))).alias("s"))
        one = series.select("object_id", "s", F.posexplode("s").alias("k", "a"))
        later = one.select("object_id", "a", F.explode(F.slice("s", F.col("k") + 2, F.size("s"))).alias("b"))
        step = later.select("object_id", (F.col("b.t") - F.col("a.t")).alias("dt"), (F.col("b.m") - F.col("a.m")).alias("dm"))
        return step.select("object_id", self.dt.index(F.col("dt")).alias("i"), self.dm.index(F.col("dm")).alias("j")).where("i is not null")

    def count_dt(self, df: DataFrame) -> DataFrame:
        """``object_id, i, n``: pairs by time cell, whatever their value step."""
        return self._pairs(df).groupBy("object_id", "i").agg(F.count(F.lit(1)).alias("n"))

    def points(self, df: DataFrame) -> DataFrame:
        """``object_id, i, j, v`` of the cells that hold a pair."""
        cells = self._pairs(df).groupBy("object_id", "i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))
        return self._normed(cells)

    def _normed(self, cells: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        if "dt" in self.norm:
            cells = cells.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("object_id", "i")))
        cells = cells.where("j is not null")
        if "max" in self.norm:
            cells = cells.withColumn("v", F.col("v") / F.nullif(F.max("v").over(Window.partitionBy("object_id")), F.lit(0.0)))
        return cells

    def gausses(self, df: DataFrame) -> DataFrame:
        """``object_id, map``: every pair's unit of mass spread over value cells by its error (sigma, squared here); rows by time cell."""
        series = df.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("t", "m", "sigma"))).alias("s"))
        arrays = series.select("object_id", *[F.col(f"s.{c}").alias(c) for c in ("t", "m", "sigma")])
        kind = df.schema["object_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                maps = [self.gauss_map(*(np.asarray(x, float) for x in row)).ravel() for row in zip(*(batch.column(c).to_pylist() for c in ("t", "m", "sigma")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("object_id"), pa.array([m.reshape(self.shape).tolist() for m in maps], pa.list_(pa.list_(pa.float64())))], names=["object_id", "map"])

        return arrays.mapInArrow(run, f"object_id {kind}, map array<array<double>>")

    def gauss_map(self, t: np.ndarray, m: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        edges_t, edges_m = np.array(self.dt.edges), np.array(self.dm.edges)
        out, counts = np.zeros(self.shape), np.zeros(self.shape[0])
        phi = erf_approximate if self.approx_erf else erf
        for k in range(len(t) - 1):
            i = np.searchsorted(edges_t, t[k + 1 :] - t[k], "right") - 1
            ok = (i >= 0) & (i < self.shape[0])
            if not ok.any():
                continue
            i, dm, s = i[ok], (m[k + 1 :] - m[k])[ok], np.sqrt(sigma[k] ** 2 + sigma[k + 1 :] ** 2)[ok]
            np.add.at(counts, i, 1)
            cdf = 0.5 * (1 + phi((edges_m[None, :] - dm[:, None]) / (math.sqrt(2) * s[:, None])))
            np.add.at(out, i, np.diff(cdf, axis=1))
        if "dt" in self.norm:
            out /= np.maximum(counts, 1)[:, None]
        if "max" in self.norm and out.max() != 0:
            out /= out.max()
        return out

    def packed(self, cells: DataFrame) -> DataFrame:
        """``object_id, map``: the cells of each object as rows by time cell."""
        of = cells.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i") * self.shape[1] + F.col("j"), "v"))).alias("c"))
        n, m = self.shape
        rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.coalesce(F.try_element_at("c", i * m + j), F.lit(0.0))))
        return of.select("object_id", rows.alias("map"))

    def batches(self, df: DataFrame, size: int, seed: int = 0, drop: float | int = 0, shuffle: bool = True) -> Iterator[list]:
        """Batches of (object_id, map) in an order drawn by ``seed``, each object without ``drop`` observations (a count, or a share below 1)."""
        from pyspark.sql import Window

        if drop:
            place = F.row_number().over(Window.partitionBy("object_id").orderBy(F.xxhash64(F.lit(seed), "object_id", "t")))
            n = F.count(F.lit(1)).over(Window.partitionBy("object_id"))
            df = df.withColumn("__p", place).withColumn("__n", n).where(F.col("__p") > (F.lit(int(drop)) if drop >= 1 else F.floor(F.col("__n") * F.lit(float(drop))))).drop("__p", "__n")
        maps = self.packed(self.points(df))
        if shuffle:
            maps = maps.orderBy(F.xxhash64(F.lit(seed), "object_id"))
        batch = []
        for row in maps.toLocalIterator(prefetchPartitions=True):
            batch.append((row["object_id"], np.array(row["map"])))
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch
