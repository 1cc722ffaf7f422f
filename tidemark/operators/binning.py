"""Meta-features over derived series: time bins and bootstrap resamples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.planner import ID, extract
from .features import Feature


def binned(df: DataFrame, window: float, offset: float = 0.0, by_band: bool = False, keys: Sequence[str] = (ID,)) -> DataFrame:
    """Observations averaged in bins ``floor((t - offset) / window)`` of an object (and band).

    A bin stands at its centre with the weighted mean and the error ``sqrt(n / sum of weights)``.
    Partial sums are made before the shuffle, so a crowded object or bin doesn't burden one task.
    """
    if not window > 0:
        raise ValueError("window must be positive")
    w = 1 / F.nullif(F.col("sigma") * F.col("sigma"), F.lit(0.0))
    k = F.floor((F.col("t") - F.lit(float(offset))) / F.lit(float(window)))
    by = [*keys, "band"] if by_band else list(keys)
    out = df.withColumn("__bin", k).groupBy(*by, "__bin").agg(F.sum(w).alias("sw"), F.sum(w * F.col("m")).alias("swm"), F.count(F.lit(1)).cast("double").alias("n"))
    band = F.col("band") if by_band else F.lit(None).cast("string").alias("band")
    return out.select(*keys, ((F.col("__bin") + F.lit(0.5)) * F.lit(float(window)) + F.lit(float(offset))).alias("t"), (F.col("swm") / F.col("sw")).alias("m"), F.sqrt(F.col("n") / F.col("sw")).alias("sigma"), band)


@dataclass(frozen=True, kw_only=True)
class Bins(Feature):
    """Features of the binned series; names get a prefix with window and offset."""

    features: tuple[Feature, ...] = ()
    window: float = 1.0
    offset: float = 0.0

    separate = True

    def __post_init__(self):
        super().__post_init__()
        if not self.features or not self.window > 0:
            raise ValueError("bins need features and a positive window")

    def _inner(self) -> list[Feature]:
        from dataclasses import replace

        return [replace(f, bands=self.bands) if self.bands and f.bands is None else f for f in self.features]

    def names(self):
        return [f"bins_window{self.window:.1f}_offset{self.offset:.1f}_{n}" for f in self._inner() for n in f.names()]

    def frame(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        inner = self._inner()
        out = extract(binned(df, self.window, self.offset, any(f.bands for f in inner), keys), inner, keys=keys)
        return out.toDF(*keys, *self.names())


#: Multiplier and modulus of the generator that draws resamples, alike in Spark and in SQL; squaring breaks its lattice.
FACTOR, MODULUS = 48271, 2147483647


def draws(seed: int, b: Column, n: Column) -> Column:
    """Places in 1..n of resample ``b``, one per observation. Each step is bound by its own ``transform``, not repeated in the next."""
    x = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: (b * 1000003 + i * 7919 + F.lit(seed * 104729 + 12345)) % MODULUS)
    for _ in range(3):
        x = F.transform(x, lambda v: (v * FACTOR + 11) % MODULUS)
        x = F.transform(x, lambda v: (v * v + v) % MODULUS)
    return F.transform(x, lambda v: (v % n + 1).cast("int"))


@dataclass(frozen=True, kw_only=True)
class Bootstrap(Feature):
    """Features with their spread over resamples: n observations of n, with replacement.

    ``stratified`` keeps each band's count; ``rejection`` draws from all bands together and leaves out
    the resamples in which a feature isn't defined, redrawing up to ``max_attempts_factor`` times.
    Features that need order are rejected. Draws depend on seed, resample and place alone.
    """

    features: tuple[Feature, ...] = ()
    n_bootstrap: int = 100
    seed: int = 0
    quantiles: tuple[float, ...] | None = None
    band_strategy: str = "stratified"
    max_attempts_factor: int = 10

    separate = True
    ORDERED = frozenset(("Eta", "EtaE", "Cusum", "MaximumSlope", "LaflerKinmanStringLength", "MaximumTimeInterval", "MinimumTimeInterval", "LinearTrend", "FluxNNotDetBeforeFd", "MagnitudeNNotDetBeforeFd", "Periodogram", "StetsonK"))

    def __post_init__(self):
        super().__post_init__()
        if not self.features or self.n_bootstrap < 2:
            raise ValueError("a bootstrap needs features and two resamples or more")
        if bad := [type(f).__name__ for f in self.features if type(f).__name__ in self.ORDERED]:
            raise ValueError(f"resamples have no order of time: {', '.join(bad)}")
        if self.quantiles is not None and (not self.quantiles or not all(0 <= q <= 1 for q in self.quantiles)):
            raise ValueError("quantiles must lie in [0, 1], one at least")
        if self.band_strategy not in ("stratified", "rejection"):
            raise ValueError("band_strategy is stratified or rejection")

    def _inner(self) -> list[Feature]:
        from dataclasses import replace

        return [replace(f, bands=self.bands) if self.bands and f.bands is None else f for f in self.features]

    def names(self):
        inner = [n for f in self._inner() for n in f.names()]
        spread = [f"bootstrap_{n}_quantile_{100 * q:g}" for n in inner for q in self.quantiles] if self.quantiles else [f"bootstrap_{n}_sigma" for n in inner]
        return [f"bootstrap_{n}" for n in inner] + spread

    def frame(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        inner = self._inner()
        names = [n for f in inner for n in f.names()]
        strata = [*keys, "band"] if self.bands and self.band_strategy == "stratified" else list(keys)
        source = df.where(F.col("band").isin(*self.bands)) if self.bands else df
        series = source.groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct("t", "m", "sigma", "band"))).alias("s"))
        tries = self.n_bootstrap * (self.max_attempts_factor if self.bands and self.band_strategy == "rejection" else 1)
        drawn = series.withColumn("__b", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(tries).cast("long")))).withColumn("n", F.size("s").cast("long"))
        picked = F.transform(draws(self.seed, F.col("__b"), F.col("n")), lambda k: F.try_element_at(F.col("s"), k))
        rows = drawn.select(*keys, "__b", F.explode(picked).alias("x")).select(*keys, "__b", "x.t", "x.m", "x.sigma", "x.band")
        many = extract(rows, inner, keys=(*keys, "__b"))
        if tries > self.n_bootstrap:  # the first resamples in which all is defined
            from pyspark.sql import Window

            whole = many.dropna(subset=names).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__b")))
            many = whole.where(F.col("__r") <= self.n_bootstrap).drop("__r")
        c = lambda n: F.col(f"`{n}`")
        spread = [F.percentile(c(n), F.lit(float(q))) for n in names for q in self.quantiles] if self.quantiles else [F.stddev_samp(c(n)) for n in names]
        outs = self.names()
        around = many.groupBy(*keys).agg(*[x.alias(n) for x, n in zip(spread, outs[len(names) :], strict=True)])
        value = extract(df, inner, keys=keys).toDF(*keys, *outs[: len(names)])
        return value.join(around, list(keys), "left")
