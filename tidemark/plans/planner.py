"""From feature specs to one plan with a single exchange on the object key.

A feature asks its :class:`Draft` for aggregates (hash aggregates with partial sums, by band where
asked), for the sorted series of an object or band, or for a numeric kernel over it. The draft keeps
what is asked for once, however many features share it, and lays it out in tiers: one ``groupBy`` on
the object, columns derived from the aggregates, kernels, the output. The series is only collected
if some feature needs it. Sums over observations that need an aggregate first (deviations from a mean,
steps in time) run in a second pass: the series is exploded where it lies and aggregated again on the
same key, in generated code and without another exchange. Moments of time and value are sums about an
object's means, which a window over that one exchange adds to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import OBSERVATION, finite

ID, SERIES = "object_id", "__series"


class Values:
    """Columns of one observation, null outside a band."""

    def __init__(self, band: str | None):
        keep = (lambda c: c) if band is None else (lambda c: F.when(F.col("band") == band, c))
        self.t, self.m, self.sigma = (keep(F.col(c)) for c in ("t", "m", "sigma"))
        self.w = keep(1 / F.nullif(F.col("sigma") * F.col("sigma"), F.lit(0.0)))
        self.one = keep(F.lit(1))
        self.x, self.y = keep(F.col("t") - F.col("__t0")), keep(F.col("m") - F.col("__m0"))  # about the object's means


class Observation:
    """Columns of an exploded observation: ``t, m, sigma, band`` and the steps ``dt, dm`` from the one before."""

    def __getitem__(self, name: str) -> Column:
        if name in ("dt", "dm"):
            return F.col("__now")[name[1]] - F.col("__before")[name[1]]
        return F.col("__now")[name]


class Draft:
    """What the features of one extraction need, each thing once."""

    def __init__(self):
        self.aggregates: dict[str, Column] = {}
        self.tiers: list[dict[str, Column]] = [{} for _ in range(6)]
        self.names: dict[tuple, str] = {}
        self.second: dict[str, Column] = {}
        self.last: dict[str, Column] = {}  # kernels over scalars, after the second pass
        self.needs_second = False  # set by a feature that uses the second pass
        self.centred = False  # set where sums about an object's means are asked for

    def over(self, key: object, make: Callable[[Observation], Column], how: Callable[[Column], Column] = F.sum) -> Column:
        """An aggregate over the observations of an object, in terms of columns that exist by then."""
        self.series()
        self.needs_second = True
        name, known = self._name("second", key)
        if not known:
            self.second[name] = how(make(Observation())).alias(name)
        return F.col(name)

    def moment(self, band: str | None, p: int, q: int, weighted: bool = True) -> Column:
        """Sum of ``w x^p y^q`` with time and value about the object's means, so that large times cost no digits."""
        self.centred = True

        def term(v: Values) -> Column:
            out = v.w if weighted else v.one.cast("double")
            for factor in [v.x] * p + [v.y] * q:
                out = out * factor
            return F.sum(out)

        return self.aggregate(f"moment {p} {q} {weighted}", band, term)

    def _name(self, *key) -> tuple[str, bool]:
        known = key in self.names
        return self.names.setdefault(key, f"__x{len(self.names)}"), known

    def aggregate(self, key: str, band: str | None, make: Callable[[Values], Column]) -> Column:
        name, known = self._name("agg", key, band)
        if not known:
            self.aggregates[name] = make(Values(band)).alias(name)
        return F.col(name)

    def derive(self, key: object, band: str | None, make: Callable[[], Column], tier: int = 1) -> Column:
        name, known = self._name("tier", key, band)
        if not known:
            self.tiers[tier][name] = make()
        return F.col(name)

    def n(self, band: str | None = None) -> Column:
        return self.aggregate("n", band, lambda v: F.count(v.one).cast("double"))

    def mean(self, band: str | None = None) -> Column:
        return self.aggregate("mean", band, lambda v: F.avg(v.m))

    def deviation(self, band: str | None = None) -> Column:
        return self.aggregate("std", band, lambda v: F.stddev_samp(v.m))

    def variance(self, band: str | None = None) -> Column:
        return self.aggregate("var", band, lambda v: F.var_samp(v.m))

    def least(self, band: str | None = None) -> Column:
        return self.aggregate("min", band, lambda v: F.min(v.m))

    def most(self, band: str | None = None) -> Column:
        return self.aggregate("max", band, lambda v: F.max(v.m))

    def median(self, band: str | None = None) -> Column:
        return self.aggregate("median", band, lambda v: F.median(v.m))

    def weight(self, band: str | None = None) -> Column:
        return self.aggregate("sum w", band, lambda v: F.sum(v.w))

    def weighted_mean(self, band: str | None = None) -> Column:
        swm = self.aggregate("sum wm", band, lambda v: F.sum(v.w * v.m))
        return swm / F.nullif(self.weight(band), F.lit(0.0))

    def series(self, band: str | None = None) -> Column:
        """Observations in order of time."""
        name, known = self._name("series", None)
        if not known:
            self.aggregates[name] = F.array_sort(F.collect_list(F.struct("t", "m", "sigma", "band"))).alias(name)
        whole = F.col(name)
        return whole if band is None else self.derive("series", band, lambda: F.filter(whole, lambda x: x["band"] == band), 0)

    def ordered(self, band: str | None = None) -> Column:
        """Sorted magnitudes."""
        series = self.series(band)
        return self.derive("ordered", band, lambda: F.array_sort(F.transform(series, lambda x: x["m"])))


def flattened(features: Sequence) -> Iterator:
    for f in features:
        yield from flattened(f.features) if type(f).__name__ == "Extractor" else (f,)


def extract(df: DataFrame, features: Sequence, fill: float | None = None, strict: bool = False, keys: Sequence[str] = (ID,)) -> DataFrame:
    """A row per object of a long table (``object_id, t, m, sigma, band``) with a column per feature name.

    A feature that isn't defined - too few observations, a zero denominator, a non-finite value - is
    null or ``fill``, band by band; ``strict`` raises instead. An empty table gives an empty one.
    """
    features = list(flattened(features))
    draft = Draft()
    outputs, late = [], set()
    for f in features:
        if not f.separate:
            draft.needs_second = False
            made = list(f.columns(draft))
            outputs += made
            late |= {name for name, _ in made if draft.needs_second}
    apart = [f for f in features if f.separate]
    names = [n for n, _ in outputs] + [n for f in apart for n in f.names()]
    if len(set(names)) < len(names):
        raise ValueError("two features have the same name: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    if not draft.aggregates:
        draft.n()
    if draft.centred:  # a window over the exchange that the aggregates need: it spills, and holds no series
        whole = Window.partitionBy(*keys)
        df = df.withColumns({"__t0": F.avg("t").over(whole), "__m0": F.avg("m").over(whole)})
    out = df.groupBy(*keys).agg(*draft.aggregates.values())
    for tier in draft.tiers:
        if tier:
            out = out.withColumns(tier)
    if draft.second:
        early = {name: f"__o{k}" for k, (name, _) in enumerate(outputs) if name not in late}
        out = out.withColumns({early[name]: value.cast("double") for name, value in outputs if name in early})
        outputs = [(name, F.col(early[name]) if name in early else value) for name, value in outputs]
        series = F.col(draft.names[("series", None)])
        rest = [c for c, kind in out.dtypes if c not in keys and not kind.startswith("array")]
        before = F.concat(F.array(F.lit(None).cast(OBSERVATION)), F.slice(series, 1, F.greatest(F.size(series) - 1, F.lit(0))))
        pairs = F.zip_with(series, before, lambda now, was: F.struct(now.alias("now"), was.alias("before")))
        rows = out.select(*keys, *rest, F.explode(pairs).alias("__pair")).select(*keys, *rest, F.col("__pair.now").alias("__now"), F.col("__pair.before").alias("__before"))
        out = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], *draft.second.values())
        for name, value in draft.last.items():
            out = out.withColumn(name, value)
    for f in apart:  # their own aggregates, on the same key
        out = out.join(f.frame(df, keys), list(keys), "left")
        outputs += [(n, F.col(f"`{n}`")) for n in f.names()]
    order = {n: k for k, n in enumerate(n for f in features for n in f.names())}
    done = []
    for name, value in sorted(outputs, key=lambda x: order[x[0]]):
        value = finite(value.cast("double"))
        if strict:
            value = F.coalesce(value, F.raise_error(F.lit(f"{name} is not defined for an object")).cast("double"))
        elif fill is not None:
            value = F.coalesce(value, F.lit(float(fill)))
        done.append(value.alias(name))
    return out.select(*keys, *done)


def extract_array(df: DataFrame, features: Sequence, name: str = "features", **how) -> DataFrame:
    """Like :func:`extract`, with all values in one ``array<double>``."""
    wide = extract(df, features, **how)
    keys = list(how.get("keys", (ID,)))
    return wide.select(*keys, F.array(*[F.col(f"`{c}`") for c in wide.columns if c not in keys]).alias(name))
