"""Feature specs: what each needs from a draft and how its values follow.

Every feature takes ``bands`` (one set of values per band, names suffixed, in the given order) and
``transform`` (see :mod:`..functions.transforms`). Definitions follow the survey of the catalogue;
where the literature leaves a choice it is stated in the docstring.
"""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.expressions import count_where, div, hazen, largest, middle, smallest, steps, total
from ..functions.transforms import TRANSFORMS, resolve
from ..plans.planner import Draft

REGISTRY: dict[str, type] = {}


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


@dataclass(frozen=True, kw_only=True)
class Feature:
    """Base: subclasses give ``values`` for one band and, if there are several values, ``outputs``."""

    bands: tuple[str, ...] | None = None
    transform: str | bool | None = None

    min_n = 1
    default = "identity"
    separate = False  # True: ``frame`` makes a table of its own, joined on the object

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        REGISTRY[cls.__name__] = cls

    def __post_init__(self):
        if self.bands is not None:
            object.__setattr__(self, "bands", tuple(str(b) for b in self.bands))
            if not self.bands or len(set(self.bands)) < len(self.bands):
                raise ValueError("bands must be unique and at least one")
        resolve(self.transform, self.default)

    def outputs(self) -> tuple[str, ...]:
        return (snake(type(self).__name__),)

    def values(self, draft: Draft, band: str | None) -> tuple[Column, ...]:
        raise NotImplementedError

    def names(self) -> list[str]:
        return [f"{n}_{b}" if b is not None else n for b in (self.bands or (None,)) for n in self.outputs()]

    @property
    def size(self) -> int:
        return len(self.names())

    def columns(self, draft: Draft) -> Iterator[tuple[str, Column]]:
        apply = TRANSFORMS[resolve(self.transform, self.default) or "identity"]
        for band in self.bands or (None,):
            enough = draft.n(band) >= self.min_n
            for name, value in zip(self.outputs(), self.values(draft, band), strict=True):
                yield (f"{name}_{band}" if band is not None else name), F.when(enough, apply(value))

    def to_dict(self) -> dict:
        own = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
        pack = lambda v: v.to_dict() if isinstance(v, Feature) else [pack(x) for x in v] if isinstance(v, (tuple, list)) else v
        return {"feature": type(self).__name__} | {k: pack(v) for k, v in own.items()}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


def from_dict(spec: dict) -> Feature:
    unpack = lambda v: from_dict(v) if isinstance(v, dict) and "feature" in v else tuple(unpack(x) for x in v) if isinstance(v, list) else v
    if spec.get("feature") not in REGISTRY:
        raise ValueError(f"unknown feature {spec.get('feature')!r}")
    return REGISTRY[spec["feature"]](**{k: unpack(v) for k, v in spec.items() if k != "feature"})


def from_json(text: str) -> Feature:
    """The feature that ``to_json`` described."""
    return from_dict(json.loads(text))


def _quantile(q: float, name: str, top: float = 0.5) -> None:
    if not 0 <= q < top:
        raise ValueError(f"{name} must be in [0, {top})")


class Amplitude(Feature):
    """Half of the range."""

    def values(self, d, b):
        return ((d.most(b) - d.least(b)) / 2,)


class Mean(Feature):
    def values(self, d, b):
        return (d.mean(b),)


class Median(Feature):
    def values(self, d, b):
        return (d.median(b),)


class StandardDeviation(Feature):
    min_n = 2

    def values(self, d, b):
        return (d.deviation(b),)


class MeanVariance(Feature):
    """Standard deviation over mean."""

    min_n = 2

    def values(self, d, b):
        return (div(d.deviation(b), d.mean(b)),)


class Skew(Feature):
    """Bias-corrected."""

    min_n, default = 3, "arcsinh"

    def values(self, d, b):
        n = d.n(b)
        g = d.aggregate("skewness", b, lambda v: F.skewness(v.m))
        return (F.when(n > 2, F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))) * div(g, n - 2)),)


class Kurtosis(Feature):
    """Bias-corrected excess."""

    min_n, default = 4, "arcsinh"

    def values(self, d, b):
        n = d.n(b)
        g = d.aggregate("kurtosis", b, lambda v: F.kurtosis(v.m))
        return (div(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6),)


class WeightedMean(Feature):
    def values(self, d, b):
        return (d.weighted_mean(b),)


def _total(d: Draft, b: str | None, key: object, term) -> Column:
    """Sum of a term of each observation: in the second pass for whole series, over the band's array else."""
    return d.over(key, term) if b is None else total(d.series(b), term)


def _count(d: Draft, b: str | None, key: object, condition) -> Column:
    return d.over(key, lambda x: F.when(condition(x), 1.0).otherwise(0.0)) if b is None else count_where(d.series(b), condition)


def _chi2(d: Draft, b: str | None) -> Column:
    mean = d.weighted_mean(b)
    term = lambda x: div((x["m"] - mean) * (x["m"] - mean), x["sigma"] * x["sigma"])
    if b is None:
        return d.over("chi2", term)
    series = d.series(b)
    return d.derive("chi2", b, lambda: total(series, lambda x: div((x["m"] - mean) * (x["m"] - mean), x["sigma"] * x["sigma"])))


class ReducedChi2(Feature):
    min_n, default = 2, "ln1p"

    def values(self, d, b):
        return (div(_chi2(d, b), d.n(b) - 1),)


class Chi2Pvar(Feature):
    """Probability of variability: the chi-square distribution function with n-1 degrees of freedom."""

    min_n = 2

    def values(self, d, b):
        chi2 = _chi2(d, b)
        if b is not None:
            return (d.derive("chi2 cdf", b, lambda: kernels.chi2_cdf(chi2, d.n(b) - 1), 2),)
        d.last["__chi2_cdf"] = kernels.chi2_cdf(chi2, d.n(b) - 1)
        return (F.col("__chi2_cdf"),)


class ExcessVariance(Feature):
    min_n = 2

    def values(self, d, b):
        noise = d.aggregate("mean s2", b, lambda v: F.avg(v.sigma * v.sigma))
        return (div(d.variance(b) - noise, d.mean(b) * d.mean(b)),)


class StetsonK(Feature):
    min_n = 2

    def values(self, d, b):
        mean = d.weighted_mean(b)
        delta = lambda x: div(x["m"] - mean, x["sigma"])
        return (div(_total(d, b, "abs delta", lambda x: F.abs(delta(x))), F.sqrt(d.n(b) * _total(d, b, "delta2", lambda x: delta(x) * delta(x)))),)


@dataclass(frozen=True, kw_only=True)
class BeyondNStd(Feature):
    nstd: float = 1.0
    min_n = 2

    def outputs(self):
        return (f"beyond_{self.nstd:g}_std",)

    def values(self, d, b):
        mean, std = d.mean(b), d.deviation(b)
        return (div(_count(d, b, ("beyond", self.nstd), lambda x: F.abs(x["m"] - mean) > F.lit(self.nstd) * std), d.n(b)),)


@dataclass(frozen=True, kw_only=True)
class InterPercentileRange(Feature):
    quantile: float = 0.25

    def __post_init__(self):
        super().__post_init__()
        _quantile(self.quantile, "quantile")

    def outputs(self):
        return (f"inter_percentile_range_{100 * self.quantile:g}",)

    def values(self, d, b):
        x = d.ordered(b)
        return (hazen(x, 1 - self.quantile) - hazen(x, self.quantile),)


@dataclass(frozen=True, kw_only=True)
class MagnitudePercentageRatio(Feature):
    quantile_numerator: float = 0.4
    quantile_denominator: float = 0.05

    def __post_init__(self):
        super().__post_init__()
        _quantile(self.quantile_numerator, "quantile_numerator"), _quantile(self.quantile_denominator, "quantile_denominator")

    def outputs(self):
        return (f"magnitude_percentage_ratio_{100 * self.quantile_numerator:g}_{100 * self.quantile_denominator:g}",)

    def values(self, d, b):
        x = d.ordered(b)
        span = lambda q: hazen(x, 1 - q) - hazen(x, q)
        return (div(span(self.quantile_numerator), span(self.quantile_denominator)),)


@dataclass(frozen=True, kw_only=True)
class PercentDifferenceMagnitudePercentile(Feature):
    quantile: float = 0.25
    default = "clipped_lg"

    def __post_init__(self):
        super().__post_init__()
        _quantile(self.quantile, "quantile")

    def outputs(self):
        return (f"percent_difference_magnitude_percentile_{100 * self.quantile:g}",)

    def values(self, d, b):
        x = d.ordered(b)
        return (div(hazen(x, 1 - self.quantile) - hazen(x, self.quantile), d.median(b)),)


class PercentAmplitude(Feature):
    def values(self, d, b):
        return (F.greatest(d.most(b) - d.median(b), d.median(b) - d.least(b)),)


def _mad(d: Draft, b: str | None) -> Column:
    series, median = d.series(b), d.median(b)
    return d.derive("mad", b, lambda: middle(F.array_sort(F.transform(series, lambda x: F.abs(x["m"] - median)))))


class MedianAbsoluteDeviation(Feature):
    def values(self, d, b):
        return (_mad(d, b),)


@dataclass(frozen=True, kw_only=True)
class MedianBufferRangePercentage(Feature):
    quantile: float = 0.1

    def outputs(self):
        return (f"median_buffer_range_percentage_{100 * self.quantile:g}",)

    def values(self, d, b):
        median, half = d.median(b), F.lit(self.quantile) * (d.most(b) - d.least(b)) / 2
        return (div(_count(d, b, ("buffer", self.quantile), lambda x: F.abs(median - x["m"]) < half), d.n(b)),)


class Roms(Feature):
    min_n = 2

    def values(self, d, b):
        median = d.median(b)
        return (div(_total(d, b, "roms", lambda x: div(F.abs(x["m"] - median), x["sigma"])), d.n(b) - 1),)


@dataclass(frozen=True, kw_only=True)
class PeakToPeakVar(Feature):
    """Not defined where a value is negative."""

    nstd: float = 1.0
    min_n = 2

    def values(self, d, b):
        a = d.aggregate(f"max m-{self.nstd}s", b, lambda v: F.max(v.m - F.lit(self.nstd) * v.sigma))
        c = d.aggregate(f"min m+{self.nstd}s", b, lambda v: F.min(v.m + F.lit(self.nstd) * v.sigma))
        return (F.when(d.least(b) >= 0, div(a - c, a + c)),)


class AndersonDarlingNormal(Feature):
    min_n, default = 4, "lg"

    def values(self, d, b):
        series = d.series(b)
        return (d.derive("anderson darling", b, lambda: kernels.anderson_darling(F.transform(series, lambda x: x["m"])), 2),)


@dataclass(frozen=True, kw_only=True)
class BiweightScale(Feature):
    """Tukey's biweight scale with tuning constant ``c``."""

    c: float = 9.0
    min_n = 2

    def __post_init__(self):
        super().__post_init__()
        if not 0 < self.c < float("inf"):
            raise ValueError("c must be positive and finite")

    def outputs(self):
        return (f"biweight_scale_{self.c:g}",)

    def values(self, d, b):
        series, median, mad = d.series(b), d.median(b), _mad(d, b)
        u2 = lambda x: div((x["m"] - median) * (x["m"] - median), F.lit(self.c * self.c) * mad * mad)
        over = lambda x: (x["m"] - median) * (x["m"] - median) * (1 - u2(x)) * (1 - u2(x)) * (1 - u2(x)) * (1 - u2(x))
        under = lambda x: (1 - u2(x)) * (1 - 5 * u2(x))
        if b is None:
            top = d.over(("biweight top", self.c), lambda x: F.when(u2(x) < 1, over(x)))
            bottom = d.over(("biweight bottom", self.c), lambda x: F.when(u2(x) < 1, under(x)))
        else:
            inner = d.derive(("biweight inner", self.c), b, lambda: F.filter(series, lambda x: u2(x) < 1), 2)
            top, bottom = total(inner, over), total(inner, under)
        return (F.when(mad > 0, div(F.sqrt(d.n(b) * top), F.abs(bottom))).otherwise(F.lit(0.0)),)


class QnScale(Feature):
    """Rousseeuw and Croux: 2.2219 times the k-th least pairwise difference, k = C(n//2 + 1, 2)."""

    min_n = 2

    def values(self, d, b):
        x = d.ordered(b)
        return (d.derive("qn", b, lambda: kernels.qn_scale(x), 2),)


def _otsu(d: Draft, b: str | None) -> Column:
    """``struct`` of the best split of the sorted values: first of equal inter-class variances."""
    x = d.ordered(b)
    n = d.n(b)

    # columns of their own: inside a lambda they would be summed again for every element
    whole = d.derive("sum of ordered", b, lambda: total(x, lambda v: v), 2)

    def make() -> Column:
        start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"), F.lit(0).alias("at"))

        def step(a: Column, v: Column) -> Column:
            k, s = a["k"] + 1, a["s"] + v
            gap = div(s, k.cast("double")) - div(whole - s, n - k)
            var = div(k.cast("double"), n) * (1 - div(k.cast("double"), n)) * gap * gap
            better = (k < n) & (var > a["best"])
            return F.struct(k.alias("k"), s.alias("s"), F.when(better, var).otherwise(a["best"]).alias("best"), F.when(better, k).otherwise(a["at"]).alias("at"))

        return F.aggregate(x, start, step, lambda a: a["at"])

    return d.derive("otsu", b, make, 3)


class OtsuSplit(Feature):
    min_n = 2

    def outputs(self):
        return ("otsu_mean_diff", "otsu_std_lower", "otsu_std_upper", "otsu_lower_to_all_ratio")

    def values(self, d, b):
        x, at, n = d.ordered(b), _otsu(d, b), d.n(b)
        low = d.derive("otsu low", b, lambda: F.slice(x, 1, F.greatest(at, F.lit(0))), 4)
        high = d.derive("otsu high", b, lambda: F.slice(x, F.greatest(at, F.lit(0)) + 1, F.size(x)), 4)
        mean = lambda s: div(total(s, lambda v: v), F.size(s).cast("double"))
        mean_low = d.derive("otsu mean low", b, lambda: mean(low), 5)
        mean_high = d.derive("otsu mean high", b, lambda: mean(high), 5)

        def std(s: Column, centre: Column) -> Column:
            return F.when(F.size(s) == 1, F.lit(0.0)).otherwise(F.sqrt(div(total(s, lambda v: (v - centre) * (v - centre)), F.size(s).cast("double") - 1)))

        return (mean_high - mean_low, std(low, mean_low), std(high, mean_high), div(at.cast("double"), n))


class OtsuThreshold(Feature):
    """The least value of the upper part of Otsu's split."""

    min_n = 2

    def values(self, d, b):
        return (F.try_element_at(d.ordered(b), F.greatest(_otsu(d, b), F.lit(0)) + 1),)


class LinearFit(Feature):
    """Weighted least squares: slope, its error, reduced chi-square with n-2 degrees of freedom."""

    min_n = 3

    def outputs(self):
        return ("linear_fit_slope", "linear_fit_slope_sigma", "linear_fit_reduced_chi2")

    def values(self, d, b):
        s0, sx, sy = d.moment(b, 0, 0), d.moment(b, 1, 0), d.moment(b, 0, 1)
        sxx = d.derive("lf sxx", b, lambda: d.moment(b, 2, 0) - div(sx * sx, s0))
        sxy = d.derive("lf sxy", b, lambda: d.moment(b, 1, 1) - div(sx * sy, s0))
        syy = d.moment(b, 0, 2) - div(sy * sy, s0)
        chi2 = F.greatest(syy - div(sxy * sxy, sxx), F.lit(0.0))
        return (div(sxy, sxx), F.sqrt(div(F.lit(1.0), sxx)), div(chi2, d.n(b) - 2))


class LinearTrend(Feature):
    """Least squares without errors: slope, its error, and the noise around it."""

    min_n = 3

    def outputs(self):
        return ("linear_trend", "linear_trend_sigma", "linear_trend_noise")

    def values(self, d, b):
        n, sx, sy = d.n(b), d.moment(b, 1, 0, False), d.moment(b, 0, 1, False)
        sxx = d.derive("lt sxx", b, lambda: d.moment(b, 2, 0, False) - div(sx * sx, n))
        sxy = d.derive("lt sxy", b, lambda: d.moment(b, 1, 1, False) - div(sx * sy, n))
        syy = d.moment(b, 0, 2, False) - div(sy * sy, n)
        noise = div(F.greatest(syy - div(sxy * sxy, sxx), F.lit(0.0)), n - 2)
        return (div(sxy, sxx), F.sqrt(div(noise, sxx)), F.sqrt(noise))


class ParabolaFit(Feature):
    """Weighted fit of ``g (t - t0)^2 + m0``: curvature, extremum, reduced chi-square; null without curvature."""

    min_n = 4

    def outputs(self):
        return ("parabola_fit_g", "parabola_fit_m0", "parabola_fit_reduced_chi2")

    def values(self, d, b):
        p = lambda k, y: d.moment(b, k, y)
        s0, y0 = p(0, 0), p(0, 1)
        # moments about the weighted mean of time, where the first one vanishes
        c = d.derive("pf c", b, lambda: div(p(1, 0), s0), 0)
        s2 = d.derive("pf 2", b, lambda: p(2, 0) - s0 * c * c)
        s3 = d.derive("pf 3", b, lambda: p(3, 0) - 3 * c * p(2, 0) + 2 * s0 * c * c * c)
        s4 = d.derive("pf 4", b, lambda: p(4, 0) - 4 * c * p(3, 0) + 6 * c * c * p(2, 0) - 3 * s0 * c * c * c * c)
        y1 = d.derive("pf y1", b, lambda: p(1, 1) - c * y0)
        y2 = d.derive("pf y2", b, lambda: p(2, 1) - 2 * c * p(1, 1) + c * c * y0 - div(y0, s0) * s2, 2)
        det = s2 * (s4 * s0 - s2 * s2) - s3 * s3 * s0
        g = d.derive("pf g", b, lambda: div(s0 * (y2 * s2 - y1 * s3), det), 3)
        line = d.derive("pf b", b, lambda: div(y1 - g * s3, s2), 4)
        offset = -div(g * s2, s0)
        chi2 = F.greatest(p(0, 2) - div(y0 * y0, s0) - line * y1 - g * y2, F.lit(0.0))
        curved = F.abs(g) > F.lit(1e-12)
        return (F.when(curved, g), F.when(curved, d.weighted_mean(b) + offset - div(line * line, 4 * g)), F.when(curved, div(chi2, d.n(b) - 3)))


class Duration(Feature):
    def values(self, d, b):
        return (d.aggregate("max t", b, lambda v: F.max(v.t)) - d.aggregate("min t", b, lambda v: F.min(v.t)),)


class ObservationCount(Feature):
    def values(self, d, b):
        return (d.n(b),)


class TimeMean(Feature):
    def values(self, d, b):
        return (d.aggregate("mean t", b, lambda v: F.avg(v.t)),)


class TimeStandardDeviation(Feature):
    min_n = 2

    def values(self, d, b):
        return (d.aggregate("std t", b, lambda v: F.stddev_samp(v.t)),)


def _before_first(d: Draft, b: str | None, key: tuple, detected, limit, fainter, strictly: bool) -> Column:
    """How many observations come before the first detection; null if all or none are detections."""
    s = d.series(b)
    flags = d.derive((*key, "flags"), b, lambda: F.transform(s, lambda x: detected(x)))
    first = d.derive((*key, "first"), b, lambda: F.array_position(flags, True).cast("int"), 2)
    known = (first > 0) & F.exists(flags, lambda f: ~f)
    if not strictly:
        return F.when(known, (first - 1).cast("double"))
    value = d.derive((*key, "value"), b, lambda: F.try_element_at(s, F.greatest(first, F.lit(1)))["m"], 3)
    return F.when(known, count_where(F.slice(s, 1, F.greatest(first - 1, F.lit(0))), lambda x: fainter(limit(x), value)))


@dataclass(frozen=True, kw_only=True)
class FluxNNotDetBeforeFd(Feature):
    signal_to_noise: float = 5.0
    strictly_fainter: bool = False
    min_n = 2

    def outputs(self):
        return ("flux_n_non_detections_before_fd",)

    def values(self, d, b):
        snr = F.lit(float(self.signal_to_noise))
        return (_before_first(d, b, ("flux fd", self.signal_to_noise), lambda x: x["m"] > snr * x["sigma"], lambda x: snr * x["sigma"], lambda a, v: a < v, self.strictly_fainter),)


@dataclass(frozen=True, kw_only=True)
class MagnitudeNNotDetBeforeFd(Feature):
    sigma_non_detection: float = float("inf")
    strictly_fainter: bool = False
    min_n = 2

    def outputs(self):
        return ("magn_n_non_detections_before_fd",)

    def values(self, d, b):
        mark = F.lit(float(self.sigma_non_detection))
        return (_before_first(d, b, ("magn fd", self.sigma_non_detection), lambda x: ~x["sigma"].eqNullSafe(mark), lambda x: x["m"], lambda a, v: a > v, self.strictly_fainter),)


def _steps(d: Draft, b: str | None) -> Column:
    s = d.series(b)
    return d.derive("steps", b, lambda: steps(s))


def _step_total(d: Draft, b: str | None, key: object, term) -> Column:
    return d.over(("step", key), term) if b is None else total(_steps(d, b), term)


class Eta(Feature):
    min_n = 2

    def values(self, d, b):
        return (div(_step_total(d, b, "dm2", lambda x: x["dm"] * x["dm"]), (d.n(b) - 1) * d.variance(b)),)


class EtaE(Feature):
    min_n, default = 2, "lg"

    def values(self, d, b):
        span = d.aggregate("max t", b, lambda v: F.max(v.t)) - d.aggregate("min t", b, lambda v: F.min(v.t))
        rate = _step_total(d, b, "rate2", lambda x: F.pow(div(x["dm"], x["dt"]), F.lit(2.0)))
        return (div(rate * span * span, F.pow(d.n(b) - 1, F.lit(3.0)) * d.variance(b)),)


class Cusum(Feature):
    min_n = 2

    def values(self, d, b):
        mean, series = d.mean(b), d.series(b)
        start = F.struct(F.lit(0.0).alias("s"), F.lit(float("inf")).alias("lo"), F.lit(float("-inf")).alias("hi"))

        def step(a: Column, x: Column) -> Column:
            s = a["s"] + (x["m"] - mean)
            return F.struct(s.alias("s"), F.least(a["lo"], s).alias("lo"), F.greatest(a["hi"], s).alias("hi"))

        span = F.aggregate(series, start, step, lambda a: a["hi"] - a["lo"])
        return (div(span, d.n(b) * d.deviation(b)),)


class MaximumSlope(Feature):
    min_n, default = 2, "clipped_lg"

    def values(self, d, b):
        slope = lambda x: F.abs(div(x["dm"], x["dt"]))
        if b is None:
            return (F.when(~F.coalesce(d.over("any dt 0", lambda x: x["dt"] == 0, F.bool_or), F.lit(False)), d.over("max slope", slope, F.max)),)
        s = _steps(d, b)
        return (F.when(F.forall(s, lambda x: x["dt"] != 0), largest(s, slope)),)


class LaflerKinmanStringLength(Feature):
    """With the step from the last observation to the first, so that noise gives about 1."""

    min_n = 2

    def values(self, d, b):
        s, n = d.series(b), d.n(b)
        wrap = d.derive("wrap", b, lambda: F.try_element_at(s, F.lit(1))["m"] - F.try_element_at(s, F.lit(-1))["m"])
        return (div(_step_total(d, b, "dm2", lambda x: x["dm"] * x["dm"]) + wrap * wrap, 2 * n * d.variance(b)),)


class MaximumTimeInterval(Feature):
    min_n = 2

    def values(self, d, b):
        return (d.over("max dt", lambda x: x["dt"], F.max) if b is None else largest(_steps(d, b), lambda x: x["dt"]),)


class MinimumTimeInterval(Feature):
    min_n = 2

    def values(self, d, b):
        return (d.over("min dt", lambda x: x["dt"], F.min) if b is None else smallest(_steps(d, b), lambda x: x["dt"]),)


class _Colour(Feature):
    """Difference of an aggregate between two bands; not defined where one is missing."""

    word = ""

    def __post_init__(self):
        super().__post_init__()
        if self.bands is None or len(self.bands) != 2:
            raise ValueError("a colour takes exactly two bands")
        if self.transform not in (None, False):
            raise ValueError("a colour takes no transform")

    def names(self):
        return [f"color_{self.word}_{self.bands[0]}_{self.bands[1]}"]

    def columns(self, draft):
        a, b = (self.part(draft, x) for x in self.bands)
        yield self.names()[0], a - b


class ColorOfMaximum(_Colour):
    word = "max"

    def part(self, d, b):
        return d.most(b)


class ColorOfMedian(_Colour):
    word = "median"

    def part(self, d, b):
        return d.median(b)


class ColorOfMinimum(_Colour):
    word = "min"

    def part(self, d, b):
        return d.least(b)


class ColorSpread(Feature):
    """Population deviation of the bands' weighted means; not defined where a band is missing."""

    def __post_init__(self):
        super().__post_init__()
        if self.bands is None or len(self.bands) < 2:
            raise ValueError("a colour spread takes two bands or more")
        if self.transform not in (None, False):
            raise ValueError("a colour takes no transform")

    def names(self):
        return ["color_spread_" + "_".join(self.bands)]

    def columns(self, draft):
        means = [draft.weighted_mean(b) for b in self.bands]
        centre = sum(means[1:], means[0]) / len(means)
        square = [(x - centre) * (x - centre) for x in means]
        yield self.names()[0], F.sqrt(sum(square[1:], square[0]) / len(means))


@dataclass(frozen=True, kw_only=True)
class Extractor(Feature):
    """All values of several features, single-band and multi-band mixed as they come."""

    features: tuple[Feature, ...] = ()

    def __post_init__(self):
        if self.bands is not None or self.transform not in (None, False):
            raise ValueError("bands and transform belong to the features of an extractor")
        if not self.features:
            raise ValueError("an extractor needs a feature")

    def names(self):
        return [n for f in self.features for n in f.names()]

    def columns(self, draft):
        for f in self.features:
            yield from f.columns(draft)
