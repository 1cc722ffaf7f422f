"""Features computed by numpy over a whole series: parametric fits and the periodogram."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import fitting, spectra
from .features import Feature


def over_batches(kernel, series: Column) -> Column:
    """``kernel([(t, m, sigma, band), ...]) -> [list of float or None, ...]`` over the arrays of observations of an Arrow batch together."""

    def run(t: pd.Series, m: pd.Series, sigma: pd.Series, band: pd.Series) -> pd.Series:
        out: list[list[float] | None] = [None] * len(t)
        some = [(i, (np.asarray(a, float), np.asarray(b, float), np.asarray(c, float), np.asarray(d, object))) for i, (a, b, c, d) in enumerate(zip(t, m, sigma, band, strict=True)) if a is not None and len(a)]
        for (i, _), value in zip(some, kernel([s for _, s in some]), strict=True):
            out[i] = None if value is None else [float(v) for v in value]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, ArrayType(DoubleType()))(*[series[c] for c in ("t", "m", "sigma", "band")])


def over_series(kernel, series: Column) -> Column:
    """``kernel(t, m, sigma, band) -> list of float or None`` over each array of observations, Arrow batch by batch."""
    return over_batches(lambda many: [kernel(*s) for s in many], series)


class _Kernel(Feature):
    """Base of features whose values are the items of one kernel's array."""

    def kernel(self, t, m, sigma, band):
        raise NotImplementedError

    def over(self, series: Column) -> Column:
        return over_series(self.kernel, series)

    def values(self, draft, band):
        series = draft.series(band)
        array = draft.derive((type(self).__name__, self), band, lambda: self.over(series), 1)
        return tuple(F.try_element_at(array, F.lit(k + 1)) for k in range(len(self.outputs())))


@dataclass(frozen=True, kw_only=True)
class _Fit(_Kernel):
    """Parameters of a model of flux and reduced chi-square.

    ``transform=True`` turns the amplitude into a magnitude of zero point 8.9, gives the baseline in
    units of it, leaves the reference time out and takes ln(1 + chi-square).

    Every algorithm ends in bounded least squares of at most 20 times as many steps as ``lmsder_niter`` or
    ``ceres_niter`` says; with ``ceres`` in its name, residuals beyond ``ceres_loss_reg`` sigmas count by
    Huber's loss. ``mcmc`` draws ``mcmc_niter`` starting places, ``nuts`` ``nuts_ntune + nuts_niter``.
    """

    algorithm: str = "mcmc-lmsder"
    mcmc_niter: int = 128
    lmsder_niter: int = 10
    ceres_niter: int = 10
    ceres_loss_reg: float | None = None
    nuts_ntune: int = 128
    nuts_niter: int = 128
    init: tuple | None = None
    bounds: tuple | None = None
    ln_prior: object = None

    kind = ""

    def __post_init__(self):
        if self.transform not in (None, False, True):
            raise ValueError("the transform of a fit is on or off")
        if self.transform and self.bands:
            raise ValueError("a fit by band takes no transform")
        super().__post_init__()
        if self.algorithm not in fitting.ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}; there are {', '.join(fitting.ALGORITHMS)}")
        n = len(self.parameters)
        for name in ("init", "bounds"):
            given = getattr(self, name)
            if given is not None and len(given) != n:
                raise ValueError(f"{name} must have {n} items")

    @property
    def parameters(self) -> tuple[str, ...]:
        return fitting.MODELS[self.kind].names

    @property
    def min_n(self):
        return len(self.parameters) + 1

    def outputs(self):
        keep = [p for p in self.parameters if not (self.transform and p == "reference_time")]
        return tuple(f"{self.kind}_fit_{p}" for p in (*keep, "ln1p_reduced_chi2" if self.transform else "reduced_chi2"))

    def priors(self):
        if self.ln_prior in (None, "no"):
            return None
        if self.ln_prior == "hosseinzadeh2020":  # for days; broad, physical time scales of supernovae
            p = fitting
            return (p.none(), p.none(), p.none(), p.uniform(0.01, 50.0), p.uniform(0.01, 300.0), p.uniform(0.0, 1.0), p.mix([(2.0, p.normal(5.0, 5.0)), (1.0, p.normal(60.0, 30.0))]))
        return tuple(self.ln_prior)

    def kernel(self, t, m, sigma, band):
        return self.kernels([(t, m, sigma, band)])[0]

    def kernels(self, many):
        """Values of many series, which are fitted side by side."""
        draws = self.nuts_ntune + self.nuts_niter if "nuts" in self.algorithm else self.mcmc_niter
        ceres = "ceres" in self.algorithm
        steps = 20 * (self.ceres_niter if ceres else self.lmsder_niter)
        fits = fitting.fit_models(self.kind, [s[:3] for s in many], self.algorithm, draws, self.init, self.bounds, self.priors(), steps=steps, loss_reg=self.ceres_loss_reg if ceres else None)
        return [got if got is None or not self.transform else self.transformed(got) for got in fits]

    def over(self, series):
        return over_batches(self.kernels, series)

    def transformed(self, got: Sequence[float]) -> list[float]:
        values = dict(zip((*self.parameters, "chi2"), got, strict=True))
        a = values["amplitude"]
        out = []
        for name in self.parameters:
            if name == "amplitude":
                out.append(8.9 - 2.5 * math.log10(2 * a) if a > 0 else math.nan)
            elif name == "baseline":
                out.append(values[name] / a if a else math.nan)
            elif name != "reference_time":
                out.append(values[name])
        return [*out, math.log1p(values["chi2"])]

    def columns(self, draft):
        for band in self.bands or (None,):
            enough = draft.n(band) >= self.min_n
            for name, value in zip(self.outputs(), self.values(draft, band), strict=True):
                yield (f"{name}_{band}" if band is not None else name), F.when(enough, value)

    @classmethod
    def model(cls, t: Sequence[float], params: Sequence[float]) -> np.ndarray:
        """The curve at times; items of ``params`` after the model's own are passed over."""
        return fitting.MODELS[cls.kind].curve(np.asarray(t, float), params)


@dataclass(frozen=True, kw_only=True)
class BazinFit(_Fit):
    kind = "bazin"


@dataclass(frozen=True, kw_only=True)
class LinexpFit(_Fit):
    kind = "linexp"


@dataclass(frozen=True, kw_only=True)
class VillarFit(_Fit):
    kind = "villar"


@dataclass(frozen=True, kw_only=True)
class Periodogram(_Kernel):
    """Periods and signal to noise of the strongest peaks of the Lomb-Scargle spectrum.

    Frequencies are angular. ``features`` are evaluated on the spectrum (frequency as time, power as
    value), ``phase_features`` on the series folded at the best period, phase 0 at the least value;
    both are numpy kernels named by a feature class. With ``bands`` the power is a mean over bands on
    one grid, weighted by ``count`` or by ``chi2``.
    """

    peaks: int = 1
    resolution: float = 10.0
    max_freq_factor: float = 1.0
    nyquist: str | float = "average"
    freqs: tuple[float, ...] | None = None
    fast: bool = True
    features: tuple[str, ...] = ()
    phase_features: tuple[str, ...] = ()
    normalization: str = "psd"
    multiband_normalization: str = "chi2"

    min_n = 3

    def __post_init__(self):
        super().__post_init__()
        if self.transform not in (None, False):
            raise ValueError("a periodogram takes no transform")
        if self.normalization not in ("psd", "standard", "model", "log") or self.multiband_normalization not in ("count", "chi2"):
            raise ValueError("unknown normalization")
        if self.bands and (self.normalization != "psd" or self.features or self.phase_features):
            raise ValueError("with bands there is only the psd and no further features")
        if self.freqs is not None:
            x = np.asarray(self.freqs, float)
            even = len(x) > 1 and np.allclose(np.diff(x), x[1] - x[0], rtol=10 * np.finfo(np.float32).eps)
            if len(x) < 2 or (x < 0).any() or not np.all(np.diff(x) > 0):
                raise ValueError("freqs must be ascending and not negative, two at least")
            if self.fast and not (even and x[0] == 0 and (len(x) - 1) & (len(x) - 2) == 0):
                raise ValueError("fast needs an even grid from 0 of 2^k + 1 frequencies")
        for name in (*self.features, *self.phase_features):
            if name not in ARRAY_FEATURES:
                raise ValueError(f"no array kernel for {name!r}; there are {', '.join(ARRAY_FEATURES)}")

    def outputs(self):
        own = [f"period{s}_{k}" for k in range(self.peaks) for s in ("", "_s_to_n")]
        return (*own, *(f"periodogram_{n}" for n in self.features), *(f"period_folded_{n}" for n in self.phase_features))

    def names(self):
        return list(self.outputs())

    def columns(self, draft):
        series = draft.series()
        array = draft.derive(("Periodogram", self), None, lambda: over_series(self.kernel, series), 1)
        enough = draft.n() >= self.min_n
        for k, name in enumerate(self.outputs()):
            yield name, F.when(enough, F.try_element_at(array, F.lit(k + 1)))

    def spectrum(self, t: np.ndarray, m: np.ndarray, sigma: np.ndarray | None = None, band: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Angular frequencies and power."""
        freqs = np.asarray(self.freqs, float) if self.freqs is not None else spectra.grid_of(t, self.resolution, self.max_freq_factor, self.nyquist)
        one = spectra.fast_power if self.fast else spectra.power
        if not self.bands:
            return freqs, spectra.normalised(one(t, m, freqs), len(t), self.normalization)
        whole, weights = np.zeros(len(freqs)), 0.0
        for b in self.bands:
            own = band == b
            if own.sum() < 2:
                continue
            x, s = m[own], (sigma[own] if sigma is not None else np.ones(own.sum()))
            w = float(own.sum()) if self.multiband_normalization == "count" else float(np.sum(((x - x.mean()) / s) ** 2))
            whole += w * one(t[own], x, freqs)
            weights += w
        return freqs, whole / weights if weights else whole

    def kernel(self, t, m, sigma, band):
        if self.bands:
            keep = np.isin(band, self.bands)
            t, m, sigma, band = t[keep], m[keep], sigma[keep], band[keep]
        if len(t) < 3 or not t[-1] > t[0]:
            return None
        freqs, p = self.spectrum(t, m, sigma, band)
        out = spectra.peaks(freqs, p, self.peaks)
        out += [ARRAY_FEATURES[n](freqs, p) for n in self.features]
        if self.phase_features:
            phase, folded = fold(t, m, out[0] or float(t[-1] - t[0]))
            out += [ARRAY_FEATURES[n](phase, folded) for n in self.phase_features]
        return out


def fold(t: np.ndarray, m: np.ndarray, period: float) -> tuple[np.ndarray, np.ndarray]:
    """Phases in [0, 1), ascending, from the least value on, and their values."""
    phase = ((t - t[np.argmin(m)]) / period) % 1.0
    order = np.argsort(phase, kind="stable")
    return phase[order], m[order]


def _var(m: np.ndarray) -> float:
    return float(m.var(ddof=1)) or math.nan


ARRAY_FEATURES = {
    "amplitude": lambda t, m: float(np.ptp(m)) / 2,
    "mean": lambda t, m: float(m.mean()),
    "median": lambda t, m: float(np.median(m)),
    "standard_deviation": lambda t, m: float(m.std(ddof=1)),
    "beyond_1_std": lambda t, m: float(np.mean(np.abs(m - m.mean()) > m.std(ddof=1))),
    "eta": lambda t, m: float(np.sum(np.diff(m) ** 2)) / ((len(m) - 1) * _var(m)),
    "cusum": lambda t, m: float(np.ptp(np.cumsum(m - m.mean()))) / (len(m) * math.sqrt(_var(m))),
    "duration": lambda t, m: float(t[-1] - t[0]),
    "maximum_slope": lambda t, m: float(np.max(np.abs(np.diff(m) / np.where(np.diff(t) > 0, np.diff(t), np.nan)))),
    "lafler_kinman_string_length": lambda t, m: float(np.sum(np.diff(np.append(m, m[0])) ** 2)) / (2 * len(m) * _var(m)),
    "percent_amplitude": lambda t, m: float(max(m.max() - np.median(m), np.median(m) - m.min())),
    "skew": lambda t, m: float(len(m) / ((len(m) - 1) * (len(m) - 2)) * np.sum(((m - m.mean()) / math.sqrt(_var(m))) ** 3)),
}


def freq_power(df: DataFrame, periodogram: Periodogram) -> DataFrame:
    """``object_id, omega, power``: the whole spectrum of every object, a row per frequency."""

    def kernel(t, m, sigma, band):
        return np.concatenate(periodogram.spectrum(t, m, sigma, band)) if len(t) > 2 and t[-1] > t[0] else None

    series = df.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("t", "m", "sigma", "band"))).alias("s"))
    both = series.select("object_id", over_series(kernel, F.col("s")).alias("x")).where("x is not null")
    half = (F.size("x") / 2).cast("int")
    pair = F.arrays_zip(F.slice("x", 1, half).alias("omega"), F.slice("x", half + 1, half).alias("power"))
    return both.select("object_id", F.explode(pair).alias("p")).select("object_id", F.col("p.omega"), F.col("p.power"))


def model_column(kind: str, t: Column, params: Sequence[Column]) -> Column:
    """A model's curve as a JVM expression of time and parameters."""
    x = [F.lit(p) if not isinstance(p, Column) else p for p in params]
    if kind == "bazin":
        a, b, t0, rise, fall = x[:5]
        return a * F.exp(-(t - t0) / fall) / (1 + F.exp(-(t - t0) / rise)) + b
    if kind == "linexp":
        a, t0, tau, b = x[:4]
        u = (t - t0) / tau
        return F.when(u > 0, a * u * F.exp(-u)).otherwise(F.lit(0.0)) + b
    a, b, t0, rise, fall, nu, gamma = x[:7]
    u = t - t0
    return a / (1 + F.exp(-u / rise)) * F.when(u < gamma, 1 - nu * u / gamma).otherwise((1 - nu) * F.exp(-(u - gamma) / fall)) + b
