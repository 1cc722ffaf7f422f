"""Multi-band fit of a black body whose brightness and temperature change with time.

Flux in a band: ``bol(t) * S(wavelength, T(t)) / (sigma_SB T^4 / (pi nu))`` (+ a baseline per band), with
``nu`` the frequency of the mean wavelength. Brightness, temperature and spectrum are terms with named
parameters, guesses and limits; new terms are objects with the same methods.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from ..functions.fitting import batches, covariance, least_squares_many, padded
from .features import Feature
from .parametric import over_batches

# CGS constants
SPEED, PLANCK, BOLTZMANN = 2.99792458e10, 6.62607015e-27, 1.380649e-16
STEFAN = 2 * math.pi**5 * BOLTZMANN**4 / (15 * SPEED**2 * PLANCK**3)
WIEN_CM = 0.2897771955


def _s(x):
    return np.exp(np.clip(x, -100, 100))


@dataclass(frozen=True)
class Term:
    """``value(x, params)`` with parameter names, limits and guesses; priors are Gaussian (mean, sigma)."""

    name: str
    parameters: tuple[str, ...]
    value: Callable
    guess: Callable  # (t, flux) -> values
    limits: Callable  # (t, flux) -> list of (low, high)
    priors: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    peak: Callable = staticmethod(lambda p: p["reference_time"])


def _centre(t, f):
    up = np.maximum(f - np.median(f), 0)
    return float((t * up).sum() / up.sum()) if up.sum() > 0 else float(np.mean(t))


def _span(t):
    return max(float(np.ptp(t)), 1e-3)


def _time(t):
    return (float(t.min()) - 10 * _span(t), float(t.max()) + 10 * _span(t))


def _amp(f):
    return (0.0, 20 * max(float(np.ptp(f)), 1e-9))


def _linexp_start(t, f):
    """A rise time with the longer side's sign: positive where the series is longer before its maximum."""
    at = float(t[np.argmax(f)])
    return _span(t) / 10 if at - t.min() >= t.max() - at else -_span(t) / 10


def _sigmoid(x, p):
    dt = x - p["reference_time"]
    return np.where(dt > -100 * p["rise_time"], p["amplitude"] / (_s(-dt / p["rise_time"]) + 1), 0.0)


def _bazin_peak(p):
    """Where both exponentials change equally fast."""
    rise, fall = p["rise_time"], p["fall_time"]
    return p["reference_time"] + np.log(fall / rise) * rise * fall / (rise + fall)


def _bazin(x, p):
    """One over the sum of a falling and a growing exponential, of the height of the amplitude at its peak."""
    rise, fall = p["rise_time"], p["fall_time"]
    log_sum = lambda dt: np.logaddexp(-dt / rise, dt / fall)
    top = log_sum(_bazin_peak(p) - p["reference_time"])
    return p["amplitude"] * np.exp(np.maximum(top - log_sum(np.asarray(x, float) - p["reference_time"]), -700))


def _linexp(x, p):
    """Zero at the reference time; the peak comes one rise time before it, or after it if that is negative."""
    rise = np.copysign(np.maximum(np.abs(p["rise_time"]), 1e-5), p["rise_time"])
    u = (p["reference_time"] - np.asarray(x, float)) / rise
    return p["amplitude"] * np.maximum(u * np.exp(np.minimum(1 - u, 100)), 0)


def _lambert(y: float) -> float:
    """The principal solution of ``w e^w = y`` for y >= 0."""
    w = math.log1p(y)
    for _ in range(50):
        e = math.exp(w)
        w -= (w * e - y) / (e * (w + 1))
    return w


def _doublexp_peak(p):
    """Where the inner exponent's slope vanishes: ``(1 - u) e^(1 - u) = p e`` at ``u = dt / time2``."""
    return p["reference_time"] + p["time2"] * (1 - _lambert(p["p"] * math.e))


def _doublexp(x, p):
    dt = x - p["reference_time"]
    a, b, q = p["time1"], p["time2"], p["p"]
    inner = -dt / a * (q - np.exp(np.minimum(-dt / b, 500)))
    return p["amplitude"] * np.exp(np.clip(inner, -700, 20))


BOLOMETRIC = {
    "sigmoid": Term("sigmoid", ("reference_time", "amplitude", "rise_time"), _sigmoid, lambda t, f: [_centre(t, f), float(np.ptp(f)), _span(t) / 10], lambda t, f: [_time(t), _amp(f), (1e-4, 10 * _span(t))], peak=lambda p: p["reference_time"]),
    "bazin": Term("bazin", ("reference_time", "amplitude", "rise_time", "fall_time"), _bazin, lambda t, f: [_centre(t, f), float(np.ptp(f)), _span(t) / 20, _span(t) / 5], lambda t, f: [_time(t), _amp(f), (1e-4, 10 * _span(t)), (1e-4, 10 * _span(t))], peak=_bazin_peak),
    "linexp": Term("linexp", ("reference_time", "amplitude", "rise_time"), _linexp, lambda t, f: [float(t[np.argmax(f)]) + _linexp_start(t, f), float(np.ptp(f)), _linexp_start(t, f)], lambda t, f: [_time(t), _amp(f), (-10 * _span(t), 10 * _span(t))], peak=lambda p: p["reference_time"] - p["rise_time"]),
    "doublexp": Term("doublexp", ("reference_time", "amplitude", "time1", "time2", "p"), _doublexp, lambda t, f: [_centre(t, f), float(np.ptp(f)), _span(t) / 10, _span(t) / 10, 0.5], lambda t, f: [_time(t), _amp(f), (1e-2, 10 * _span(t)), (1e-2, 10 * _span(t)), (1e-4, 100.0)], peak=_doublexp_peak),
}


def _cooling(x, p, delay=0.0):
    s = 1 / (1 + _s((x - p["reference_time"] - delay) / p["t_color"]))
    return p["T"] * (1 + p["T_amplitude"] * (2 * s - 1))


TEMPERATURE = {
    "constant": Term("constant", ("T",), lambda x, p: np.full(np.shape(x), p["T"]), lambda t, f: [8000.0], lambda t, f: [(1e3, 2e6)]),
    "sigmoid": Term("sigmoid", ("reference_time", "T", "T_amplitude", "t_color"), _cooling, lambda t, f: [_centre(t, f), 8000.0, 0.1, _span(t) / 5], lambda t, f: [_time(t), (1e3, 2e6), (-0.95, 0.95), (1e-3, 10 * _span(t))], {"T_amplitude": (0.0, 0.25)}),
    "delayed_sigmoid": Term("delayed_sigmoid", ("reference_time", "T", "T_amplitude", "t_color", "t_delay"), lambda x, p: _cooling(x, p, p["t_delay"]), lambda t, f: [_centre(t, f), 8000.0, 0.1, _span(t) / 5, 0.0], lambda t, f: [_time(t), (1e3, 2e6), (-0.95, 0.95), (1e-3, 10 * _span(t)), (-_span(t), _span(t))], {"T_amplitude": (0.0, 0.25), "t_delay": (0.0, 1.0)}),
}


def planck_nu(wave_cm, temp):
    """Black body by frequency, without overflow for cold or blue."""
    nu = SPEED / wave_cm
    x = PLANCK * nu / (BOLTZMANN * temp)
    e = np.exp(-np.minimum(x, 700))
    return 2 * PLANCK / SPEED**2 * nu**3 * e / -np.expm1(-np.minimum(x, 700))


def _genwien(w, temp, p):
    nu = SPEED / w
    x = PLANCK * nu / (BOLTZMANN * temp)
    return 2 * PLANCK / SPEED**2 * nu**3 * np.exp(-np.minimum(x ** p["spec_k"], 700))


def _blanketed(w, temp, p):
    cut = 2 * WIEN_CM * 1e8 * p["lambda_scale"] / p["T"]  # in units of 1e-8 cm
    return planck_nu(w, temp) * np.exp(-100 * np.exp(-np.minimum(w * 1e8 / cut, 700)))


def _parabola(w, temp, p):
    x = np.log(w * 1e8 / 6000.0)
    return planck_nu(w, temp) * np.exp(np.clip(p["sp_a"] * x + p["sp_b"] * x * x, -50, 50))


@dataclass(frozen=True)
class Spectrum:
    name: str
    parameters: tuple[str, ...]
    value: Callable  # (wavelength in cm, temperature, params)
    start: tuple[float, ...] = ()
    box: tuple[tuple[float, float], ...] = ()
    priors: Mapping[str, tuple[float, float]] = field(default_factory=dict)


SPECTRAL = {
    "planck": Spectrum("planck", (), lambda w, temp, p: planck_nu(w, temp)),
    "blanketed": Spectrum("blanketed", ("lambda_scale",), _blanketed, (0.3,), ((1e-3, 1.0),)),
    "genwien": Spectrum("genwien", ("spec_k",), _genwien, (1.0,), ((0.3, 3.0),), {"spec_k": (1.0, 0.5)}),
    "modified_bb": Spectrum("modified_bb", ("beta",), lambda w, temp, p: planck_nu(w, temp) * (w * 1e8 / 6000.0) ** p["beta"], (0.0,), ((-6.0, 10.0),), {"beta": (0.0, 1.0)}),
    "logparabola": Spectrum("logparabola", ("sp_a", "sp_b"), _parabola, (0.0, 0.0), ((-6.0, 6.0), (-4.0, 4.0)), {"sp_a": (0.0, 0.5), "sp_b": (0.0, 0.5)}),
}


def log_normal_cdf(z: np.ndarray) -> np.ndarray:
    """Log of the normal distribution function, by its tail far below."""
    from ..functions.kernels import normal_cdf

    z = np.asarray(z, float)
    far = z < -8
    tail = -0.5 * z**2 - np.log(np.maximum(-z, 1e-9) * math.sqrt(2 * math.pi))
    return np.where(far, tail, np.log(np.maximum(normal_cdf(np.where(far, 0, z)), 1e-300)))


@dataclass(frozen=True, kw_only=True)
class RainbowFit(Feature):
    """Parameters, and half of chi-square per degree of freedom (the cost is a negative log-likelihood).

    ``wavelengths`` are (band, centimetres). A row has ``len(parameters) + 1`` values, defined or not.
    """

    wavelengths: tuple[tuple[str, float], ...] = ()
    with_baseline: bool = True
    bolometric: str | Term = "bazin"
    temperature: str | Term = "sigmoid"
    spectral: str | Spectrum = "planck"
    fail_on_divergence: bool = True

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "wavelengths", tuple((str(b), float(w)) for b, w in (self.wavelengths.items() if isinstance(self.wavelengths, dict) else self.wavelengths)))
        labels = [b for b, _ in self.wavelengths]
        if not labels or len(set(labels)) < len(labels) or min(w for _, w in self.wavelengths) <= 0:
            raise ValueError("bands must be unique, with positive wavelengths")
        if self.bands or self.transform not in (None, False):
            raise ValueError("the bands of a rainbow are its wavelengths, and it takes no transform")
        for part, table in ((self.bolometric, BOLOMETRIC), (self.temperature, TEMPERATURE), (self.spectral, SPECTRAL)):
            if isinstance(part, str) and part not in table:
                raise ValueError(f"unknown term {part!r}; there are {', '.join(table)}")

    @classmethod
    def from_angstrom(cls, wavelengths: Mapping[str, float], **how) -> RainbowFit:
        return cls(wavelengths=tuple((b, w * 1e-8) for b, w in wavelengths.items()), **how)

    @classmethod
    def from_nm(cls, wavelengths: Mapping[str, float], **how) -> RainbowFit:
        return cls(wavelengths=tuple((b, w * 1e-7) for b, w in wavelengths.items()), **how)

    def terms(self) -> tuple[Term, Term, Spectrum]:
        pick = lambda x, table: table[x] if isinstance(x, str) else x
        return pick(self.bolometric, BOLOMETRIC), pick(self.temperature, TEMPERATURE), pick(self.spectral, SPECTRAL)

    def parameters(self) -> list[str]:
        """Shared ones first, then brightness, temperature, spectrum, baselines."""
        bol, temp, spec = self.terms()
        shared = [p for p in bol.parameters if p in temp.parameters]
        own = [[p for p in part.parameters if p not in shared] for part in (bol, temp)]
        spectrum = [p for p in spec.parameters if p not in temp.parameters]
        return [*shared, *own[0], *own[1], *spectrum, *([f"baseline_{b}" for b, _ in self.wavelengths] if self.with_baseline else [])]

    def outputs(self):
        return (*self.parameters(), "reduced_chi2")

    def names(self):
        return [f"rainbow_{n}" for n in self.outputs()]

    def columns(self, draft):
        series = draft.series()
        array = draft.derive(("RainbowFit", str(self)), None, lambda: over_batches(self.kernels, series), 1)
        for k, name in enumerate(self.names()):
            yield name, F.try_element_at(array, F.lit(k + 1))

    def model(self, t, band, params: Sequence[float]) -> np.ndarray:
        """Flux at times in bands."""
        return self._flux(np.asarray(t, float), self._places(band), dict(zip(self.parameters(), params, strict=False)))

    def _places(self, band) -> np.ndarray:
        place = {b: k for k, (b, _) in enumerate(self.wavelengths)}
        return np.array([place[b] for b in band], int)

    def _flux(self, t: np.ndarray, place: np.ndarray, p: Mapping[str, float | np.ndarray]) -> np.ndarray:
        """Flux where ``place`` is each time's band; parameters are numbers, or columns for rows of times."""
        bol, temp, spec = self.terms()
        waves = np.array([w for _, w in self.wavelengths])
        nu = SPEED / np.mean(waves)
        if temp is TEMPERATURE["constant"]:  # one spectrum for all times
            kelvin = np.asarray(p["T"], float)
            light = spec.value(waves, kelvin, p)
            light = light[place] if light.ndim == 1 else np.take_along_axis(light, place, 1)
        else:
            kelvin = temp.value(t, p)
            light = spec.value(waves[place], kelvin, p)
        norm = STEFAN * kelvin**4 / (math.pi * nu)
        flux = bol.value(t, p) * light / norm
        for k, (b, _) in enumerate(self.wavelengths if self.with_baseline else ()):
            flux = flux + np.where(place == k, p[f"baseline_{b}"], 0.0)
        return flux

    def peak_time(self, params: Sequence[float]) -> float:
        p = dict(zip(self.parameters(), params, strict=False))
        return self.terms()[0].peak(p)

    def fit(self, t, m, sigma, band, upper_mask=None) -> tuple[np.ndarray, float, np.ndarray]:
        """Parameters, half of chi-square per degree of freedom, covariance; upper limits count by the chance of lying below."""
        problem = self._problem(t, m, sigma, band, upper_mask)
        best = self._solve([problem])[0]
        residuals = lambda q: self._residuals([problem])(q[None], np.zeros(1, int))[0]
        h = 1e-6
        jac = np.stack([(residuals(best + h * e) - residuals(best)) / h for e in np.eye(len(best))], 1)
        unit = self._units(problem) * np.where(self._logs(), self._back(best), 1)
        return *self._result(problem, best, residuals(best)), covariance(jac) * np.outer(unit, unit)

    def fits(self, many: Sequence[tuple]) -> list[tuple[np.ndarray, float] | None]:
        """Parameters and chi-square as of :meth:`fit` of many ``(t, m, sigma, band)``, fitted side by side; None where observations are too few."""
        out: list[tuple[np.ndarray, float] | None] = [None] * len(many)
        long = [i for i, s in enumerate(many) if len(s[0]) > len(self.parameters())]
        for batch in batches([len(many[i][0]) for i in long], 9):
            problems = [self._problem(*many[long[b]]) for b in batch]
            best = self._solve(problems)
            with np.errstate(all="ignore"):
                r = self._residuals(problems)(best, np.arange(len(batch)))
            for i, b in enumerate(batch):
                out[long[b]] = self._result(problems[i], best[i], r[i])
        return out

    def _logs(self) -> list[bool]:
        """Positive parameters are fitted by their logarithm; a rise time of either sign is not."""
        bol = self.terms()[0]
        return [n in ("T", "rise_time", "fall_time", "t_color", "time1", "time2") and not (n == "rise_time" and bol.name == "linexp") for n in self.parameters()]

    def _back(self, q: np.ndarray) -> np.ndarray:
        return np.where(self._logs(), np.exp(np.clip(q, -50, 50)), q)

    def _problem(self, t, m, sigma, band, upper_mask=None) -> dict:
        """One series in units of its own, with starting places and limits."""
        t, m, sigma, band = np.asarray(t, float), np.asarray(m, float), np.asarray(sigma, float), np.asarray(band, object)
        upper = np.zeros(len(t), bool) if upper_mask is None else np.asarray(upper_mask, bool)
        names = self.parameters()
        bol, temp, spec = self.terms()
        if len(t) <= len(names):
            raise ValueError("too few observations")
        t0, t_scale, scale = t.mean(), t.std() or 1.0, m.std() or 1.0
        ts, ms, ss = (t - t0) / t_scale, m / scale, sigma / scale
        flat, place = ms, self._places(band)
        start, low, high, prior = {}, {}, {}, {}
        if self.with_baseline:
            base = {b: float(np.median(ms[band == b])) if (band == b).any() else 0.0 for b, _ in self.wavelengths}
            flat = ms - np.array([base[b] for b in band])
        for part in (temp, bol):
            for n, g, (a, z) in zip(part.parameters, part.guess(ts, flat), part.limits(ts, flat), strict=True):
                start[n], low[n], high[n] = g, a, z
            prior |= part.priors
        for n, g, (a, z) in zip(spec.parameters, spec.start, spec.box, strict=True):
            start[n], low[n], high[n] = g, a, z
        prior |= spec.priors
        if self.with_baseline:
            for b, _ in self.wavelengths:
                own = ms[band == b] if (band == b).any() else ms
                start[f"baseline_{b}"], low[f"baseline_{b}"], high[f"baseline_{b}"] = base[b], float(own.min() - 10 * np.ptp(own) - 1e-9), float(own.max() + 1e-9)
        logs = self._logs()
        into = lambda d: np.array([math.log(d[n]) if lg else d[n] for n, lg in zip(names, logs, strict=True)])
        starts = []
        for shift in (0.0, -0.5, 0.5):
            for stretch in (1.0, 0.3, 3.0):
                d = dict(start)
                d["reference_time"] = start["reference_time"] + shift if "reference_time" in d else 0.0
                for n in ("rise_time", "fall_time"):
                    if n in d:
                        d[n] = min(max(d[n] * stretch, low[n]), high[n])
                if bol.name == "linexp":  # the peak stays, the zero moves with the rise time
                    d["reference_time"] += d["rise_time"] - start["rise_time"]
                    if stretch == 1.0 and shift:
                        d["reference_time"], d["rise_time"] = d["reference_time"] - 2 * d["rise_time"], -d["rise_time"]
                starts.append(into(d))
        low = low | {n: max(low[n], 1e-9) for n, lg in zip(names, logs, strict=True) if lg}
        weights = [(names.index(n), mu, s) for n, (mu, s) in prior.items() if n in names]
        return dict(t=ts, m=ms, sigma=ss, place=place, upper=upper, starts=np.array(starts), low=into(low), high=into(high), weights=weights, t0=t0, t_scale=t_scale, scale=scale)

    def _residuals(self, problems: Sequence[dict]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Residuals of rows of parameters, of the problems at ``which``, with those of the priors behind them."""
        names = self.parameters()
        side = all(isinstance(x, str) for x in (self.bolometric, self.temperature, self.spectral))
        weights = problems[0]["weights"]
        t, m, place = padded([x["t"] for x in problems]), padded([x["m"] for x in problems]), padded([x["place"] for x in problems]).astype(int)
        sigma, upper = padded([x["sigma"] for x in problems], 1.0), padded([x["upper"] for x in problems], 0.0) > 0
        there = np.arange(t.shape[1]) < np.array([[len(x["t"])] for x in problems])

        def run(q: np.ndarray, which: np.ndarray) -> np.ndarray:
            p = self._back(q)
            if side:
                f = self._flux(t[which], place[which], {n: p[:, k, None] for k, n in enumerate(names)})
            else:  # a term of the caller's own may take one series only
                f = np.stack([self._flux(t[i], place[i], dict(zip(names, row, strict=True))) for i, row in zip(which, p, strict=True)])
            r = (f - m[which]) / sigma[which]
            if upper.any():
                r = np.where(upper[which], np.sqrt(np.maximum(-2 * log_normal_cdf((m[which] - f) / sigma[which]), 0)), r)
            return np.hstack([np.where(there[which], r, 0.0), *[(p[:, k, None] - mu) / s for k, mu, s in weights]])

        return run

    def _solve(self, problems: Sequence[dict]) -> np.ndarray:
        """The best of each problem's starting places after least squares."""
        n, s = len(problems), len(problems[0]["starts"])
        of = np.repeat(np.arange(n), s)
        residuals = self._residuals(problems)
        low, high = (np.stack([x[key] for x in problems])[of] for key in ("low", "high"))
        with np.errstate(all="ignore"):  # a step may run out of the range of numbers; its sum of squares then loses
            p, cost = least_squares_many(lambda q, which: residuals(q, of[which]), np.concatenate([x["starts"] for x in problems]), low, high, 150)
        least = np.argmin(np.where(np.isnan(cost), np.inf, cost).reshape(n, s), 1)
        return p.reshape(n, s, -1)[np.arange(n), least]

    def _units(self, problem: dict) -> np.ndarray:
        return np.array([problem["t_scale"] if n in ("reference_time", "rise_time", "fall_time", "t_color", "t_delay", "time1", "time2") else problem["scale"] if n == "amplitude" or n.startswith("baseline_") else 1.0 for n in self.parameters()])

    def _result(self, problem: dict, best: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
        out = self._back(best) * self._units(problem)
        names = self.parameters()
        if "reference_time" in names:
            out[names.index("reference_time")] += problem["t0"]
        r = r[: len(problem["t"])]
        return out, 0.5 * float(r @ r) / (len(r) - len(names))

    def fit_and_get_errors(self, t, m, sigma, band, upper_mask=None) -> tuple[np.ndarray, np.ndarray]:
        """Values (with chi-square) and errors of the parameters."""
        p, chi2, cov = self.fit(t, m, sigma, band, upper_mask)
        return np.append(p, chi2), np.sqrt(np.maximum(np.diag(cov), 0))

    def kernels(self, many):
        """Values of many series, which are fitted side by side."""
        bands = [b for b, _ in self.wavelengths]
        known = [(s, np.isin(s[3], bands)) for s in many]
        fits = self.fits([tuple(x[k] for x in s) for s, k in known])
        return [None if got is None or (self.fail_on_divergence and not math.isfinite(got[1])) else [*got[0], got[1]] for got in fits]

    def kernel(self, t, m, sigma, band):
        return self.kernels([(t, m, sigma, band)])[0]
