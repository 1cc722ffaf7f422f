"""Golden values of single features, contracts of extraction, specs as JSON."""

import math

import numpy as np
import pytest

from tidemark.functions import fitting
from tidemark.operators import features as fs
from tidemark.operators import rainbow
from tidemark.operators.binning import Bins, Bootstrap, binned
from tidemark.operators.parametric import BazinFit, LinexpFit, Periodogram, VillarFit
from tidemark.operators.rainbow import RainbowFit
from tidemark.plans.planner import extract, extract_array

SCHEMA = "object_id long, t double, m double, sigma double, band string"


def curve(m, t=None, sigma=None, band=None, who=1):
    n = len(m)
    t = range(n) if t is None else t
    sigma = [1.0] * n if sigma is None else [sigma] * n if isinstance(sigma, (int, float)) else sigma
    band = [None] * n if band is None else band
    return [(who, float(a), float(b), float(s), x) for a, b, s, x in zip(t, m, sigma, band, strict=True)]


def values(spark, rows, *features, **how):
    return list(extract(spark.createDataFrame(rows, SCHEMA), features, **how).first())[1:]


GOLDEN = [
    (fs.Amplitude(), curve(range(11)), [5]),
    (fs.AndersonDarlingNormal(), curve(range(9)), [0.155339690]),
    (fs.BeyondNStd(), curve([1, 2, 3, 4, 5, 10]), [1 / 6]),
    (fs.Cusum(), curve([1, 2, 3, 4, 5, 5]), [0.408248290463863]),
    (fs.Eta(), curve([1, 2, 3, 3, 3, 4, 4]), [0.4375]),
    (fs.EtaE(), curve([1, 2, 3, 8, 11], t=[1, 2, 7, 9, 10]), [1.114434]),
    (fs.ExcessVariance(), curve([1, 1, 2, 3, 4, 5], sigma=[0.5] * 5 + [0.2]), [0.344765625]),
    (fs.InterPercentileRange(), curve(range(1, 7)), [3]),
    (fs.MaximumSlope(), curve([2, 4, 15, 3], t=[1, 3, 4, 8]), [11]),
    (fs.MedianAbsoluteDeviation(), curve([1, 1, 3, 4, 7]), [2]),
    (fs.MedianBufferRangePercentage(), curve(range(1, 8)), [1 / 7]),
    (fs.OtsuSplit(), curve([0.5, 1.5, 1.5, 1.5]), [1, 0, 0, 0.25]),
    (fs.OtsuThreshold(), curve([0.45, 0.5, 0.52]), [0.5]),
    (fs.PercentAmplitude(), curve([1, 1, 3, 4, 7]), [4]),
    (fs.PercentDifferenceMagnitudePercentile(), curve(range(1, 7)), [3 / 3.5]),
    (fs.ReducedChi2(), curve([1, 1, 2, 3, 4, 5], sigma=0.5), [10.666667]),
    (fs.Skew(), curve([1, 2, 3, 50, 25]), [1.307253786]),
    (fs.WeightedMean(), curve([2, 3, 1, 9, 5], sigma=[0.3, 0.4, 0.5, 1, 1]), [2.52437574316]),
    (fs.FluxNNotDetBeforeFd(signal_to_noise=10), curve([1, 2, 10, 40, 50], sigma=[0.4, 0.2, 0.01, 0.03, 0.02]), [2]),
    (fs.MagnitudeNNotDetBeforeFd(sigma_non_detection=-1), curve([0] * 5, sigma=[-1, -1, -1, 0.2, 0.03]), [3]),
    (fs.ParabolaFit(), curve([2 * (t - 3) ** 2 + 5 for t in range(6)]), [2, 5, 0]),
    (fs.ObservationCount(), curve([1, 2, 3]), [3]),
    (fs.StetsonK(), curve([0, 0, 0, 0, 1, 1, 1, 1]), [1.0]),
]


@pytest.mark.parametrize("feature, rows, want", GOLDEN, ids=lambda x: type(x).__name__ if isinstance(x, fs.Feature) else "")
def test_golden(spark, feature, rows, want):
    got = values(spark, rows, feature)
    assert got == pytest.approx(want, rel=2e-5, abs=1e-9)


def test_all_golden_in_one_plan(spark):
    """One exchange serves every feature, and shared names are made once."""
    rows = curve([1, 2, 3, 50, 25, 7], t=[0, 1, 3, 4, 6, 9], sigma=0.5)
    many = [fs.Amplitude(), fs.Eta(), fs.Skew(), fs.LinearFit(), fs.OtsuSplit(), fs.StetsonK()]
    df = extract(spark.createDataFrame(rows, SCHEMA), many)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    apart = [v for f in many for v in values(spark, rows, f)]
    assert list(df.first())[1:] == pytest.approx(apart)


def test_undefined_values(spark):
    rows = curve([5.0]) + curve([1.0, 1.0, 1.0], who=2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["object_id"]: r for r in extract(df, [fs.Mean(), fs.StandardDeviation(), fs.Eta()]).collect()}
    assert got[1]["mean"] == 5 and got[1]["standard_deviation"] is None and got[1]["eta"] is None
    assert got[2]["eta"] is None  # no variance
    filled = extract(df, [fs.Eta()], fill=-1.0).collect()
    assert {r["eta"] for r in filled} == {-1.0}
    with pytest.raises(Exception, match="not defined"):
        extract(df, [fs.Eta()], strict=True).collect()
    assert extract(df.limit(0), [fs.Eta()]).count() == 0


def test_bands(spark):
    rows = curve([1, 2, 3, 10, 20, 30], band=["g", "g", "g", "r", "r", "r"])
    got = extract(spark.createDataFrame(rows, SCHEMA), [fs.Mean(bands=("r", "g")), fs.Mean(), fs.ColorOfMaximum(bands=("r", "g")), fs.ColorSpread(bands=("g", "r"))]).first().asDict()
    assert list(got)[1:] == ["mean_r", "mean_g", "mean", "color_max_r_g", "color_spread_g_r"]
    assert got["mean_r"] == 20 and got["mean_g"] == 2 and got["mean"] == 11 and got["color_max_r_g"] == 27 and got["color_spread_g_r"] == 9
    missing = extract(spark.createDataFrame(rows[:3], SCHEMA), [fs.Mean(bands=("r", "g"))], fill=0.0).first()
    assert missing["mean_r"] == 0 and missing["mean_g"] == 2  # only the band that fails is filled
    with pytest.raises(ValueError):
        fs.ColorOfMaximum(bands=("g",))
    with pytest.raises(ValueError):
        fs.Mean(bands=("g", "g"))


def test_transforms(spark):
    assert values(spark, curve([1, 2, 3]), fs.Mean(transform="lg")) == pytest.approx([math.log10(2)])
    rows = curve([1, 2, 3, 50, 25])
    assert values(spark, rows, fs.Skew(transform=True)) == pytest.approx([math.asinh(1.307253786)])
    with pytest.raises(ValueError):
        fs.Mean(transform="square")


@pytest.mark.parametrize("feature", [fs.BeyondNStd(nstd=2.0, bands=("g", "r")), fs.Extractor(features=(fs.Mean(), fs.LinearFit())), Bins(features=(fs.Mean(),), window=2.0, offset=1.0), Bootstrap(features=(fs.Mean(),), n_bootstrap=5), Periodogram(peaks=2), BazinFit()])
def test_json(feature):
    again = fs.from_json(feature.to_json())
    assert again == feature and again.names() == feature.names() and feature.size == len(feature.names())


def test_every_registered_feature_names_its_columns(spark):
    rng = np.random.default_rng(0)
    rows = curve(rng.uniform(15, 21, 60), t=np.sort(rng.uniform(0, 100, 60)), sigma=0.1, band=["g", "r"] * 30)
    special = {"Feature", "_Colour", "_Kernel", "_Fit", "Extractor", "Bins", "Bootstrap", "RainbowFit", "ColorOfMaximum", "ColorOfMedian", "ColorOfMinimum", "ColorSpread", "BazinFit", "LinexpFit", "VillarFit"}
    plain = [c() for n, c in fs.REGISTRY.items() if n not in special]
    row = extract(spark.createDataFrame(rows, SCHEMA), plain).first().asDict()
    assert list(row)[1:] == [n for f in plain for n in f.names()]
    array = extract_array(spark.createDataFrame(rows, SCHEMA), plain[:5]).first()["features"]
    assert array == pytest.approx(list(row.values())[1 : 1 + len(array)])


def test_bins(spark):
    rows = curve([0, 1, 2, 3, 7, 9, 10], t=[0.1, 1.1, 1.9, 2.5, 2.6, 2.7, 5.5], sigma=1.0)
    got = sorted((r["t"], r["m"], r["sigma"]) for r in binned(spark.createDataFrame(rows, SCHEMA), 1.0).collect())
    assert [x[0] for x in got] == [0.5, 1.5, 2.5, 5.5] and [x[1] for x in got] == pytest.approx([0, 1.5, 19 / 3, 10])
    assert values(spark, rows, Bins(features=(fs.ObservationCount(),), window=1.0)) == [4]


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = curve(rng.normal(0, 1, 400))
    f = Bootstrap(features=(fs.Mean(),), n_bootstrap=100, seed=2)
    mean, sigma = values(spark, rows, f)
    assert sigma == pytest.approx(1 / 20, rel=0.25) and values(spark, rows, f) == [mean, sigma]
    with pytest.raises(ValueError):
        Bootstrap(features=(fs.Eta(),))
    with pytest.raises(ValueError):
        Bootstrap(features=(fs.Mean(),), n_bootstrap=1)
    q = values(spark, rows, Bootstrap(features=(fs.Median(),), n_bootstrap=20, quantiles=(0.0, 1.0)))
    assert q[1] <= q[0] <= q[2]


def test_fits_recover(spark):
    t = np.linspace(0, 1000, 300)
    rng = np.random.default_rng(3)
    for cls, p in ((BazinFit, [100, 100, 500, 100, 200]), (LinexpFit, [300, 200, 100, 20]), (VillarFit, [100, 10, 300, 20, 100, 0.3, 150])):
        y = cls.model(t, p)
        s = np.full(len(t), 1.0)
        rows = curve(y + rng.normal(0, 1, len(t)), t=t, sigma=1.0)
        got = values(spark, rows, cls(mcmc_niter=64))
        assert got[-1] < 1.5, cls.__name__
        assert np.abs(cls.model(t, got[:-1]) - y).max() < 0.1 * np.ptp(y), cls.__name__
        assert len(s) == len(t)
    with pytest.raises(ValueError):
        BazinFit(algorithm="simplex")
    with pytest.raises(ValueError):
        BazinFit(init=(1.0,))


def test_periodogram(spark):
    from tidemark.functions import spectra

    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 50, 200))
    m = np.sin(12.3 * t) + 0.2 * rng.normal(size=200)
    period, _ = values(spark, curve(m, t=t), Periodogram(max_freq_factor=2.0))
    assert period == pytest.approx(2 * math.pi / 12.3, rel=1e-2)
    freqs = spectra.grid_of(t, 10, 1)
    y = (m - m.mean()) / m.std(ddof=1)
    for w, got in zip(freqs[5:200:40], spectra.power(t, m, freqs)[5:200:40], strict=True):
        tau = math.atan2(np.sin(2 * w * t).sum(), np.cos(2 * w * t).sum()) / (2 * w)
        c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
        assert got == pytest.approx(0.5 * ((y @ c) ** 2 / (c @ c) + (y @ s) ** 2 / (s @ s)))
    assert np.abs(spectra.fast_power(t, m, freqs) - spectra.power(t, m, freqs)).max() < 0.05 * spectra.power(t, m, freqs).max()
    with pytest.raises(ValueError):
        Periodogram(freqs=(1.0, 2.0, 4.0))


def test_rainbow():
    rng = np.random.default_rng(5)
    waves = {"g": 4770.0, "r": 6231.0, "i": 7625.0}
    f = RainbowFit.from_angstrom(waves, bolometric="sigmoid", temperature="constant")
    t, band = np.sort(rng.uniform(0, 60, 200)), rng.choice(list(waves), 200)
    true = dict(reference_time=30.0, amplitude=10.0, rise_time=4.0, T=9000.0) | {f"baseline_{b}": 0.2 for b in waves}
    y = f.model(t, band, [true[n] for n in f.parameters()])
    s = np.full(200, 0.03 * np.ptp(y))
    p, errors = f.fit_and_get_errors(t, y + rng.normal(0, s), s, band)
    assert np.abs(f.model(t, band, p) - y).max() < 0.1 * np.ptp(y)
    assert 0.3 < p[-1] < 0.8 and len(errors) == len(p) - 1  # half of chi-square per degree of freedom


def test_linear_fits_hold_no_series(spark):
    """Sums only, about the means of an object: large times cost no digits."""
    rng = np.random.default_rng(8)
    t = 2_450_000 + np.sort(rng.uniform(0, 30, 60))
    m, sigma = 3 + 0.2 * (t - t[0]) - 0.03 * (t - t[0]) ** 2 + rng.normal(0, 0.1, 60), rng.uniform(0.05, 0.2, 60)
    specs = [fs.LinearFit(), fs.LinearTrend(), fs.ParabolaFit()]
    frame = spark.createDataFrame([(1, *map(float, r), "g") for r in zip(t, m, sigma, strict=True)], "object_id long, t double, m double, sigma double, band string")
    out = extract(frame, specs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
    row = out.first()
    w, x = 1 / sigma, t - t.mean()
    line = np.polyfit(x, m, 1, w=w)
    assert row["linear_fit_slope"] == pytest.approx(line[0], rel=1e-9) and row["linear_trend"] == pytest.approx(np.polyfit(x, m, 1)[0], rel=1e-9)
    assert row["linear_fit_reduced_chi2"] == pytest.approx((((m - np.polyval(line, x)) * w) ** 2).sum() / 58, rel=1e-9)
    bow = np.polyfit(x, m, 2, w=w)
    assert row["parabola_fit_g"] == pytest.approx(bow[0], rel=1e-8) and row["parabola_fit_m0"] == pytest.approx(bow[2] - bow[1] ** 2 / (4 * bow[0]), rel=1e-8)
    assert row["parabola_fit_reduced_chi2"] == pytest.approx((((m - np.polyval(bow, x)) * w) ** 2).sum() / 57, rel=1e-7)


PRIORS = {"normal": fitting.normal(3.0, 0.5), "log_normal": fitting.log_normal(1.0, 0.4), "uniform": fitting.uniform(1.0, 4.0), "log_uniform": fitting.log_uniform(0.5, 9.0), "mix": fitting.mix([(2.0, fitting.normal(2.0, 0.3)), (1.0, fitting.normal(6.0, 2.0))])}


@pytest.mark.parametrize("name", PRIORS)
def test_priors_attract(name):
    """The squared residual is -2 ln of the density up to a constant that doesn't depend on the parameter; least at the mode."""
    prior = PRIORS[name]
    x = np.linspace(1.01, 3.99, 50)
    cost = np.array([prior.residual(v) ** 2 for v in x])
    shift = cost + 2 * np.array([prior(v) for v in x])
    assert np.ptp(shift) < 1e-9 and prior.residual(prior.mode()) == pytest.approx(0, abs=1e-9) and (cost >= 0).all()


@pytest.mark.parametrize("name, args", [("normal", (9.0, 0.02)), ("log_normal", (math.log(9.0), 0.002)), ("uniform", (8.5, 9.1)), ("log_uniform", (8.0, 9.1))])
def test_fit_with_a_prior(name, args):
    """The fit stands where a grid search over the amplitude finds the least sum of chi-square and prior."""
    rng = np.random.default_rng(3)
    t, true = np.sort(rng.uniform(0, 60, 120)), (10.0, 1.0, 25.0, 4.0, 12.0)
    s = np.full(120, 0.3)
    y = fitting.bazin(t, true) + rng.normal(0, s)
    prior = getattr(fitting, name)(*args)
    free = fitting.none()
    p = fitting.fit_model("bazin", t, y, s, niter=16, ln_prior=(prior, free, free, free, free))
    total = lambda p: float((((fitting.bazin(t, p) - y) / s) ** 2).sum()) - 2 * prior(p[0])
    rest = lambda a: fitting.fit_model("bazin", t, y, s, niter=0, init=[a, *p[1:5]], bounds=[(a, a), *[None] * 4])
    grid = [total(rest(a)[:5]) for a in np.clip(np.linspace(p[0] - 0.3, p[0] + 0.3, 13), *np.clip(prior.support(), 1, 99))]
    assert total(p[:5]) <= min(grid) + 1e-3
    assert abs(p[0] - 9.0) < 0.2 and fitting.fit_model("bazin", t, y, s, niter=16)[0] == pytest.approx(10, abs=0.5)


def test_robust_loss():
    """Outliers pull the plain fit and not the one with Huber's loss."""
    rng = np.random.default_rng(3)
    t, true = np.sort(rng.uniform(0, 60, 150)), (10.0, 1.0, 25.0, 4.0, 12.0)
    s = np.full(150, 0.2)
    y = fitting.bazin(t, true) + rng.normal(0, s)
    y[::10] += 6
    off = lambda **how: np.abs(fitting.bazin(t, fitting.fit_model("bazin", t, y, s, "mcmc-ceres", 32, **how)) - fitting.bazin(t, true)).mean()
    assert 3 * off(loss_reg=2.0) < off()


def test_rainbow_terms():
    """Written-out formulas, and peaks where the curves have them."""
    x = np.linspace(-40, 60, 4001)
    r, f, a, t0 = 5.0, 20.0, 3.0, 2.0
    scale = (f / r) ** (r / (f + r)) + (f / r) ** (-f / (f + r))
    names = {"bazin": dict(reference_time=t0, amplitude=a, rise_time=r, fall_time=f), "linexp": dict(reference_time=t0, amplitude=a, rise_time=-r), "doublexp": dict(reference_time=t0, amplitude=a, time1=4.0, time2=6.0, p=0.3)}
    dt = x - t0
    want = {"bazin": a * scale / (np.exp(-dt / r) + np.exp(dt / f)), "linexp": np.maximum(a * np.e * dt / r * np.exp(-dt / r), 0), "doublexp": a * np.exp(np.minimum(-dt / 4 * (0.3 - np.exp(-dt / 6)), 20))}
    for name, p in names.items():
        term = rainbow.BOLOMETRIC[name]
        got = term.value(x, p)
        assert got == pytest.approx(want[name], rel=1e-9, abs=1e-12), name
        inside = x > -10
        assert term.peak(p) == pytest.approx(x[inside][np.argmax(got[inside])], abs=0.05), name
    assert want["bazin"].max() == pytest.approx(a, rel=1e-4)
    short = dict(names["bazin"], rise_time=20.0, fall_time=5.0)
    assert rainbow.BOLOMETRIC["bazin"].value(x, short).max() == pytest.approx(a, rel=1e-4)
    early = dict(names["linexp"], rise_time=r)
    assert rainbow.BOLOMETRIC["linexp"].value(x, early).max() == pytest.approx(a, rel=1e-4) and rainbow.BOLOMETRIC["linexp"].peak(early) == t0 - r
    assert rainbow.STEFAN == pytest.approx(5.6703744191844e-5, rel=1e-10)


@pytest.mark.parametrize("bolometric, own", [("bazin", dict(reference_time=30.0, amplitude=10.0, rise_time=3.0, fall_time=9.0)), ("linexp", dict(reference_time=15.0, amplitude=10.0, rise_time=-8.0)), ("doublexp", dict(reference_time=25.0, amplitude=10.0, time1=6.0, time2=8.0, p=0.6))])
@pytest.mark.parametrize("temperature", ["constant", "sigmoid"])
def test_rainbow_recovers(bolometric, own, temperature):
    rng = np.random.default_rng(5)
    waves = {"g": 4770.0, "r": 6231.0, "i": 7625.0}
    f = RainbowFit.from_angstrom(waves, bolometric=bolometric, temperature=temperature, with_baseline=False)
    t, band = np.sort(rng.uniform(0, 60, 240)), rng.choice(list(waves), 240)
    true = own | dict(T=9000.0, T_amplitude=0.2, t_color=5.0)
    y = f.model(t, band, [true[n] for n in f.parameters()])
    s = np.full(240, 0.03 * np.ptp(y))
    p, errors = f.fit_and_get_errors(t, y + rng.normal(0, s), s, band)
    assert np.abs(f.model(t, band, p) - y).max() < 0.1 * np.ptp(y) and p[-1] < 0.8


def transients(count: int = 40):
    """Noisy rises and falls of several lengths in two bands."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(count):
        n = 40 + i % 7
        t = np.sort(rng.uniform(0, 60, n))
        y = fitting.bazin(t, (10.0 + i % 5, 1.0, 20.0 + i % 9, 3.0, 12.0))
        out.append((t, y + rng.normal(0, 0.2, n), np.full(n, 0.2), np.array(["g", "r"] * n, object)[:n]))
    return out


@pytest.mark.parametrize("kind", ["bazin", "linexp", "villar"])
def test_series_are_fitted_side_by_side(kind, monkeypatch):
    """Many fits call the model about as often as the longest one alone, and give what each gives alone; short ones give nothing."""
    from dataclasses import replace

    calls = []
    model = fitting.MODELS[kind]
    counting = lambda t, p: calls.append(1) or model.curve(t, p)
    counting.__name__ = kind
    monkeypatch.setitem(fitting.MODELS, kind, replace(model, curve=counting))
    series = [s[:3] for s in transients()]
    cls = {"bazin": BazinFit, "linexp": LinexpFit, "villar": VillarFit}[kind]
    together = cls(mcmc_niter=16).kernels([*transients(), tuple(x[:3] for x in transients(1)[0])])
    most, calls[:] = len(calls), []
    alone = [fitting.fit_model(kind, *s, niter=16) for s in series]
    assert together[-1] is None and most < len(calls) / 5
    assert [x[-1] for x in together[:-1]] == pytest.approx([x[-1] for x in alone], rel=1e-3)


def test_rainbows_are_fitted_side_by_side(monkeypatch):
    calls = []
    flux = RainbowFit._flux
    monkeypatch.setattr(RainbowFit, "_flux", lambda *a: calls.append(1) or flux(*a))
    f = RainbowFit.from_angstrom({"g": 4770.0, "r": 6231.0}, bolometric="sigmoid", temperature="constant", with_baseline=False)
    together = f.kernels([*transients(), tuple(x[:3] for x in transients(1)[0])])
    most, calls[:] = len(calls), []
    alone = [f.kernel(*s) for s in transients()]
    assert together[-1] is None and most < len(calls) / 5
    assert [x[-1] for x in together[:-1]] == pytest.approx([x[-1] for x in alone], rel=1e-3)


def test_many_least_squares_are_those_of_each():
    """The same minima as one problem after another, with bounds that bind in some."""
    rng = np.random.default_rng(12)
    t = np.linspace(0, 5, 30)
    true = np.column_stack([rng.uniform(1, 4, 20), rng.uniform(0.3, 2, 20)])
    y = true[:, :1] * np.exp(-true[:, 1:] * t) + rng.normal(0, 0.01, (20, 30))
    low, high = np.tile([0.0, 0.5], (20, 1)), np.tile([3.0, 5.0], (20, 1))
    p, cost = fitting.least_squares_many(lambda q, of: q[:, :1] * np.exp(-q[:, 1:] * t) - y[of], np.ones((20, 2)), low, high)
    for i in range(20):
        q, c = fitting.least_squares(lambda q, i=i: q[0] * np.exp(-q[1] * t) - y[i], np.ones(2), low[i], high[i])
        assert p[i] == pytest.approx(q, rel=1e-5) and cost[i] == pytest.approx(c, rel=1e-8)


def test_anderson_darling_far_tails_like_sql():
    """Values beyond six deviations: the SQL's sum for the tail decides the seventh digit."""
    import duckdb
    import pandas as pd

    from tidemark import queries
    from tidemark.functions.kernels import anderson_darling_of, normal_tails

    rng = np.random.default_rng(17)
    x = np.round(rng.exponential(50, (40, 70)), 2)
    x[np.arange(40), rng.integers(0, 70, 40)] = np.round(400 + 12 * np.arange(40.0), 2)
    events = pd.DataFrame({"event_id": np.arange(2800), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(2800), unit="min"), "user_id": np.repeat(np.arange(40), 70), "event_type": "view", "value": x.ravel()})  # noqa: F841
    want = dict(duckdb.sql(queries.ORACLE["anderson_darling"]).fetchall())
    digits = lambda v: (lambda y: (lambda unit: math.floor(y * unit + 0.5) / unit)(10.0 ** min(queries.PLACES, queries.DIGITS - 1 - math.floor(math.log10(abs(y))))))(v * queries.STRETCH)
    assert {i: digits(anderson_darling_of(x[i])) for i in range(40)} == want
    low, high = normal_tails(np.array([-30.0, 30.0]))
    assert 0 < low[0] < 1e-190 and low[0] == high[1] and math.isnan(anderson_darling_of(np.ones(5)))
