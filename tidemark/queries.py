"""Queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features as fs
from .operators.binning import Bins, Bootstrap
from .operators.dmdt import DmDt
from .operators.rainbow import RainbowFit
from .operators.reductions import reduce_series, similar
from .operators.parametric import BazinFit, LinexpFit, Periodogram, VillarFit, freq_power
from .plans.planner import extract
from .sources.curves import days, events, long_form, validated, wall
from .streaming.streams import run_once, streaming_bins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Digits that are compared, and decimal places at most.
DIGITS, PLACES = 7, 9
#: Multiplies values before rounding, in Spark and in SQL: averages of values with two decimals would else sit on
#: the border between two rounded values, where the order of a sum decides.
STRETCH = 1.0000123456789

#: The series of events in SQL; :func:`..sources.curves.events` makes the same.
LC = """lc AS (SELECT user_id AS object_id, epoch_us(ts) / 86400000000.0::DOUBLE - 19723.0::DOUBLE AS t, value AS m, 0.05::DOUBLE * value + 0.1::DOUBLE AS sigma, event_type AS band FROM events)"""
ORD = """ord AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY t) AS k, count(*) OVER (PARTITION BY object_id) AS n,
 t - lag(t) OVER (PARTITION BY object_id ORDER BY t) AS dt, m - lag(m) OVER (PARTITION BY object_id ORDER BY t) AS dm FROM lc)"""
ST = """st AS (SELECT object_id, count(*) AS n, avg(m) AS mu, stddev_samp(m) AS sd, var_samp(m) AS va, median(m) AS md, min(m) AS lo, max(m) AS hi,
 sum(1/(sigma*sigma)) AS sw, sum(m/(sigma*sigma))/sum(1/(sigma*sigma)) AS wm, sum(t/(sigma*sigma))/sum(1/(sigma*sigma)) AS wt, avg(t) AS mt FROM lc GROUP BY object_id)"""


def rounded(df: DataFrame, keys: Sequence[str] = ("object_id",), digits: int = DIGITS) -> DataFrame:
    """Doubles rounded to as many digits as the SQL rounds them to."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        x = F.col(f"`{c}`") * F.lit(STRETCH)
        unit = F.pow(F.lit(10.0), F.least(F.lit(PLACES), digits - 1 - F.floor(F.log10(F.abs(x)))).cast("double"))
        return F.when(F.abs(x) < F.lit(10.0**-PLACES), F.lit(0.0)).otherwise(F.floor(x * unit + 0.5) / unit).alias(c)

    return df.select(*[F.col(f"`{c}`") if c in keys or kinds[c] != "double" else one(c) for c in df.columns])


def sql_round(x: str, digits: int = DIGITS) -> str:
    x = f"(({x})::DOUBLE * {STRETCH}::DOUBLE)"
    unit = f"pow(10.0::DOUBLE, least({PLACES}, {digits - 1} - floor(log10(abs(v)))))"
    return f"list_transform([{x}], lambda v: CASE WHEN abs(v) < 1e-{PLACES} THEN 0.0::DOUBLE ELSE floor(v * {unit} + 0.5::DOUBLE) / {unit} END)[1]"


def feature(key: str, *specs: fs.Feature, sql: str | dict[str, str] | None = None, source: str = "lc", ctes: Sequence[str] = (LC,)) -> None:
    """Register an extraction; ``sql`` gives each output's aggregate over ``source`` grouped by object."""
    QUERIES[key] = lambda spark, sf_dir: rounded(extract(events(spark, sf_dir), specs))
    if sql is None:
        return
    names = [n for f in specs for n in f.names()]
    columns = sql if isinstance(sql, dict) else {names[0]: sql}
    assert list(columns) == names, (names, list(columns))
    ORACLE[key] = f"WITH {', '.join(ctes)} SELECT object_id, " + ", ".join(f'{sql_round(x)} AS "{n}"' for n, x in columns.items()) + f" FROM {source} GROUP BY object_id"


J = "lc JOIN st USING (object_id)"
TWO = (LC, ST)
feature("amplitude", fs.Amplitude(), sql="(max(m)-min(m))/2")
feature("mean", fs.Mean(), sql="avg(m)")
feature("median", fs.Median(), sql="median(m)")
feature("stddev", fs.StandardDeviation(), sql="stddev_samp(m)")
feature("mean_variance", fs.MeanVariance(), sql="stddev_samp(m)/avg(m)")
feature("skew", fs.Skew(), sql="skewness(m)")
feature("kurtosis", fs.Kurtosis(), sql="kurtosis(m)")
feature("weighted_mean", fs.WeightedMean(), sql="sum(m/(sigma*sigma))/sum(1/(sigma*sigma))")
feature("reduced_chi2", fs.ReducedChi2(), sql="sum(pow(m-wm,2)/(sigma*sigma))/(count(*)-1)", source=J, ctes=TWO)
feature("excess_variance", fs.ExcessVariance(), sql="(var_samp(m)-avg(sigma*sigma))/pow(avg(m),2)")
feature("stetson_k", fs.StetsonK(), sql="sum(abs((m-wm)/sigma))/sqrt(count(*)*sum(pow((m-wm)/sigma,2)))", source=J, ctes=TWO)
feature("beyond_n_std", fs.BeyondNStd(), fs.BeyondNStd(nstd=2.0), sql={"beyond_1_std": "count(*) FILTER (abs(m-mu) > sd)/count(*)", "beyond_2_std": "count(*) FILTER (abs(m-mu) > 2*sd)/count(*)"}, source=J, ctes=TWO)
feature("percent_amplitude", fs.PercentAmplitude(), sql="greatest(max(m)-median(m), median(m)-min(m))")
feature("median_absolute_deviation", fs.MedianAbsoluteDeviation(), sql="median(abs(m-md))", source=J, ctes=TWO)
feature("median_buffer_range_percentage", fs.MedianBufferRangePercentage(), sql={"median_buffer_range_percentage_10": "count(*) FILTER (abs(md-m) < 0.1::DOUBLE*(hi-lo)/2)/count(*)"}, source=J, ctes=TWO)
feature("roms", fs.Roms(), sql="sum(abs(m-md)/sigma)/(count(*)-1)", source=J, ctes=TWO)
feature("peak_to_peak_var", fs.PeakToPeakVar(), sql="(max(m-sigma)-min(m+sigma))/(max(m-sigma)+min(m+sigma))")
feature("duration", fs.Duration(), sql="max(t)-min(t)")
feature("observation_count", fs.ObservationCount(), sql="count(*)")
feature("time_mean", fs.TimeMean(), sql="avg(t)")
feature("time_stddev", fs.TimeStandardDeviation(), sql="stddev_samp(t)")
O2 = (LC, ORD)
feature("eta", fs.Eta(), sql="sum(dm*dm)/((count(*)-1)*var_samp(m))", source="ord", ctes=O2)
feature("eta_e", fs.EtaE(transform=True), sql="log10(sum(pow(dm/dt,2))*pow(max(t)-min(t),2)/(pow(count(*)-1,3)*var_samp(m)))", source="ord", ctes=O2)
feature("maximum_slope", fs.MaximumSlope(transform=True), sql="log10(max(abs(dm/dt)))", source="ord", ctes=O2)
feature("lafler_kinman", fs.LaflerKinmanStringLength(), sql="(sum(dm*dm)+pow(arg_min(m,t)-arg_max(m,t),2))/(2*count(*)*var_samp(m))", source="ord", ctes=O2)
feature("max_time_interval", fs.MaximumTimeInterval(), sql="max(dt)", source="ord", ctes=O2)
feature("min_time_interval", fs.MinimumTimeInterval(), sql="min(dt)", source="ord", ctes=O2)
CUS = "cus AS (SELECT object_id, sum(m-mu) OVER (PARTITION BY object_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS c, n, sd FROM lc JOIN st USING (object_id))"
feature("cusum", fs.Cusum(), sql="(max(c)-min(c))/(any_value(n)*any_value(sd))", source="cus", ctes=(LC, ST, CUS))
LF = "lf AS (SELECT lc.*, n, wt, wm, sum((t-wt)*(m-wm)/(sigma*sigma)) OVER p / sum(pow(t-wt,2)/(sigma*sigma)) OVER p AS b, sum(pow(t-wt,2)/(sigma*sigma)) OVER p AS sxx FROM lc JOIN st USING (object_id) WINDOW p AS (PARTITION BY object_id))"
feature("linear_fit", fs.LinearFit(), sql={"linear_fit_slope": "any_value(b)", "linear_fit_slope_sigma": "sqrt(1/any_value(sxx))", "linear_fit_reduced_chi2": "sum(pow(m-wm-b*(t-wt),2)/(sigma*sigma))/(any_value(n)-2)"}, source="lf", ctes=(LC, ST, LF))
feature("linear_trend", fs.LinearTrend(), sql={"linear_trend": "regr_slope(m,t)", "linear_trend_sigma": "sqrt((regr_syy(m,t)-pow(regr_sxy(m,t),2)/regr_sxx(m,t))/(count(*)-2)/regr_sxx(m,t))", "linear_trend_noise": "sqrt((regr_syy(m,t)-pow(regr_sxy(m,t),2)/regr_sxx(m,t))/(count(*)-2))"})
PF = """mo AS (SELECT object_id, any_value(n) AS n, any_value(wt) AS wt, any_value(wm) AS wm, sum(w) AS s0, sum(w*pow(x,2)) AS s2, sum(w*pow(x,3)) AS s3, sum(w*pow(x,4)) AS s4, sum(w*x*y) AS y1, sum(w*x*x*y) AS y2
 FROM (SELECT lc.*, n, wt, wm, 1/(sigma*sigma) AS w, t-wt AS x, m-wm AS y FROM lc JOIN st USING (object_id)) GROUP BY object_id),
pa AS (SELECT *, s0*(y2*s2-y1*s3)/(s2*(s4*s0-s2*s2)-s3*s3*s0) AS g FROM mo),
pb AS (SELECT *, (y1-g*s3)/s2 AS b, -g*s2/s0 AS c FROM pa)"""
feature("parabola_fit", fs.ParabolaFit(), sql={"parabola_fit_g": "any_value(g)", "parabola_fit_m0": "any_value(wm+c-b*b/(4*g))", "parabola_fit_reduced_chi2": "sum(pow(m-wm-c-b*(t-wt)-g*pow(t-wt,2),2)/(sigma*sigma))/(any_value(n)-3)"}, source="lc JOIN pb USING (object_id)", ctes=(LC, ST, PF))


def hz(q: float) -> str:
    h = f"least(greatest(len(x)*{q}::DOUBLE+0.5::DOUBLE,1.0::DOUBLE),len(x)::DOUBLE)"
    return f"(x[floor({h})::INT] + ({h}-floor({h}))*(coalesce(x[floor({h})::INT+1], x[floor({h})::INT])-x[floor({h})::INT]))"


SX = "so AS (SELECT object_id, list_sort(list(m)) AS x, median(m) AS md FROM lc GROUP BY object_id)"
one = lambda x: f"any_value({x})"
feature("inter_percentile_range", fs.InterPercentileRange(), fs.InterPercentileRange(quantile=0.1), sql={"inter_percentile_range_25": one(f"{hz(0.75)}-{hz(0.25)}"), "inter_percentile_range_10": one(f"{hz(0.9)}-{hz(0.1)}")}, source="so", ctes=(LC, SX))
feature("magnitude_percentage_ratio", fs.MagnitudePercentageRatio(), sql={"magnitude_percentage_ratio_40_5": one(f"({hz(0.6)}-{hz(0.4)})/({hz(0.95)}-{hz(0.05)})")}, source="so", ctes=(LC, SX))
feature("percent_difference_magnitude_percentile", fs.PercentDifferenceMagnitudePercentile(), sql={"percent_difference_magnitude_percentile_25": one(f"({hz(0.75)}-{hz(0.25)})/md")}, source="so", ctes=(LC, SX))
OT = """sm AS (SELECT object_id, m, row_number() OVER p AS k, count(*) OVER (PARTITION BY object_id) AS n, sum(m) OVER (PARTITION BY object_id) AS whole, sum(m) OVER (p ROWS UNBOUNDED PRECEDING) AS s FROM lc WINDOW p AS (PARTITION BY object_id ORDER BY m)),
cut AS (SELECT object_id, arg_max(k, (round(k/n*(1-k/n)*pow(s/k-(whole-s)/(n-k),2), 6), -k)) AS split FROM sm WHERE k < n GROUP BY object_id)"""
SPLIT = {"otsu_mean_diff": "avg(m) FILTER (k>split)-avg(m) FILTER (k<=split)", "otsu_std_lower": "coalesce(stddev_samp(m) FILTER (k<=split),0)", "otsu_std_upper": "coalesce(stddev_samp(m) FILTER (k>split),0)", "otsu_lower_to_all_ratio": "any_value(split)/any_value(n)"}
feature("otsu_split", fs.OtsuSplit(), sql=SPLIT, source="sm JOIN cut USING (object_id)", ctes=(LC, OT))
feature("otsu_threshold", fs.OtsuThreshold(), sql="min(m) FILTER (k>split)", source="sm JOIN cut USING (object_id)", ctes=(LC, OT))
FD = "fd AS (SELECT *, min(k) FILTER (m > 18*sigma) OVER p AS fd, bool_and(m > 18*sigma) OVER p AS every FROM ord WINDOW p AS (PARTITION BY object_id))"
feature("flux_n_not_det", fs.FluxNNotDetBeforeFd(signal_to_noise=18), sql="CASE WHEN NOT any_value(every) THEN any_value(fd)-1 END", source="fd", ctes=(LC, ORD, FD))
feature("flux_n_not_det_strict", fs.FluxNNotDetBeforeFd(signal_to_noise=18, strictly_fainter=True), sql="CASE WHEN NOT any_value(every) AND any_value(fd) IS NOT NULL THEN count(*) FILTER (k<fd AND 18*sigma<mf) END", source="(SELECT *, max(m) FILTER (k=fd) OVER (PARTITION BY object_id) AS mf FROM fd)", ctes=(LC, ORD, FD))
feature("biweight_scale", fs.BiweightScale(), sql={"biweight_scale_9": "sqrt(any_value(n)*sum(pow(m-md,2)*pow(1-u,4)) FILTER (u<1))/abs(sum((1-u)*(1-5*u)) FILTER (u<1))"}, source="(SELECT *, pow(m-md,2)/(81*mad*mad) AS u FROM lc JOIN st USING (object_id) JOIN (SELECT object_id, median(abs(m-md)) AS mad FROM lc JOIN st USING (object_id) GROUP BY object_id) USING (object_id))", ctes=TWO)
feature("qn_scale", fs.QnScale(), sql="any_value(q)", source="(SELECT object_id, 2.2219::DOUBLE*list_sort(list(abs(a.m-b.m)))[((any_value(n)//2+1)*(any_value(n)//2))//2] AS q FROM ord a JOIN (SELECT object_id, m, k FROM ord) b USING (object_id) WHERE a.k<b.k GROUP BY object_id)", ctes=O2)
QUERIES["magn_n_not_det"] = lambda spark, sf_dir: rounded(extract(events(spark, sf_dir).withColumn("sigma", F.when(F.col("m") > 60, F.lit(float("inf"))).otherwise(F.col("sigma"))), [fs.MagnitudeNNotDetBeforeFd()]))
ORACLE["magn_n_not_det"] = f"WITH {LC}, {ORD} SELECT object_id, {sql_round('CASE WHEN NOT bool_and(m<=60) THEN (min(k) FILTER (m<=60)-1)::DOUBLE END')} AS magn_n_non_detections_before_fd FROM ord GROUP BY object_id"


def lower_gamma(a: str, x: str) -> str:
    """The regularised lower incomplete gamma function, as a sum of positive terms; 1 far above its middle."""
    terms = f"list_sum(list_transform(range(0, ({x} + 40*sqrt({x}+1) + 60)::INT), lambda j: exp(({a}+j)*ln({x}) - {x} - lgamma({a}+j+1))))"
    return f"CASE WHEN {x} <= 0 THEN 0 WHEN {x} > {a} + 40*sqrt({a}) + 200 THEN 1 ELSE least({terms}, 1) END"


CHI = "chi AS (SELECT object_id, (count(*)-1)/2.0::DOUBLE AS a, sum(pow(m-wm,2)/(sigma*sigma))/2 AS x FROM lc JOIN st USING (object_id) GROUP BY object_id)"
feature("chi2_pvar", fs.Chi2Pvar(), sql=f"any_value({lower_gamma('a', 'x')})", source="chi", ctes=(LC, ST, CHI))
# the normal distribution function by the incomplete gamma function of 1/2
AD = f"""az AS (SELECT object_id, n, row_number() OVER (PARTITION BY object_id ORDER BY m) AS k, (m-mu)/sd AS z, pow((m-mu)/sd, 2)/2 AS x, 0.5::DOUBLE AS a FROM lc JOIN st USING (object_id) WHERE sd > 0),
ap AS (SELECT *, 0.5 + sign(z)*({lower_gamma('a', 'x')})/2 AS p FROM az)"""
feature("anderson_darling", fs.AndersonDarlingNormal(), sql="(-any_value(n) - sum((2*k-1)*ln(p) + (2*(n-k)+1)*ln(1-p))/any_value(n))*(1+4/any_value(n)-25/pow(any_value(n),2))", source="ap", ctes=(LC, ST, AD))

BANDS = ("view", "click", "purchase")
of = lambda x, b: f"{x} FILTER (band='{b}')"
feature("color_of_maximum", fs.ColorOfMaximum(bands=BANDS[:2]), sql={"color_max_view_click": f"{of('max(m)', 'view')}-{of('max(m)', 'click')}"})
feature("color_of_median", fs.ColorOfMedian(bands=BANDS[:2]), sql={"color_median_view_click": f"{of('median(m)', 'view')}-{of('median(m)', 'click')}"})
feature("color_of_minimum", fs.ColorOfMinimum(bands=BANDS[:2]), sql={"color_min_view_click": f"{of('min(m)', 'view')}-{of('min(m)', 'click')}"})
wmb = [f"({of('sum(m/(sigma*sigma))', b)}/{of('sum(1/(sigma*sigma))', b)})" for b in BANDS]
cen = f"(({' + '.join(wmb)})/3)"
feature("color_spread", fs.ColorSpread(bands=BANDS), sql={"color_spread_view_click_purchase": f"sqrt(({' + '.join(f'pow({x}-{cen},2)' for x in wmb)})/3)"})
per = {f"{n}_{b}": of(x, b) for n, x in (("amplitude", "(max(m)"), ("mean", "avg(m)"), ("standard_deviation", "stddev_samp(m)")) for b in BANDS}
per |= {f"amplitude_{b}": f"({of('max(m)', b)}-{of('min(m)', b)})/2" for b in BANDS}
feature("per_band_extractor", fs.Extractor(features=(fs.Amplitude(bands=BANDS), fs.Mean(bands=BANDS), fs.StandardDeviation(bands=BANDS))), sql=per)
feature("mixed_extractor", fs.Extractor(features=(fs.Mean(), fs.Mean(bands=("click", "view")), fs.ColorOfMaximum(bands=BANDS[:2]), fs.Duration())), sql={"mean": "avg(m)", "mean_click": of("avg(m)", "click"), "mean_view": of("avg(m)", "view"), "color_max_view_click": f"{of('max(m)', 'view')}-{of('max(m)', 'click')}", "duration": "max(t)-min(t)"})
for t, x in (("arcsinh", "asinh(avg(m))"), ("clipped_lg", "log10(avg(m))"), ("identity", "avg(m)"), ("lg", "log10(avg(m))"), ("ln1p", "ln(1+avg(m))"), ("sqrt", "sqrt(avg(m))")):
    feature(f"transform_{t}", fs.Mean(transform=t), sql=x)
FLAGSHIP = (fs.Amplitude(), fs.Mean(), fs.StandardDeviation(), fs.Eta())
feature("flagship", *FLAGSHIP, sql={"amplitude": "(max(m)-min(m))/2", "mean": "avg(m)", "standard_deviation": "stddev_samp(m)", "eta": "sum(dm*dm)/((count(*)-1)*var_samp(m))"}, source="ord", ctes=O2)

# Meta-features, maps, reductions: tables of their own
BIN = f"""bin AS (SELECT object_id, (floor((t-0.5)/2)+0.5)*2+0.5 AS t, sum(m/(sigma*sigma))/sum(1/(sigma*sigma)) AS m, sqrt(count(*)/sum(1/(sigma*sigma))) AS sigma FROM lc GROUP BY object_id, floor((t-0.5)/2))"""
feature("bins_extractor", Bins(features=(fs.Amplitude(), fs.Mean(), fs.ObservationCount(), fs.WeightedMean()), window=2.0, offset=0.5), sql={f"bins_window2.0_offset0.5_{n}": x for n, x in (("amplitude", "(max(m)-min(m))/2"), ("mean", "avg(m)"), ("observation_count", "count(*)"), ("weighted_mean", "sum(m/(sigma*sigma))/sum(1/(sigma*sigma))"))}, source="bin", ctes=(LC, BIN))
DRAW = "[(b*1000003 + i*7919 + 326532) % 2147483647]"
for _ in range(3):
    DRAW = f"list_transform({DRAW}, lambda x: (x*48271 + 11) % 2147483647)"
    DRAW = f"list_transform({DRAW}, lambda x: (x*x + x) % 2147483647)"
feature("bootstrap", Bootstrap(features=(fs.Mean(), fs.Amplitude()), n_bootstrap=20, seed=3), sql={"bootstrap_mean": "any_value(v0)", "bootstrap_amplitude": "any_value(v1)", "bootstrap_mean_sigma": "stddev_samp(b0)", "bootstrap_amplitude_sigma": "stddev_samp(b1)"}, source="many JOIN (SELECT object_id, avg(m) AS v0, (max(m)-min(m))/2 AS v1 FROM lc GROUP BY object_id) USING (object_id)", ctes=(LC, ORD, f"""many AS (SELECT object_id, b, avg(m) AS b0, (max(m)-min(m))/2 AS b1 FROM (SELECT o.object_id, b, {DRAW}[1] % n AS pos FROM (SELECT object_id, k-1 AS i, n FROM ord) o, range(1, 21) r(b)) d JOIN ord USING (object_id) WHERE ord.k = pos + 1 GROUP BY object_id, b)"""))
MAP = DmDt.from_borders(-1.0, 1.5, 300.0, 5, 6)
PAIRS = """cells AS (SELECT object_id, floor((log10(dt)+1.0::DOUBLE)/(2.5::DOUBLE/5))::INT AS i, CASE WHEN dm >= -300 AND dm < 300 THEN floor((dm+300)/100)::INT END AS j
 FROM (SELECT a.object_id, b.t-a.t AS dt, b.m-a.m AS dm FROM lc a JOIN lc b ON a.object_id=b.object_id AND a.t<b.t) WHERE dt >= 0.1::DOUBLE AND dt < pow(10::DOUBLE, 1.5::DOUBLE))"""
QUERIES["dmdt_points"] = lambda spark, sf_dir: rounded(MAP.points(events(spark, sf_dir)))
ORACLE["dmdt_points"] = f"WITH {LC}, {PAIRS} SELECT object_id, i, j, {sql_round('count(*)')} AS v FROM cells WHERE j IS NOT NULL GROUP BY object_id, i, j"
QUERIES["dmdt_count_dt"] = lambda spark, sf_dir: MAP.count_dt(events(spark, sf_dir))
ORACLE["dmdt_count_dt"] = f"WITH {LC}, {PAIRS} SELECT object_id, i, count(*) AS n FROM cells GROUP BY object_id, i"
NORM = "by_dt AS (SELECT object_id, i, j, count(*) / sum(count(*)) OVER (PARTITION BY object_id, i) AS v FROM cells GROUP BY object_id, i, j)"
QUERIES["dmdt_norm_dt"] = lambda spark, sf_dir: rounded(replace(MAP, norm=("dt",)).points(events(spark, sf_dir)))
ORACLE["dmdt_norm_dt"] = f"WITH {LC}, {PAIRS}, {NORM} SELECT object_id, i, j, {sql_round('v')} AS v FROM by_dt WHERE j IS NOT NULL"
QUERIES["dmdt_norm_max"] = lambda spark, sf_dir: rounded(replace(MAP, norm=("dt", "max")).points(events(spark, sf_dir)))
ORACLE["dmdt_norm_max"] = f"WITH {LC}, {PAIRS}, {NORM} SELECT object_id, i, j, {sql_round('v / max(v) OVER (PARTITION BY object_id)')} AS v FROM by_dt WHERE j IS NOT NULL"
QUERIES["dmdt_gausses"] = lambda spark, sf_dir: MAP.gausses(events(spark, sf_dir))

# Numeric kernels: no SQL
feature("periodogram_peaks", Periodogram(peaks=2, fast=False))
feature("periodogram_fast", Periodogram(peaks=1, fast=True))
feature("periodogram_phase_features", Periodogram(features=("standard_deviation", "beyond_1_std"), phase_features=("lafler_kinman_string_length", "amplitude")))
feature("periodogram_multiband", Periodogram(bands=BANDS, fast=False))
GRID = """gr AS (SELECT object_id, count(*) AS n, avg(m) AS mu, stddev_samp(m) AS sd, 2*pi()/(10*(max(t)-min(t))) AS step, ceil(pi()*(count(*)-1)/(max(t)-min(t))*0.2::DOUBLE/(2*pi()/(10*(max(t)-min(t)))))::INT AS top FROM lc GROUP BY object_id HAVING count(*) > 2 AND max(t) > min(t)),
fr AS (SELECT object_id, n, mu, sd, unnest(range(1, greatest(top, 1)+1)) * step AS omega FROM gr),
su AS (SELECT object_id, omega, any_value(n) AS n, sum(cos(omega*t)*cos(omega*t)) AS cc, sum(sin(omega*t)*sin(omega*t)) AS ss, sum(cos(omega*t)*sin(omega*t)) AS cs, sum(cos(omega*t)*(m-mu)/sd) AS yc, sum(sin(omega*t)*(m-mu)/sd) AS ys FROM fr JOIN lc USING (object_id) GROUP BY object_id, omega),
ta AS (SELECT *, atan2(2*cs, cc-ss)/2 AS tau FROM su),
po AS (SELECT object_id, omega, n, pow(yc*cos(tau)+ys*sin(tau),2) AS a, cos(tau)*cos(tau)*cc+2*cos(tau)*sin(tau)*cs+sin(tau)*sin(tau)*ss AS b, pow(ys*cos(tau)-yc*sin(tau),2) AS c, cos(tau)*cos(tau)*ss-2*cos(tau)*sin(tau)*cs+sin(tau)*sin(tau)*cc AS d FROM ta)"""
ORACLE["periodogram_freq_power"] = f"WITH {LC}, {GRID} SELECT object_id, {sql_round('omega')} AS omega, {sql_round('(CASE WHEN b > 1e-12*n THEN a/b ELSE 0 END + CASE WHEN d > 1e-12*n THEN c/d ELSE 0 END)/2')} AS power FROM po"
QUERIES["periodogram_freq_power"] = lambda spark, sf_dir: rounded(freq_power(events(spark, sf_dir), Periodogram(fast=False, max_freq_factor=0.2)))
feature("bazin_fit", BazinFit(mcmc_niter=16))
feature("linexp_fit", LinexpFit(mcmc_niter=16))
feature("villar_fit", VillarFit(mcmc_niter=16, transform=True))
for how in ("beginning", "end", "middle", "non-overlapping-windows"):
    key = "windows_non_overlapping" if "-" in how else f"reduction_{how}"

    def reduction(spark, sf_dir, how=how):
        cut = reduce_series(events(spark, sf_dir), 20, how)
        mean = F.aggregate("lc", F.lit(0.0), lambda s, x: s + x["m"]) / F.size("lc")
        return rounded(cut.select("object_id", "step", F.size("lc").cast("long").alias("n_obs"), mean.alias("mean_m"), F.col("lc")[0]["t"].alias("first_t")))

    QUERIES[key] = reduction
    part = {"beginning": ("0", "k<=20"), "end": ("0", "k>n-20"), "middle": ("0", "k>greatest(0,least(n//2-10,n-20)) AND k<=greatest(0,least(n//2-10,n-20))+20"), "non-overlapping-windows": ("(k-1)//20", "true")}[how]
    ORACLE[key] = f"WITH {LC}, {ORD} SELECT object_id, ({part[0]})::INT AS step, count(*) AS n_obs, {sql_round('avg(m)')} AS mean_m, {sql_round('min(t)')} AS first_t FROM ord WHERE {part[1]} GROUP BY object_id, ({part[0]})::INT"

QUERIES["embedding_topk"] = lambda spark, sf_dir: (lambda e: rounded(similar(e, e.where("vec_id % 50 = 0"), 5), ("query_id", "rank", "vec_id")))(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
ORACLE["embedding_topk"] = f"""SELECT query_id, rank::INT AS rank, vec_id, {sql_round('c')} AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) AS c FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 5"""
QUERIES["validate"] = lambda spark, sf_dir: validated(events(spark, sf_dir)).groupBy("object_id").agg(F.count(F.lit(1)).alias("n_valid"))
ORACLE["validate"] = "SELECT user_id AS object_id, count(*) AS n_valid FROM events GROUP BY user_id"


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as series of a supplier, equal days averaged."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return validated(long_form(df, "l_suppkey", days(F.col("l_shipdate")), "l_extendedprice", F.lit(10.0), "l_returnflag"), duplicates="mean")


QUERIES["duplicates_mean"] = lambda spark, sf_dir: rounded(extract(supplier_series(spark, sf_dir), [fs.Mean(), fs.ObservationCount(), fs.Eta(bands=("A", "N"))]))
SUP = "day AS (SELECT l_suppkey AS object_id, l_returnflag AS band, epoch_us(l_shipdate)/86400000000.0::DOUBLE AS t, avg(l_extendedprice::DOUBLE) AS m FROM lineitem GROUP BY 1,2,3), stp AS (SELECT *, m - lag(m) OVER (PARTITION BY object_id, band ORDER BY t) AS dm FROM day)"
ORACLE["duplicates_mean"] = f"WITH {SUP} SELECT object_id, {sql_round('avg(m)')} AS mean, {sql_round('count(*)')} AS observation_count, " + ", ".join(f"""{sql_round(f"sum(dm*dm) FILTER (band='{b}')/((count(*) FILTER (band='{b}')-1)*var_samp(m) FILTER (band='{b}'))")} AS "eta_{b}" """ for b in "AN") + " FROM stp GROUP BY object_id"
QUERIES["few_observations"] = lambda spark, sf_dir: rounded(extract(long_form(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", days(F.col("o_orderdate")), "o_totalprice").groupBy("object_id", "t").agg(F.avg("m").alias("m"), F.lit(1.0).alias("sigma"), F.lit(None).cast("string").alias("band")), [fs.Kurtosis(), fs.Skew(), fs.ObservationCount()], fill=-1.0))
ORACLE["few_observations"] = f"WITH o AS (SELECT o_custkey AS object_id, o_orderdate AS t, avg(o_totalprice::DOUBLE) AS m FROM orders GROUP BY 1, 2) SELECT object_id, {sql_round('coalesce(CASE WHEN count(*)>=4 THEN kurtosis(m) END, -1)')} AS kurtosis, {sql_round('coalesce(CASE WHEN count(*)>=3 THEN skewness(m) END, -1)')} AS skew, {sql_round('count(*)')} AS observation_count FROM o GROUP BY object_id"
RAINBOW = RainbowFit.from_angstrom({"view": 4770.0, "click": 6231.0, "purchase": 7625.0}, with_baseline=False, bolometric="sigmoid", temperature="constant")
QUERIES["rainbow_fit"] = lambda spark, sf_dir: extract(events(spark, sf_dir), [RAINBOW])


def binned_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events read as a stream and binned by day, all that is there."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("user_id").alias("object_id"), wall(F.col("ts")).alias("ts"), F.col("value").alias("m"), (F.lit(0.05) * F.col("value") + F.lit(0.1)).alias("sigma"))
    return rounded(run_once(streaming_bins(rows, "1 day"), "binned_stream", "complete").select("object_id", F.unix_micros("start").alias("start_us"), "m", "sigma", "n"))


QUERIES["streaming_bins"] = binned_stream
ORACLE["streaming_bins"] = f"WITH {LC} SELECT object_id, ((floor(t)+19723)*86400000000)::BIGINT AS start_us, {sql_round('sum(m/(sigma*sigma))/sum(1/(sigma*sigma))')} AS m, {sql_round('sqrt(count(*)/sum(1/(sigma*sigma)))')} AS sigma, count(*) AS n FROM lc GROUP BY object_id, floor(t)"

# Whole catalogues in one extraction, for the benchmark and for SQL
TIMES = (fs.Duration(), fs.MaximumTimeInterval(), fs.MinimumTimeInterval(), fs.ObservationCount(), fs.TimeMean(), fs.TimeStandardDeviation())
feature("time_sampling_features", *TIMES, sql={"duration": "max(t)-min(t)", "maximum_time_interval": "max(dt)", "minimum_time_interval": "min(dt)", "observation_count": "count(*)", "time_mean": "avg(t)", "time_standard_deviation": "stddev_samp(t)"}, source="ord", ctes=O2)
feature("linear_features", fs.LinearFit(), fs.LinearTrend(), fs.ParabolaFit())


def joined(*parts: tuple[str, str]) -> str:
    """SQL of several queries side by side; parts are (columns, SQL by object)."""
    return "SELECT object_id, " + ", ".join(c for c, _ in parts) + " FROM " + " JOIN ".join(f"({x}) AS p{k}" + (" USING (object_id)" if k else "") for k, (_, x) in enumerate(parts))


ORACLE["linear_features"] = joined(*[(", ".join(f.names()), ORACLE[q]) for q, f in (("linear_fit", fs.LinearFit()), ("linear_trend", fs.LinearTrend()), ("parabola_fit", fs.ParabolaFit()))])
VARIABILITY = (
    fs.Amplitude(), fs.AndersonDarlingNormal(), fs.BeyondNStd(), fs.BiweightScale(), fs.Chi2Pvar(), fs.Cusum(), fs.Eta(), fs.EtaE(), fs.ExcessVariance(), fs.InterPercentileRange(), fs.Kurtosis(),
    fs.LaflerKinmanStringLength(), fs.MagnitudePercentageRatio(), fs.MaximumSlope(), fs.Mean(), fs.MeanVariance(), fs.Median(), fs.MedianAbsoluteDeviation(), fs.MedianBufferRangePercentage(), fs.OtsuSplit(),
    fs.PercentAmplitude(), fs.PercentDifferenceMagnitudePercentile(), fs.QnScale(), fs.ReducedChi2(), fs.Roms(), fs.Skew(), fs.StandardDeviation(), fs.StetsonK(), fs.WeightedMean(),
)
feature("all_variability_features", *VARIABILITY)
RAW = f"WITH {LC}, {ORD} SELECT object_id, {sql_round('sum(pow(dm/dt,2))*pow(max(t)-min(t),2)/(pow(count(*)-1,3)*var_samp(m))')} AS eta_e, {sql_round('max(abs(dm/dt))')} AS maximum_slope FROM ord GROUP BY object_id"
#: Where each feature's SQL stands; those of two have none of their own.
WHERE = {"standard_deviation": "stddev", "beyond_1_std": "beyond_n_std", "lafler_kinman_string_length": "lafler_kinman", "anderson_darling_normal": "anderson_darling"}


def variability_sql() -> str:
    parts: dict[str, list[str]] = {}
    for f in VARIABILITY:
        for n in f.names():
            key = type(f).__name__ if type(f).__name__ in ("EtaE", "MaximumSlope") else WHERE.get(n) or (n if n in ORACLE else fs.snake(type(f).__name__))
            parts.setdefault(key, []).append(n)
    raw = [n for k in ("EtaE", "MaximumSlope") for n in parts.pop(k)]
    return joined((", ".join(raw), RAW), *[(", ".join(f'"{n}"' for n in names), ORACLE[k]) for k, names in parts.items()])


ORACLE["all_variability_features"] = variability_sql()
