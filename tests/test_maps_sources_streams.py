"""dm-dt maps, sources, reductions, embeddings, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fitting
from tidemark.functions.kernels import gamma_p, qn_of
from tidemark.operators.dmdt import DmDt, Grid
from tidemark.operators.embedding import embed
from tidemark.operators import reductions
from tidemark.operators.reductions import mask, padded, reduce_series, similar
from tidemark.sources.curves import from_nested, long_form, problems, to_nested, validated
from tidemark.streaming.streams import count_windows, mergeable, run_once, streaming_bins, streaming_features

SCHEMA = "object_id long, t double, m double, sigma double, band string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def dense(cells, shape):
    out = np.zeros(shape)
    for r in cells.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_dmdt_points(spark):
    df = table(spark, [(1, float(x), float(x), 1.0, None) for x in range(3)])
    d = DmDt.of([0.5, 1.5, 2.5], [-2, -1, 0, 1.5, 3.0])
    assert dense(d.points(df), d.shape).tolist() == [[0, 0, 2, 0], [0, 0, 0, 1]]
    assert [r["n"] for r in d.count_dt(df).orderBy("i").collect()] == [2, 1]
    assert d.packed(d.points(df)).first()["map"] == [[0, 0, 2, 0], [0, 0, 0, 1]]
    assert len(list(d.batches(df, 2))) == 1


def test_dmdt_random(spark):
    rng = np.random.default_rng(0)
    t, m = np.sort(rng.uniform(0, 10, 40)), rng.normal(size=40)
    df = table(spark, [(1, float(a), float(b), 0.1, None) for a, b in zip(t, m, strict=True)])
    i, j = np.triu_indices(40, 1)
    d = DmDt.from_borders(-1, 1, 2, 4, 5)
    want = np.histogram2d(t[j] - t[i], m[j] - m[i], [d.dt.edges, d.dm.edges])[0]
    assert dense(d.points(df), d.shape).tolist() == want.tolist()
    smeared = np.array(d.gausses(df).first()["map"])
    assert smeared.shape == d.shape and smeared.sum() <= len(i) and smeared.sum() == pytest.approx(want.sum(), rel=0.05)
    with pytest.raises(ValueError):
        Grid.of([1, 1])
    assert Grid.of([1, 10, 100]).kind == "log" and Grid.of([0, 1, 2]).kind == "linear" and Grid.of([0, 1, 5]).kind == "asis"


def test_nested_and_validation(spark):
    rows = [(1, 0.0, 1.0, 0.1, "g"), (1, 1.0, 2.0, 0.1, "r"), (2, 0.5, 3.0, 0.2, "g")]
    df = table(spark, rows)
    again = from_nested(to_nested(df), "object_id")
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    with pytest.raises(TypeError):
        from_nested(df, "object_id", "m")
    with pytest.raises(ValueError):
        from_nested(to_nested(df), "object_id", fields={"t": "t", "m": "x"})
    with pytest.raises(ValueError):
        long_form(df, "object_id", "t", "t")
    assert validated(df).count() == 3
    bad = table(spark, [*rows, (1, 0.0, 5.0, 0.1, "g"), (3, float("nan"), 1.0, 0.1, "g"), (4, 1.0, None, 0.1, "g")])
    assert {r["reason"] for r in problems(bad).collect()} == {"repeated time", "time is not finite", "null"}
    twice = table(spark, [*rows, (1, 0.0, 5.0, 0.1, "g")])
    with pytest.raises(Exception, match="strictly ascending"):
        validated(twice).collect()
    assert {r["m"] for r in validated(twice, "mean").where("object_id = 1 and t = 0").collect()} == {3.0}
    with pytest.raises(Exception, match="unknown band"):
        validated(df, bands=["g"]).collect()
    assert validated(df, bands=["g"], unknown="ignore").count() == 2


@pytest.mark.parametrize("how, want", [("beginning", [[0, 1, 2]]), ("end", [[4, 5, 6]]), ("middle", [[2, 3, 4]]), ("non-overlapping-windows", [[0, 1, 2], [3, 4, 5], [6]])])
def test_reductions(spark, how, want):
    df = table(spark, [(1, float(k), float(k), 1.0, None) for k in range(7)])
    got = [[x["t"] for x in r["lc"]] for r in reduce_series(df, 3, how).orderBy("step").collect()]
    assert got == want


def test_random_subsample_and_padding(spark):
    df = table(spark, [(1, float(k), float(k), 1.0, None) for k in range(7)])
    t = [x["t"] for x in reduce_series(df, 4, "random-subsample", seed=3).first()["lc"]]
    assert len(set(t)) == 4 and t == sorted(t)
    row = reduce_series(df, 9, "end").select(padded(F.col("lc"), 9, "m").alias("m"), mask(F.col("lc"), 9).alias("k")).first()
    assert row["m"] == [0, 1, 2, 3, 4, 5, 6, 0, 0] and row["k"] == [True] * 7 + [False] * 2


def test_similar_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(k, r.normal(size=4).tolist()) for k in range(30)], "vec_id long, embedding array<double>")
    want = sorted(similar(df, df.where("vec_id % 2 = 0"), 3).collect())
    monkeypatch.setattr(reductions, "QUERY_BLOCK", 4)
    assert sorted(similar(df, df.where("vec_id % 2 = 0"), 3).collect()) == want and len(want) == 45


def test_similar_beyond_one_block(spark):
    many = spark.range(10_001).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    assert similar(many.where("vec_id < 3"), many, 1).count() == 10_001


#: Tensors that published sessions ask for: name, shape after the subsamples, type.
INPUTS = {
    "astromer1": {"times": (200, 1), "input": (200, 1), "mask_in": (200, 1)},
    "atcat": {"flux": (243,), "flux_err": (243,), "time": (243,), "mask": (243,), "channel_index": (243,)},
    "atat": {"data": (65, 6), "time": (65, 6), "mask": (65, 6)},
    "astra_clr": {"input": (700, 1), "times": (700, 1), "band_info": (700, 1), "mask": (700,)},
    "moment1_small": {"context": (512,)},
    "chronos_bolt_tiny": {"context": (16,)},
}


class StrictSession:
    """Refuses tensors that the model doesn't ask for; gives a row per subsample: the sum of one tensor."""

    def __init__(self, model, tensor):
        self.model, self.tensor = model, tensor

    def __call__(self):
        return self

    def run(self, outputs, inputs):
        n = len(next(iter(inputs.values())))
        assert {k: v.shape for k, v in inputs.items()} == {k: (n, *v) for k, v in INPUTS[self.model].items()}
        x = inputs[self.tensor].reshape(n, -1).astype(np.float64)
        return [np.repeat(np.nansum(x, 1)[:, None], 4, 1).astype(np.float32)]


def test_embedding(spark):
    df = table(spark, [(1, float(k), float(k), 1.0, "g" if k % 2 else "r") for k in range(6)])
    assert embed(df, "moment1_small", StrictSession("moment1_small", "context")).first()["embedding"] == [15.0] * 4
    bolt = StrictSession("chronos_bolt_tiny", "context")
    two = {r["band"]: r["embedding"][0] for r in embed(df, "chronos_bolt_tiny", bolt, bands=["g", "r"]).collect()}
    assert two == {"g": 9.0, "r": 6.0}
    with pytest.raises(ValueError):
        embed(df, "atcat", StrictSession("atcat", "flux"), band_groups=[{"g": "g"}])
    numbers = embed(df, "atcat", StrictSession("atcat", "channel_index"), band_groups=[{"r": "g"}], allow_extra_bands=True)
    assert [r["embedding"][0] for r in numbers.collect()] == [6.0]  # three observations in the model's band 2
    assert [r["embedding"][0] for r in embed(df, "atcat", StrictSession("atcat", "mask")).collect()] == [6.0]
    with pytest.raises(Exception, match="no band"):
        embed(df.withColumn("band", F.lit("x")), "atcat", StrictSession("atcat", "mask")).collect()


def test_embedding_inputs(spark):
    """Names, shapes and contents of what every kind of model is given, several subsamples at a time."""
    df = table(spark, [(1, 58000.0 + k, 20.0 + k % 3, 0.1, "gri"[k % 3]) for k in range(450)] + [(2, 58001.0, 20.0, 0.1, "g")])
    seen = embed(df, "astromer1", StrictSession("astromer1", "mask_in")).orderBy("object_id", "step").collect()
    assert [(r["object_id"], r["step"], r["embedding"][0]) for r in seen] == [(1, 0, 200.0), (1, 1, 200.0), (1, 2, 50.0), (2, 0, 1.0)]
    clr = {t: embed(df, "astra_clr", StrictSession("astra_clr", t)).orderBy("object_id").collect() for t in INPUTS["astra_clr"]}
    assert [r["embedding"][0] for r in clr["mask"]] == [700 - 150 - 150 - 50, 699] and [r["embedding"][0] for r in clr["input"]] == [0, 0]
    waves = [150 * np.log10(4746.48) + 150 * np.log10(6366.38) + 50 * np.log10(7829.03), np.log10(4746.48)]
    assert [r["embedding"][0] for r in clr["band_info"]] == pytest.approx(waves, rel=1e-6)
    times = sum(3 * k for k in range(150)) + sum(3 * k + 1 for k in range(150)) + sum(3 * k + 2 for k in range(50))
    assert [r["embedding"][0] for r in clr["times"]] == [times, 1.0]
    assert [r["embedding"][0] for r in embed(df, "atat", StrictSession("atat", "mask")).orderBy("object_id", "step").collect()] == [65 * 3, 65 * 3, 20 * 3, 1]


class SpanSession:
    """First and last value, and how many there are, of the band at place 1 (atat) or the first block (astra_clr)."""

    def run(self, outputs, inputs):
        out = []
        for k in range(len(inputs["mask"])):
            own = inputs["data"][k, inputs["mask"][k, :, 1] > 0, 1] if "data" in inputs else inputs["times"][k, :300][inputs["mask"][k, :300] == 0, 0] + 58000
            out.append([own[0], own[-1], len(own)] if len(own) else [0, 0, 0])
        return [np.array(out, np.float32)]


def test_embedding_reduces_each_band(spark):
    """A crowded band: its own last observations, and all of its windows, reach the model."""
    df = table(spark, [(1, 58000.0 + k, float(k), 1.0, "g") for k in range(800)] + [(1, 58000.5, 5.0, 1.0, "r")])
    scale = 10 ** (-0.4 * (31.4 - 27.5))
    end = embed(df, "atat", SpanSession, reduction="end").collect()
    assert [r["embedding"] for r in end] == [pytest.approx([735 * scale, 799 * scale, 65], rel=1e-5)]
    windows = embed(df, "atat", SpanSession, reduction="non-overlapping-windows").collect()
    assert sorted(r["step"] for r in windows) == list(range(13)) and sum(r["embedding"][2] for r in windows) == 800
    times = embed(df, "astra_clr", SpanSession, reduction=["non-overlapping-windows", "end"]).orderBy("step").collect()
    assert [r["embedding"] for r in times] == [[58000, 58299, 300], [58300, 58599, 300], [58600, 58799, 200], [58500, 58799, 300]]


def test_streams(spark, tmp_path):
    rows = [(k % 2, f"2024-01-0{1 + k // 4} 0{k % 4}:00:00", float(k), 0.5) for k in range(8)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "object_id long, ts string, m double, sigma double").select("object_id", F.to_timestamp("ts").alias("ts"), "m", "sigma").withColumn("t", F.unix_micros("ts") / 86.4e9).write.parquet(path)
    stream = lambda: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = run_once(streaming_bins(stream(), "1 day"), "bins_test", "complete").collect()
    assert sorted((r["object_id"], r["n"], r["m"]) for r in got) == [(0, 2, 1.0), (0, 2, 5.0), (1, 2, 2.0), (1, 2, 6.0)]
    run = {r["object_id"]: r["amplitude"] for r in run_once(streaming_features(stream(), ["amplitude"]), "features_test", "complete").collect()}
    assert run == {0: 3.0, 1: 3.0}
    full = run_once(count_windows(stream(), 3), "count_test").collect()
    assert sorted((r["object_id"], r["n"], r["mean"]) for r in full) == [(0, 3, 2.0), (1, 3, 3.0)]


def test_kernels():
    assert gamma_p(1.0, 2.0) == pytest.approx(1 - np.exp(-2)) and gamma_p(0.5, 0.5) == pytest.approx(0.6826894921)
    x = np.random.default_rng(0).normal(size=3000)
    assert qn_of(x) == pytest.approx(1.0, rel=0.05)
    i, j = np.triu_indices(301, 1)
    y = np.sort(x[:301])
    h = 301 // 2 + 1
    assert qn_of(y) == pytest.approx(2.2219 * np.sort(y[j] - y[i])[h * (h - 1) // 2 - 1])


def test_priors():
    p = fitting.mix([(1.0, fitting.normal(0, 1)), (3.0, fitting.uniform(0, 2))])
    want = 0.25 * np.exp(fitting.normal(0, 1)(1.0)) + 0.75 * 0.5
    assert np.exp(p(1.0)) == pytest.approx(want)
    assert fitting.log_uniform(1, np.e)(0.5) == -np.inf and fitting.none()(3.0) == 0 and np.isfinite(fitting.log_normal(0, 1)(2.0))


def test_problems_agree_with_validation(spark):
    """Equal times of different bands are legal, within a band they aren't; which row stays is repeatable."""
    df = table(spark, [(1, 1.0, 2.0, 0.1, "g"), (1, 1.0, 3.0, 0.1, "r"), (2, 1.0, 2.0, 0.1, "g"), (2, 1.0, 1.0, 0.1, "g")])
    assert [(r["object_id"], r["m"], r["reason"]) for r in problems(df).collect()] == [(2, 1.0, "repeated time")]
    assert validated(df.where("object_id = 1")).count() == 2
    with pytest.raises(Exception, match="ascending"):
        validated(df).collect()
    assert [r["m"] for r in validated(df, duplicates="keep_first").where("object_id = 2").collect()] == [1.0]


def test_running_chi_square_keeps_its_digits(spark):
    rng = np.random.default_rng(6)
    m, sigma = 20 + 1e-4 * rng.normal(size=500), rng.uniform(0.5e-4, 2e-4, 500)
    df = table(spark, [(1, float(k), float(a), float(s), None) for k, (a, s) in enumerate(zip(m, sigma, strict=True))])
    w = sigma**-2
    mean = (w * m).sum() / w.sum()
    got = df.groupBy("object_id").agg(mergeable()["reduced_chi2"].alias("x")).first()["x"]
    assert got == pytest.approx((w * (m - mean) ** 2).sum() / 499, rel=1e-6)


def test_similar_is_scored_by_products_of_tiles(spark, monkeypatch):
    """No join of rows with queries; ties, nulls, other lengths and repeated ids rank as in pairs scored one by one."""
    import math

    rng = np.random.default_rng(6)
    x = [[float(v) for v in rng.integers(-3, 4, 4)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(x) if any(v)] + [(100, x[3]), (101, x[3]), (102, None), (103, [1.0, 2.0]), (104, [1.0, None, 2.0, 3.0]), (105, x[3]), (105, x[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(reductions, "TILE_ROWS", 7)
    monkeypatch.setattr(reductions, "TILE_QUERIES", 5)
    got = similar(df, df.where("vec_id % 3 = 0"), 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan

    def cosine(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        dot = lambda p, q: sum(i * j for i, j in zip(p, q, strict=True))
        return round(dot(a, b) / math.sqrt(dot(a, a)) / math.sqrt(dot(b, b)), 9)

    want = []
    for who in sorted({i for i, _ in rows if i % 3 == 0}):
        pairs = [(cosine(q, v), i) for j, q in rows if j == who for i, v in rows if i != who]
        pairs.sort(key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))
        want += [(who, rank, i, c) for rank, (c, i) in enumerate(pairs[:4], 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["cosine"]) for r in got.collect()) == want


def test_a_stream_that_ran_once_is_not_held_by_the_driver(spark, tmp_path):
    """Rows come from files, in complete and append mode and where there is nothing to read."""
    path = str(tmp_path / "in")
    rows = spark.range(100).select((F.col("id") % 5).alias("object_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("m"), F.lit(1.0).alias("sigma"))
    rows.repartition(3).write.parquet(path)
    stream = lambda p: spark.readStream.option("maxFilesPerTrigger", 1).schema(rows.schema).parquet(p)
    got = run_once(streaming_bins(stream(path), "1 day", lateness="100 days"), "files_test", "complete")
    assert got.inputFiles() and sum(r["n"] for r in got.collect()) == 100 and spark.table("files_test").count() == got.count() == 24
    every = run_once(stream(path), "append_test")
    assert every.inputFiles() and every.count() == 100
    (tmp_path / "none").mkdir()
    assert run_once(stream(str(tmp_path / "none")), "none_test").count() == 0


def test_validation_deals_large_tables_into_more_partitions(spark, tmp_path, monkeypatch):
    from tidemark.sources import curves

    path = str(tmp_path / "rows")
    spark.range(20_000).selectExpr("id % 500 object_id", "double(id) t", "double(id) m", "1d sigma", "'g' band").write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(curves, "PARTITION_BYTES", 4 << 10)
    out = validated(df, duplicates="mean")
    assert out.rdd.getNumPartitions() > 20 and out.count() == 20_000
