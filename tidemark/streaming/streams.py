"""Series as streams: binned and mergeable features with watermarks, and windows of a count of observations."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import div


def without_repeats(stream: DataFrame, ts: str = "ts", key: str = "object_id", lateness: str = "1 hour") -> DataFrame:
    """Of equal times of an object one row stays, as long as the watermark remembers it."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key, ts])


def streaming_bins(stream: DataFrame, window: str, offset: str | None = None, ts: str = "ts", key: str = "object_id", lateness: str = "1 hour") -> DataFrame:
    """Weighted mean, error and count by object and tumbling window; late rows within the watermark still count."""
    w = 1 / F.nullif(F.col("sigma") * F.col("sigma"), F.lit(0.0))
    span = F.window(ts, window, window, offset) if offset else F.window(ts, window)
    out = stream.withWatermark(ts, lateness).groupBy(F.col(key), span.alias("w")).agg(F.sum(w).alias("sw"), F.sum(w * F.col("m")).alias("swm"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), div(F.col("swm"), F.col("sw")).alias("m"), F.sqrt(div(F.col("n").cast("double"), F.col("sw"))).alias("sigma"), "n")


def _weighted_squares(m: Column, w: Column) -> Column:
    """Weighted sum of squares about the weighted mean, from covariances, which are merged about means: large values cost no digits."""
    both = F.covar_pop(w, m)
    return F.count(F.lit(1)) * (F.covar_pop(w * m, m) - F.avg(m) * both - div(both * both, F.avg(w)))


def mergeable() -> dict[str, Column]:
    """Aggregates that need no series: their state is a few sums."""
    m, sigma = F.col("m"), F.col("sigma")
    w = 1 / F.nullif(sigma * sigma, F.lit(0.0))
    n = F.count(F.lit(1)).cast("double")
    return {
        "amplitude": (F.max(m) - F.min(m)) / 2, "mean": F.avg(m), "standard_deviation": F.stddev_samp(m), "mean_variance": div(F.stddev_samp(m), F.avg(m)),
        "skew": F.when(n > 2, F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))) * div(F.skewness(m), n - 2)), "kurtosis": div(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(m) + 6),
        "weighted_mean": div(F.sum(w * m), F.sum(w)), "reduced_chi2": div(_weighted_squares(m, w), n - 1),
        "excess_variance": div(F.var_samp(m) - F.avg(sigma * sigma), F.avg(m) * F.avg(m)), "observation_count": n,
    }


def streaming_features(stream: DataFrame, names: list[str] | None = None, key: str = "object_id") -> DataFrame:
    """Running features by object, for the update or complete mode."""
    columns = mergeable()
    return stream.groupBy(key).agg(*[columns[n].alias(n) for n in names or columns])


def count_windows(stream: DataFrame, size: int, key: str = "object_id", kind: str = "long") -> DataFrame:
    """``key, first, last, n, mean``: windows of ``size`` successive observations of an object, as they fill.

    The state of an object is its open window, ``size`` observations at most.
    """

    def step(who: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        t, m = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values("t")
        t, m = [*t, *rows["t"].tolist()], [*m, *rows["m"].tolist()]
        out = []
        while len(t) >= size:
            out.append((who[0], t[0], t[size - 1], size, sum(m[:size]) / size))
            t, m = t[size:], m[size:]
        state.update((t, m))
        yield pd.DataFrame(out, columns=[key, "first", "last", "n", "mean"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first double, last double, n int, mean double", "t array<double>, m array<double>", "append", "NoTimeout")


def _shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on one machine a temporary one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (path or tempfile.mkdtemp(prefix="tidemark-")).rstrip("/")


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, through the stream, into a table of that name.

    Executors write each batch as Parquet into the shared folder, so no rows pass the driver; the files go when it ends.
    """
    spark = stream.sparkSession
    path = f"{_shared_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    done: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        at = f"{path}/batch-{number}"
        batch.write.mode("overwrite").parquet(at)
        if at not in done:
            done.append(at)

    query = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{path}/checkpoint").start()
    query.awaitTermination()
    kept = done[-1:] if mode == "complete" else done  # a complete batch has all rows
    out = spark.read.schema(stream.schema).parquet(*kept) if kept else spark.createDataFrame([], stream.schema)
    out.createOrReplaceTempView(name)
    return out
