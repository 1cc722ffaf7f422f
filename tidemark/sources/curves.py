"""Time series in and out: long tables, nested tables, files, validation.

The long form has a row per observation (``object_id, t, m, sigma, band``), the nested form a row per
object (``object_id, lc: array<struct<t, m, sigma, band>>``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import OBSERVATION

ROLES = ("object_id", "t", "m", "sigma", "band")
DAY = 86_400_000_000.0


def wall(ts: Column) -> Column:
    """A timestamp without time zone as the instant it names in UTC, whatever the session's zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def days(ts: Column, origin: float = 0.0, zoned: bool = False) -> Column:
    """A timestamp as days since 1970 less ``origin``; ``zoned`` for instants, else the wall clock counts."""
    return F.unix_micros(ts.cast("timestamp") if zoned else wall(ts)).cast("double") / F.lit(DAY) - F.lit(origin)


def long_form(df: DataFrame, object_id: str | Column, t: str | Column, m: str | Column, sigma: str | Column | None = None, band: str | Column | None = None) -> DataFrame:
    """Columns by role; a missing sigma is 1 and integer bands become strings. Other columns are pruned."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    named = [x for x in (t, m, sigma) if isinstance(x, str)]
    if len(set(named)) < len(named):
        raise ValueError("t, m and sigma must be different fields")
    return df.select(
        col(object_id).alias("object_id"), col(t).cast("double").alias("t"), col(m).cast("double").alias("m"),
        (F.lit(1.0) if sigma is None else F.coalesce(col(sigma).cast("double"), F.lit(1.0))).alias("sigma"),
        (F.lit(None) if band is None else col(band)).cast("string").alias("band"),
    )


def from_nested(df: DataFrame, object_id: str, lc: str = "lc", fields: Mapping[str, str | int] | None = None) -> DataFrame:
    """The long form of a nested table. ``fields`` maps roles to struct fields, by name or position."""
    kind = df.schema[lc].dataType
    if kind.typeName() != "array" or kind.elementType.typeName() != "struct":
        raise TypeError(f"{lc} must be an array of structs")
    names = kind.elementType.fieldNames()
    fields = dict(fields) if fields is not None else {r: r for r in ROLES[1:] if r in names}
    if missing := {"t", "m"} - set(fields):
        raise ValueError(f"fields lack {', '.join(sorted(missing))}")

    def pick(role: str) -> str | None:
        f = fields.get(role)
        if f is None:
            return None
        if isinstance(f, int):
            return names[f]
        if names.count(f) != 1:
            raise ValueError(f"field {f!r} is {'ambiguous' if f in names else 'missing'}")
        return f

    flat = df.select(F.col(object_id).alias("object_id"), F.explode(lc).alias("x"))
    of = lambda r: F.col("x")[pick(r)] if pick(r) else None
    return long_form(flat, "object_id", of("t"), of("m"), of("sigma"), of("band"))


def to_nested(df: DataFrame, lc: str = "lc") -> DataFrame:
    """One row per object, observations sorted by time."""
    return df.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("t", "m", "sigma", "band"))).cast(f"array<{OBSERVATION}>").alias(lc))


def read_csv(spark: SparkSession, path: str, object_id: str | None = None) -> DataFrame:
    """Files of ``time, mag, magerr`` or ``time, flux, fluxerr``; of equal times of an object the least value stays."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    value, error = ("mag", "magerr") if "mag" in df.columns else ("flux", "fluxerr")
    who = F.col(object_id) if object_id else F.input_file_name()
    rows = long_form(df, who, "time", value, error)
    return rows.groupBy("object_id", "t").agg(F.min(F.struct("m", "sigma", "band")).alias("x")).select("object_id", "t", "x.m", "x.sigma", "x.band")


def problems(df: DataFrame) -> DataFrame:
    """Rows that break the contract, with a ``reason``: nulls, non-finite times or values, NaN or non-positive errors, times repeated within a band."""
    infinite = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    bad = (
        F.when(F.col("t").isNull() | F.col("m").isNull(), "null")
        .when(infinite(F.col("t")), "time is not finite")
        .when(infinite(F.col("m")), "value is not finite")
        .when(F.isnan("sigma") | (F.col("sigma") <= 0), "error is NaN or not positive")
    )
    own = df.withColumn("reason", bad).where("reason is not null")
    same = df.where("t is not null").groupBy("object_id", "band", "t").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("m", "sigma")).alias("x")).where("n > 1")
    return own.unionByName(same.select("object_id", "t", "x.m", "x.sigma", "band", F.lit("repeated time").alias("reason")))


#: Estimated bytes of a table that one partition takes (compressed files are some 40 times larger in an aggregation), and partitions at most.
PARTITION_BYTES, PARTITIONS = 4 << 20, 1 << 14


def by_object(df: DataFrame) -> DataFrame:
    """``df`` dealt by object, into more partitions the larger its estimated size is, so that a task's memory doesn't grow with the table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    count = -(-size // PARTITION_BYTES) if size < 1 << 50 else 0  # beyond, the engine says that it doesn't know
    if count > df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(min(count, PARTITIONS), "object_id")
    return df.repartition("object_id")


def validated(df: DataFrame, duplicates: str = "error", bands: Sequence[str] | None = None, unknown: str = "error") -> DataFrame:
    """``df`` with its contract enforced in the same pass.

    ``duplicates``: ``error``, ``mean`` (weighted by 1/sigma^2) or ``keep_first`` (the least value) for
    equal times of an object and band. ``unknown``: ``error`` or ``ignore`` for bands not in ``bands``.
    """
    fail = lambda what: F.raise_error(F.lit(what)).cast("double")
    infinite = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    out = df.withColumn("t", F.when(F.col("t").isNull() | infinite(F.col("t")), fail("t must be finite")).otherwise(F.col("t")))
    out = out.withColumn("m", F.when(F.col("m").isNull() | infinite(F.col("m")), fail("m must be finite")).otherwise(F.col("m")))
    out = out.withColumn("sigma", F.when(F.isnan("sigma"), fail("sigma must not be NaN")).otherwise(F.col("sigma")))
    if bands is not None:
        known = F.coalesce(F.col("band").isin(*bands), F.lit(False))
        out = out.where(known) if unknown == "ignore" else out.withColumn("band", F.when(known, F.col("band")).otherwise(F.raise_error(F.lit("unknown band")).cast("string")))
    out = by_object(out)  # one exchange serves this and what follows by object
    key = ["object_id", "band", "t"]
    if duplicates == "mean":
        w = 1 / (F.col("sigma") * F.col("sigma"))
        return out.groupBy(*key).agg((F.sum(w * F.col("m")) / F.sum(w)).alias("m"), F.sqrt(1 / F.sum(w)).alias("sigma")).select(*ROLES)
    if duplicates == "keep_first":
        return out.groupBy(*key).agg(F.min(F.struct("m", "sigma")).alias("x")).select("object_id", "t", "x.m", "x.sigma", "band")
    n = F.count(F.lit(1))
    return out.groupBy(*key).agg(F.first("m").alias("m"), F.first("sigma").alias("sigma"), n.alias("n")).select("object_id", "t", F.when(F.col("n") > 1, fail("t must be strictly ascending")).otherwise(F.col("m")).alias("m"), "sigma", "band")


EPOCH = 19723.0  # 2024-01-01, to keep times small


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as series: a user's values, with an error that grows with the value."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return long_form(df, "user_id", days(F.col("ts"), EPOCH), "value", F.lit(0.05) * F.col("value") + F.lit(0.1), "event_type")
