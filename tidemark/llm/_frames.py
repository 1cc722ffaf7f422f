"""What the operators of this subpackage share: staging, ranking and size checks on DataFrames."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times their width stay under this many bytes.
BROADCAST_BYTES = 32 << 20


#: Rows and bytes that travel to a Python worker at a time; texts may be long, and each batch is held several times.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def modest_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` if they are larger.

    Spark reads both settings when a query runs, so they can't be put back once a lazy frame is made.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key, None))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def trim() -> None:
    """Hand freed memory back to the system: workers and the driver live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


_own: dict[str, str] = {}  # by application, where no folder is set


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on one machine a temporary one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _own[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here.

    The files survive the loss of any executor and go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a frame from :func:`staged` that no later plan reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``broadcast(df)`` if its counted size is within the bound, else ``df`` for a shuffled join."""
    limit = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right``, which has at most one row a key; null where it has none.

    ``left`` should be staged: it is read three times. Keys that hold more than ``1 / (8 * partitions)``
    of its rows are fewer than ``8 * partitions``, so their rows of ``right`` are broadcast and the
    rows of ``left`` stay where they are; the rest is joined by shuffle.
    """
    parts = 8 * shuffle_partitions(left.sparkSession)
    some = max(left.count() // parts, 1)
    hot = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > some).select(key)
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return rest.unionByName(left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key, "left"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add a gapless rank from 0 within ``keys`` without bringing a key's rows to one task.

    Each key is dealt over hash buckets of ``order``; rows get their number within (key, bucket)
    and the sum of the earlier buckets' counts. ``df`` should be staged: it is read twice. Rows that
    tie in every column of ``order`` are interchangeable.
    """
    buckets = max(64, 4 * shuffle_partitions(df.sparkSession))
    cells = [*keys, "__bucket"]
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*cells, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(*cells).orderBy(*order)) - 1
    ranked = df.withColumn("__own", own)
    on = None
    right = starts.select(*[F.col(c).alias(f"__r_{c}") for c in cells], "__start")
    for c in cells:
        same = ranked[c].eqNullSafe(right[f"__r_{c}"])
        on = same if on is None else on & same
    joined = ranked.join(right, on)
    return joined.withColumn(name, (F.col("__own") + F.col("__start")).cast("long")).drop("__bucket", "__own", "__start", *right.columns)
