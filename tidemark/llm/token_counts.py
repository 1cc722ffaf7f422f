"""Operator 8 - exact token counts from a length histogram.

Every text is encoded whole; documents are aggregated by encoded length, and suffix sums over the
histogram answer, for each context limit that is a length of the corpus, how many documents reach
it, how many tokens all documents hold, and how many remain when documents are cut there. Between
two such lengths the truncated total is linear, so :func:`truncated_total` answers every limit.

The sums run in two levels - blocks of lengths, then lengths within a block - so that no task sees
the whole histogram but for one row a block. Null and empty texts have length 0; texts of any length are
encoded whole; repeated rows count each. An empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bpe import text_slices, unit_encoder
from ._frames import modest_batches, staged

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Lengths in a block of the two-level sums.
BLOCK = 512


def token_lengths(df: DataFrame, text: str = "text", name: str = "n_tokens", ranks: str = RANKS) -> DataFrame:
    """The encoded length of each row's text; one column, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(ranks)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in encoder.encode_batch(texts)], pa.int64())], names=[name])

    modest_batches(df.sparkSession)
    return df.select(F.col(text)).mapInArrow(run, f"{name} long")


def histogram(lengths: DataFrame, name: str = "n_tokens") -> DataFrame:
    """``n_tokens, n_docs``; partial counts are made before the shuffle."""
    return lengths.groupBy(F.col(name).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def length_table(hist: DataFrame) -> DataFrame:
    """Per length L of the histogram (staged, as it is read three times): documents and tokens below, at and from L, and the total cut to L."""
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(F.col("block").alias("b"), zero(F.sum("bd").over(before)).alias("d0"), zero(F.sum("bt").over(before)).alias("t0"), F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    below = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    x = h.withColumn("d1", zero(F.sum("n_docs").over(below))).withColumn("t1", zero(F.sum("tokens").over(below)))
    x = x.join(blocks, x["block"] == blocks["b"])
    docs_below, tokens_below = F.col("d0") + F.col("d1"), F.col("t0") + F.col("t1")
    return x.select("n_tokens", "n_docs", docs_below.alias("docs_below"), (F.col("all_docs") - docs_below).alias("docs_at_least"), (F.col("all_tokens") - tokens_below).alias("tokens_at_least"), (tokens_below + F.col("n_tokens") * (F.col("all_docs") - docs_below)).alias("truncated_total"), F.col("all_docs").alias("total_docs"), F.col("all_tokens").alias("total_tokens"), ((docs_below + F.col("n_docs")) / F.col("all_docs")).alias("quantile"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut to ``limit``, which need not be a length that occurs."""
    x = table.where(F.col("n_tokens") >= limit).agg(F.min(F.struct("n_tokens", "docs_at_least", "truncated_total")).alias("s"))
    whole = table.agg(F.max("total_tokens").alias("whole"))
    cut = F.col("s.truncated_total") - (F.col("s.n_tokens") - limit) * F.col("s.docs_at_least")
    return x.join(whole).select(F.lit(limit).alias("context"), F.coalesce(cut, "whole", F.lit(0)).cast("long").alias("truncated_total"))


def length_at_quantile(table: DataFrame, q: float) -> DataFrame:
    """One row: the least length that a share ``q`` of the documents doesn't exceed."""
    return table.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(staged(histogram(token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))))
