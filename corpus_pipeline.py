"""From documents to training sequences: toxicity filter, near-dedup, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; further ones, whatever their names, pass through them unread.

Null and empty texts pass every filter and pack as empty documents. Texts of any length are read whole.
Equal texts are near-duplicates: the one with the least id stays; of rows that share an id, the one
with the least text; rows without an id all stay. Without labels no document is toxic. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import minhash_dedup, packing, pii, toxicity
from tidemark.llm._frames import drop_staged, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as not toxic; it learns from the labelled rows of the table of documents."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = toxicity.fit(known, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.filtered(docs, index)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return minhash_dedup.deduplicate(docs, words=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a training sequence."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", redact_personal_data), ("packing", pack_sequences)]

#: SQL can't express the stages; tests hold them against plain implementations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        drop_staged(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # has written its pieces
    drop_staged(docs)
    return out
