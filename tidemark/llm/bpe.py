"""Operator 6 - byte-level BPE encoding and decoding by DuckDB recursive queries.

Per partition, the distinct new words of a batch go to an in-memory DuckDB. A recursive query unnests
each word into token-position rows, joins neighbours with the merge table and contracts the word's
leftmost pair of minimum rank, until no pair of any word can merge; the last state of each word is
its ids. Words that are tokens themselves are taken whole, as the tiktoken library does.
Ids of up to ``UNITS`` units are kept, so that few words come through the query again.
Decoding looks ids up in the vocabulary and aggregates their bytes in the order of the ids.

Words of up to ``SHORT_BYTES`` are contracted together and their states kept till the end; longer ones
go through the same recursion with only each word's newest state kept (``USING KEY``), so memory grows
with the word. Time still grows with the square of a word's length, a step a merge: words without a
break over ``LONG_BYTES`` (no cap: all are encoded) take the library's own merge of the same ranks.

Null texts count as empty: no ids, no bytes. Texts of any length are read whole; repeated rows are
encoded each. An empty table gives an empty result. Columns named like the outputs are replaced.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import CACHE_CHARS, UnitEncoder, library, read_ranks, slices, text_slices
from ._frames import modest_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHORT_BYTES, LONG_BYTES = 256, 8192
#: Units, and words of units that are several words, whose ids a worker keeps.
UNITS, WORDS = 600_000, 50_000

#: One step: of each word's newest tokens, the leftmost pair of the least rank becomes one token.
STEP = """
    SELECT s.word, s.toks[:b.pair % 65536 - 1] || [(b.pair // 65536)::INT] || s.toks[b.pair % 65536 + 2:] {step}
    FROM state s JOIN (
        SELECT t.word, min(m.rank::BIGINT * 65536 + t.pos) AS pair
        FROM (SELECT word, unnest(toks) AS a, unnest(toks[2:]) AS b, generate_subscripts(toks, 1) AS pos FROM state) t
        JOIN merges m ON m.a = t.a AND m.b = t.b
        GROUP BY t.word
    ) b ON s.word = b.word
"""
CONTRACT = f"""
WITH RECURSIVE state(word, toks, step) AS (
    SELECT word, toks, 0 FROM first_state
  UNION ALL {STEP.format(step=", s.step + 1")}
)
SELECT word, arg_max(toks, step) AS toks FROM state GROUP BY word ORDER BY word
"""
CONTRACT_LONG = f"""
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
    SELECT word, toks FROM first_state
  UNION {STEP.format(step="")}
)
SELECT word, toks FROM state ORDER BY word
"""

DECODE = """
SELECT row, from_hex(array_to_string(list_select((SELECT list(hex ORDER BY id) FROM vocabulary), list_transform(ids, lambda id: id + 1)), '')) AS bytes
FROM batch ORDER BY row
"""


def _spill() -> str:
    """Where a worker's DuckDB may spill; gone with the worker."""
    path = tempfile.mkdtemp(prefix="duck")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


class DuckBpe:
    """A worker's DuckDB with the vocabulary and the merge table of one rank file."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.long = library(path).encode_ordinary
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": _spill()})
        ranks = self.ranks
        self.by_id = {r: t for t, r in ranks.items()}
        every = range(max(self.by_id, default=-1) + 1)  # ids without a token have no bytes, and can't be decoded
        ids = pa.table({"id": pa.array(every, pa.int32()), "hex": pa.array([self.by_id.get(k, b"").hex() for k in every], pa.string())})
        # every way to split a token in two tokens merges into it at its rank
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True)) if pairs else [pa.array([], pa.int32())] * 3
        merges = pa.table({"a": a, "b": b, "rank": r, "merged": r})
        for name, table in (("vocabulary", ids), ("merges", merges)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.words: dict[str, bytes] = {}
        self.there = np.isin(every, list(self.by_id))
        self.units = UnitEncoder(self.resolve, UNITS)

    def resolve(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, whose words are encoded together if they are new."""
        known, cache, ranks = self.words, self.units.cache, self.ranks
        if len(known) > WORDS:
            known.clear()
        new: dict[str, bytes] = {}
        short: dict[str, bytes] = {}
        long: dict[str, bytes] = {}
        several: dict[str, list[str]] = {}
        for u in units:
            if u.isascii() and u[u[:1] == " " :].isalpha():  # one match, which the units' encoder keeps
                words = (u,)
            else:
                words = several[u] = self.pattern.findall(u)
            for w in words:
                if w in known or w in cache or w in new or w in short:
                    continue
                raw = w.encode()
                if (r := ranks.get(raw)) is not None:
                    new[w] = r.to_bytes(4, "little")
                elif len(raw) <= SHORT_BYTES:
                    short[w] = raw
                elif len(raw) <= LONG_BYTES:
                    long[w] = raw
                else:
                    new[w] = np.array(self.long(w), "<u4").tobytes()
        for query, some in ((CONTRACT, short), (CONTRACT_LONG, long)):
            every = list(some)
            for k in range(0, len(every), 50_000):
                part = every[k : k + 50_000]
                new.update(zip(part, self.contract([some[w] for w in part], query), strict=True))
        out = []
        for u in units:
            if (ids := new.get(u)) is None:
                ids = b"".join([new.get(w) or known.get(w) or cache[w] for w in several.get(u, (u,))])
            out.append(ids)
        for words in several.values():
            for w in words:
                if w in new and len(w) <= CACHE_CHARS:
                    known[w] = new[w]
        return out

    def contract(self, raws: list[bytes], query: str = CONTRACT) -> list[bytes]:
        """Ids of each word by the recursive query."""
        one = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        ends = np.cumsum([0, *map(len, raws)]).astype(np.int32)
        toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(one[np.frombuffer(b"".join(raws), np.uint8)]))
        got = self.query(query, first_state=pa.table({"word": np.arange(len(raws), dtype=np.int32), "toks": toks})).column("toks").combine_chunks()
        ends, ids = 4 * np.asarray(got.offsets).astype(np.int64), np.asarray(got.values).astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.db.register(name, table)
        got = self.db.sql(sql).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return got

    def decode(self, ids: pa.Array) -> list[bytes]:
        """Bytes of each list of ids; unknown ids are an error."""
        known = np.asarray(ids.flatten())
        if len(known) and (known.min() < 0 or known.max() >= len(self.there) or not self.there[known].all()):
            raise ValueError("an id is not in the vocabulary")
        got = self.query(DECODE, batch=pa.table({"row": np.arange(len(ids)), "ids": ids.cast(pa.list_(pa.int32()))})).column("bytes")
        return got.to_pylist() if len(ids) else []


@lru_cache(maxsize=2)
def duck_bpe(path: str) -> DuckBpe:
    """One per worker and rank file."""
    return DuckBpe(path)


def _encoded(batches: Iterator[pa.RecordBatch], k: int, ids: str, ranks: str) -> Iterator[pa.RecordBatch]:
    """``batches`` with the ids of the texts in column ``k``."""
    coder = duck_bpe(ranks)
    for batch in batches:
        for a, b, texts in text_slices(batch.column(k), 1 << 22):
            raw = coder.units.encode_batch(texts)
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists], names=[*batch.schema.names, ids])


def _decoded(batches: Iterator[pa.RecordBatch], k: int, decoded: str, ranks: str) -> Iterator[pa.RecordBatch]:
    """``batches`` with the bytes of the ids in column ``k``."""
    coder = duck_bpe(ranks)
    for batch in batches:
        lists = batch.column(k)
        for a, b in slices([range(n or 0) for n in lists.value_lengths().to_pylist()], 1 << 19):
            got = pa.array(coder.decode(lists.slice(a, b - a).fill_null([]) if lists.null_count else lists.slice(a, b - a)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, got], names=[*batch.schema.names, decoded])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``df`` with the ids of its texts as ``array<int>`` in column ``ids``."""
    modest_batches(df.sparkSession)
    df = df.drop(ids) if ids != text else df
    k = df.columns.index(text)
    return df.mapInArrow(lambda batches: _encoded(batches, k, ids, ranks), df.select("*", F.array(F.lit(0)).alias(ids)).schema)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """``df`` with the bytes that its ids stand for as ``binary`` in column ``decoded``."""
    modest_batches(df.sparkSession)
    df = df.drop(decoded)
    k = df.columns.index(ids)
    return df.mapInArrow(lambda batches: _decoded(batches, k, decoded, ranks), df.select("*", F.lit(b"").alias(decoded)).schema)


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """:func:`encode`, then :func:`decode` without the texts, in one pass: neither texts nor ids travel in between."""
    modest_batches(df.sparkSession)
    df = df.drop(*{ids, decoded} - {text})
    k = df.columns.index(text)
    rest = [c for c in range(len(df.columns)) if c != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = (b.select([*rest, len(rest) + 1]) for b in _encoded(batches, k, ids, ranks))
        return _decoded(coded, len(rest), decoded, ranks)

    return df.mapInArrow(run, df.select(*[df.columns[c] for c in rest], F.array(F.lit(0)).alias(ids), F.lit(b"").alias(decoded)).schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = round_trip(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
