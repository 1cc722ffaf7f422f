"""Operator 7 - toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows (``SAMPLE``, by hash of the id) gives the examples. Terms are the
words of the examples, all of which are indexed. Document frequencies are counted over all documents.
A term weighs ``sqrt(tf) * idf * (1 + chi2)`` with ``chi2`` the term's chi-square statistic against
the labels of the sample, so that words tied to either label say more. Words outside of this
vocabulary have no weight.

Examples go to an inverted index in blocks of ``BLOCK`` neighbouring examples. Its cells, one per
term and block, hold the block's largest weight of the term and where its postings begin; the cells
and postings of terms that stand in many examples are kept as matrices, a table per block. A query adds
up its cells to a bound of every block's cosines; the postings of the few blocks with the highest
bounds are read first, then those of blocks whose bound reaches the k-th best cosine; no posting of
another block is touched, and the k nearest are exact. Votes weigh by cosine against a prior; the
share is calibrated by isotonic regression on leave-one-out votes of the sample.

An example never votes on its own document, whichever row it comes from. Null and empty texts, and
texts without a term, get the calibrated rate of such examples. Very long texts are read whole.
Repeated rows get equal scores, each row one; ties in cosine go to the example that comes first in the
index. Without documents the result is empty, without labels every score is 0. Columns named like the
outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import drop_staged, modest_batches, staged, trim

#: The bound of the fitted model: labelled rows.
SAMPLE = 10_000
NEIGHBOURS, BLOCK, PRIOR_WEIGHT = 15, 64, 1.0
#: Blocks read before the k-th best cosine is known, and queries scored at a time.
FIRST, TOGETHER = 4, 64
#: Terms in more than this share of the examples are kept as matrices.
COMMON = 0.03
THRESHOLD = 0.3
#: What parts words: all but letters and numerals that aren't decimal digits.
NO_WORD = r"[^\p{L}\p{Nl}\p{No}]+"


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``n`` labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(n)  # a top-n: no task sees more than its own rows and n
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    copies = found.groupBy(F.xxhash64("text").alias("same"), "toxic").agg(F.min(F.struct("doc_id", "text")).alias("one"))  # copies count once
    return copies.select("one.doc_id", "one.text", "toxic")


def words(column: pa.Array) -> pa.ListArray:
    """The words of each text in lower case, perhaps with empty ones at its ends; null texts have none."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")), NO_WORD)


def numbered(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """``docs`` with the numbers and counts of its texts' terms in place of ``text``."""
    keep = [c for c in docs.columns if c != "text"]
    at = docs.columns.index("text")
    handle = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            lists = numbers_of(batch.column(at), handle.value)
            ends = pa.array(np.cumsum([0, *(len(k) for k, _ in lists)]).astype(np.int32))
            made = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in zip(*lists, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "k", "n"])

    none = F.expr("cast(array() as array<int>)")
    return docs.mapInArrow(run, docs.select(*keep, none.alias("k"), none.alias("n")).schema)


def numbers_of(column: pa.Array, terms: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers, ascending, and counts of the terms of each text."""
    lists = words(column)
    coded = lists.flatten().dictionary_encode()
    place = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms), -1).to_numpy().astype(np.int64)
    number = place[coded.indices.to_numpy()]
    owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    known = number >= 0
    size = max(len(terms), 1)
    pair, n = np.unique(owner[known] * size + number[known], return_counts=True)
    k, n, ends = (pair % size).astype(np.int32), n.astype(np.int32), np.searchsorted(pair, np.arange(len(lists) + 1) * size).tolist()
    return [(k[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def document_frequencies(rows: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many of all documents (rows of :func:`numbered`) each term occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms + 1, np.int64)
        for batch in batches:
            counts[:-1] += np.bincount(np.asarray(batch.column(0).flatten()), minlength=terms)
            counts[-1] += len(batch)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], names=["k", "n"])

    got = rows.select("k").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    counts = np.zeros(terms + 1, np.int64)
    counts[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return counts[:-1], int(counts[-1])


def vocabulary(picked: DataFrame) -> pa.Array:
    """All words of the sample, sorted; bounded by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.unique(words(batch.column(0)).flatten())], names=["term"])

    found = picked.select("text").mapInArrow(run, "term string").where("term <> ''").distinct().toArrow().column("term").combine_chunks()
    found = found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks) if found.num_chunks else pa.array([], pa.string())
    return found.take(pc.array_sort_indices(found))


def examples_of(rows: DataFrame) -> list[tuple]:
    """(doc_id, toxic, term numbers, counts) of the sample (:func:`numbered`), at most ``SAMPLE`` rows, in a fixed order."""
    got = rows.select("doc_id", "toxic", "k", "n").toArrow()
    lists = [[x.values.to_numpy().copy() for x in got.column(c)] for c in ("k", "n")]
    found = list(zip(got.column("doc_id").to_pylist(), got.column("toxic").to_pylist(), *lists, strict=True))
    return sorted(found, key=lambda r: (str(r[0]), r[1]))


def chi_square(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Of the presence of terms in ``a`` of ``pos`` and ``b`` of ``neg`` examples; 0 where a term tells nothing."""
    n, both = pos + neg, a + b
    under = pos * neg * both * (n - both)
    return np.divide((a * (neg - b) - b * (pos - a)) ** 2 * n, under, out=np.zeros(len(a)), where=under > 0)


def weigh(weights: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A text's unit vector."""
    w = np.sqrt(np.asarray(n, float)) * weights[k]
    return (w / (np.sqrt(w @ w) or 1.0)).astype(np.float32)


def clusters(numbers: list[np.ndarray], unit: list[np.ndarray], terms: int, k: int = 16, steps: int = 5) -> np.ndarray:
    """A cluster of each vector by spherical k-means over its part in the ``1024`` most frequent terms."""
    if len(unit) <= BLOCK:
        return np.zeros(len(unit), int)
    often = np.bincount(np.concatenate(numbers), minlength=terms)
    row = np.full(terms, -1, np.int32)
    top = np.argsort(-often, kind="stable")[:1024]
    row[top] = np.arange(len(top))
    x = np.zeros((len(unit), len(top)), np.float32)
    for i, (t, w) in enumerate(zip(numbers, unit, strict=True)):
        at = row[t]
        x[i, at[at >= 0]] = w[at >= 0]
    centre = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = np.argmax(x @ (centre / (np.linalg.norm(centre, axis=1)[:, None] + 1e-9)).T, 1)
        centre = np.stack([x[near == c].sum(0) for c in range(len(centre))])
    return near


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in a row."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Index:
    """Block-max inverted index of the examples' unit TF-IDF vectors."""

    terms: pa.Array  # sorted
    weight: np.ndarray  # of each term
    ids: list
    labels: np.ndarray
    prior: float
    docs: np.ndarray = None  # postings by (term, example)
    weights: np.ndarray = None
    cell_start: np.ndarray = None  # of each cell's postings; cells by (term, block)
    cell_block: np.ndarray = None
    cell_max: np.ndarray = None
    term_start: np.ndarray = None  # of each term's cells
    votes: tuple[np.ndarray, np.ndarray] = None  # isotonic steps: vote, calibrated score
    blank: float = 0.0

    @classmethod
    def build(cls, terms: pa.Array, weight: np.ndarray, examples: list[tuple]) -> Index:
        """``examples`` are (doc_id, toxic, term numbers, counts)."""
        unit = [weigh(weight, k, n) for _, _, k, n in examples]
        # neighbours in a block are of one cluster and share their heaviest term, so that block maxima are tight
        full = [i for i in range(len(unit)) if len(unit[i])]
        cluster = dict(zip(full, clusters([examples[i][2] for i in full], [unit[i] for i in full], len(terms)).tolist(), strict=True))
        order = sorted(full, key=lambda i: (cluster[i], int(examples[i][2][np.argmax(unit[i])]), i))
        index = cls(terms, weight, [examples[i][0] for i in order], np.array([examples[i][1] for i in order], float), float(np.mean([e[1] for e in examples])) if examples else 0.0)
        k = np.concatenate([np.zeros(0, np.int32), *[examples[i][2] for i in order]])
        d = np.repeat(np.arange(len(order), dtype=np.int32), [len(unit[i]) for i in order])
        w = np.concatenate([np.zeros(0, np.float32), *[unit[i] for i in order]])
        by = np.argsort(k, kind="stable")  # examples are in order already
        k, index.docs, index.weights = k[by].astype(np.int64), d[by], w[by]
        del d, w, by, unit
        cell = k * index.blocks + index.docs // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        index.cell_start = np.append(first, len(cell)).astype(np.int32)
        index.cell_block = (cell[first] % max(index.blocks, 1)).astype(np.int32)
        index.cell_max = np.maximum.reduceat(index.weights, first) if len(first) else np.zeros(0, np.float32)
        index.term_start = np.searchsorted(k[first], np.arange(len(terms) + 1)).astype(np.int32)
        return index

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of common terms: each term's row or -1, block maxima (term, block) and weights (block, term, place)."""
        size = self.cell_start[self.term_start[1:]] - self.cell_start[self.term_start[:-1]]  # postings
        common = np.flatnonzero(size > max(COMMON * len(self.ids), BLOCK))
        row = np.full(len(self.terms), -1, np.int32)
        row[common] = np.arange(len(common))
        most = np.zeros((len(common), self.blocks), np.float32)
        whole = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        for j, t in enumerate(common.tolist()):
            cells = slice(self.term_start[t], self.term_start[t + 1])
            most[j, self.cell_block[cells]] = self.cell_max[cells]
            spot = slice(self.cell_start[cells.start], self.cell_start[cells.stop])
            whole[self.docs[spot] // BLOCK, j, self.docs[spot] % BLOCK] = self.weights[spot]
        return row, most, whole

    def numbers(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of a text's terms."""
        return numbers_of(pa.array([text], pa.string()), self.terms)[0]

    def nearest(self, queries: list[tuple]) -> list[list[tuple[float, int]]]:
        """(cosine, example) of the nearest to each (term numbers, counts, own id), nearest first; none with cosine 0."""
        return [near for a in range(0, len(queries), TOGETHER) for near in self._together(queries[a : a + TOGETHER])]

    def _together(self, queries: list[tuple]) -> list[list[tuple[float, int]]]:
        rows, blocks = len(queries), self.blocks
        row, most, whole = self.tables
        dense = np.zeros((rows, len(most)), np.float32)
        rare = []  # of each query: terms and values
        for r, (k, n, _) in enumerate(queries):
            value = weigh(self.weight, k, n)
            at = row[k]
            dense[r, at[at >= 0]] = value[at >= 0]
            rare.append((k[at < 0], value[at < 0]))
        k = np.concatenate([x for x, _ in rare])
        begin = self.term_start[k]
        size = self.term_start[k + 1] - begin
        cell = _spread(begin, size)
        value = np.repeat(np.concatenate([x for _, x in rare]), size)
        owner = np.repeat(np.arange(rows, dtype=np.int32), [len(x) for x, _ in rare])
        place = np.repeat(owner * np.int32(blocks), size) + self.cell_block[cell]
        bound = dense @ most + np.bincount(place, value * self.cell_max[cell], rows * blocks).reshape(rows, blocks).astype(np.float32) + np.float32(1e-5)
        want = min(NEIGHBOURS + 1, blocks * BLOCK)  # one may be the text itself

        def read(todo: np.ndarray, slot: np.ndarray, width: int) -> np.ndarray:
            """Cosines with the examples of the blocks in ``todo``; ``slot`` says where a block's go, of ``width`` slots a row."""
            mine = np.flatnonzero(todo.ravel()[place])
            to, some = place[mine], cell[mine]
            start = self.cell_start[some]
            many = self.cell_start[some + 1] - start
            spot = _spread(start, many)
            target = np.repeat((to // blocks * width + slot.ravel()[to]) * BLOCK, many) + self.docs[spot] % BLOCK
            known = np.bincount(target, np.repeat(value[mine], many) * self.weights[spot], rows * width * BLOCK).astype(np.float32).reshape(rows, width, BLOCK)
            for b in np.flatnonzero(todo.any(0)):
                asks = np.flatnonzero(todo[:, b])
                known[asks, slot[asks, b]] += dense[asks] @ whole[b]
            return known.reshape(rows, -1)

        # the blocks with the highest bounds tell how near the k-th is at least; then all that can hold a nearer one are read
        few = min(FIRST, blocks)
        first = np.argpartition(bound, -few, 1)[:, -few:]
        some, slot = np.zeros(bound.shape, bool), np.zeros(bound.shape, np.int32)
        np.put_along_axis(some, first, True, 1)
        np.put_along_axis(slot, first, np.arange(few, dtype=np.int32)[None], 1)
        table = read(some, slot, few)
        floor = np.partition(table, -want, 1)[:, [-want]] if table.shape[1] >= want else np.zeros((rows, 1), np.float32)
        every = np.broadcast_to(np.arange(blocks, dtype=np.int32), bound.shape)
        table = read((bound >= floor) & (bound > 2e-5), every, blocks)
        # sums in another order may differ in the last bits
        row, near = np.nonzero(table >= np.maximum(floor - np.float32(1e-5), np.finfo(np.float32).tiny))
        cosine = table[row, near]
        by = np.lexsort((near, -cosine, row))
        row, near, cosine = row[by], near[by].tolist(), cosine[by].tolist()
        ends = np.searchsorted(row, np.arange(rows + 1)).tolist()
        out = []
        for r, (_, _, own) in enumerate(queries):
            a, b = ends[r], min(ends[r + 1], ends[r] + NEIGHBOURS + 1)
            out.append([(cosine[i], near[i]) for i in range(a, b) if own is None or self.ids[near[i]] != own][:NEIGHBOURS])
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(c for c, _ in near)
        return (sum(c * self.labels[i] for c, i in near) + PRIOR_WEIGHT * self.prior) / (total + PRIOR_WEIGHT)

    def calibrate(self, votes: list[tuple[float, int]], blank: list[int]) -> None:
        """Isotonic steps from leave-one-out votes by pooling adjacent violators; ``blank`` are labels of texts without a term."""
        self.blank = (sum(blank) + self.prior) / (len(blank) + 1)
        pools: list[list[float]] = []  # first vote, hits, rows
        for v, y in sorted(votes):
            pools.append([v, float(y), 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, hits, rows = pools.pop()
                pools[-1][1] += hits
                pools[-1][2] += rows
        self.votes = np.array([p[0] for p in pools]), np.array([(p[1] + self.prior) / (p[2] + 1) for p in pools])

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]], own: list) -> list[tuple[float, list[tuple[float, int]]]]:
        """The score of each text, given as numbers and counts, and its nearest examples."""
        full = [r for r, (k, _) in enumerate(found) if len(k)] if self.ids else []
        near = self.nearest([(*found[r], own[r]) for r in full])
        out: list = [(self.blank, [])] * len(found)
        step, level = self.votes
        values = np.interp([self.vote(x) for x in near], step, np.maximum.accumulate(level)) if full else []
        for r, x, v in zip(full, near, values, strict=True):
            out[r] = float(v), x
        return out


def _arrays(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers and counts of each row, without copies."""
    k, n = batch.column(batch.schema.get_field_index("k")), batch.column(batch.schema.get_field_index("n"))
    ends = (np.asarray(k.offsets) - k.offsets[0].as_py()).tolist()
    flat = [np.asarray(x.flatten()) for x in (k, n)]
    return [(flat[0][a:b], flat[1][a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> Index:
    """The index over a bounded sample of ``labels`` (``doc_id, toxic``) with texts and frequencies from ``docs``."""
    return fit_numbered(docs.select("doc_id", "text"), labels, n)[0]


def fit_numbered(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> tuple[Index, DataFrame]:
    """The index, and ``docs`` as :func:`numbered` (staged), from which frequencies were counted."""
    modest_batches(docs.sparkSession)
    picked = staged(sample(docs, labels, n))
    terms = vocabulary(picked)
    rows = staged(numbered(docs, terms))
    df, total = document_frequencies(rows, len(terms))
    chosen = staged(numbered(picked, terms))
    examples = examples_of(chosen)
    there = [np.concatenate([np.zeros(0, np.int32), *[e[2] for e in examples if e[1] == y]]) for y in (1, 0)]
    a, b = (np.bincount(x, minlength=len(terms)).astype(float) for x in there)
    toxic = float(sum(e[1] for e in examples))
    weight = (np.log((1 + total) / (1 + df)) + 1) * (1 + chi_square(a, b, toxic, len(examples) - toxic))
    index = Index.build(terms, weight, examples)
    blank = [e[1] for e in examples if not len(e[2])]
    del examples
    index.calibrate(_votes(chosen, index), blank)
    drop_staged(picked), drop_staged(chosen)
    trim()  # the driver's own arrays, several times the index while it is built
    return index, rows


def _votes(chosen: DataFrame, index: Index) -> list[tuple[float, int]]:
    """Leave-one-out votes of the examples that have a term, and their labels."""
    handle = chosen.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = handle.value
        for batch in batches:
            found = [(*x, i, y) for x, i, y in zip(_arrays(batch), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(x[0])]
            votes = [index.vote(near) for near in index.nearest([x[:3] for x in found])]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array([x[3] for x in found], pa.int32())], names=["vote", "toxic"])

    got = chosen.select("doc_id", "toxic", "k", "n").mapInArrow(run, "vote double, toxic int").toArrow()  # at most SAMPLE rows
    handle.unpersist()
    return list(zip(got.column("vote").to_pylist(), got.column("toxic").to_pylist(), strict=True))


EVIDENCE = "array<struct<doc_id:string,toxic:int,cosine:double>>"


def scored(df: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``score``, ``predicted`` and ``evidence`` (the three nearest examples); such columns are replaced."""
    c = df.drop("score", "predicted", "evidence").columns.index(text)
    return _scored(df, index, doc_id, lambda batch, index: numbers_of(batch.column(c), index.terms))


def _scored(df: DataFrame, index: Index, doc_id: str, numbers: Callable) -> DataFrame:
    modest_batches(df.sparkSession)
    df = df.drop("score", "predicted", "evidence")
    d = df.columns.index(doc_id)
    handle = df.sparkSession.sparkContext.broadcast(index)  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        index = handle.value
        names = [str(x) for x in index.ids]
        for batch in batches:
            got = index.scores(numbers(batch, index), batch.column(d).to_pylist())
            scores = np.clip(np.array([s for s, _ in got], float), 0, 1)
            first = [near[:3] for _, near in got]
            flat = np.array([i for near in first for _, i in near], np.int64)
            fields = [pa.array([names[i] for i in flat.tolist()], pa.string()), pa.array(index.labels[flat].astype(np.int32)), pa.array([c for near in first for c, _ in near], pa.float64())]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            evidence = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["doc_id", "toxic", "cosine"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), evidence], names=[*batch.schema.names, "score", "predicted", "evidence"])

    schema = df.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr(f"cast(array() as {EVIDENCE})").alias("evidence")).schema
    return df.mapInArrow(run, schema)


def filtered(df: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't predicted toxic, with its own columns."""
    modest_batches(df.sparkSession)
    c, d = df.columns.index(text), df.columns.index(doc_id)
    handle = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        index = handle.value
        for batch in batches:
            keep = [s < THRESHOLD for s, _ in index.scores(numbers_of(batch.column(c), index.terms), batch.column(d).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index, rows = fit_numbered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = _scored(rows, index, "doc_id", lambda batch, _: _arrays(batch))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
