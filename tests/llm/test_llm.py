"""Operators of the llm subpackage against brute force, round trips and planted cases; odd inputs."""

import base64
import gzip
import hashlib
import io
import itertools
import math
import random
import re
import time
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import _graph, bpe, embedding_dedup, minhash_dedup, neighbours, packing, pii, sharding, token_counts, toxicity, warc
from tidemark.llm._bpe import library, unit_encoder
from tidemark.llm._frames import rank_within, staged
from tidemark.llm._graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "za"]


def words(r, n):
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]


def docs(spark, texts, **clash):
    rows = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("shard", "size", "ids", "spans", "score", "component_id", "kept", "rank", "slot"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(7)
    base = words(r, 120)
    near = [" ".join(w if r.random() > p else "xx" for w in base) for p in (0.01, 0.02, 0.03, 0.05, 0.1) for _ in range(4)]
    return [None, "", "   ", "one", "two words", "Two  WORDS", "one", " ".join(base), " ".join(base).upper(), *near, "long " * 30_000, "x" * 5000, "naïve ÉTÉ 日本語 👍🏽 end", *[" ".join(words(r, r.randint(3, 200))) for _ in range(60)]]


def test_odd_input_everywhere(spark, odd_texts):
    """Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""
    df = docs(spark, odd_texts).unionByName(docs(spark, odd_texts).where("doc_id < 9"))
    df = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    n = df.count()
    tree = sharding.HashTree.regular(24)
    for run in (
        lambda d: minhash_dedup.near_duplicates(d), lambda d: pii.detect(d), lambda d: pii.redact(d), lambda d: sharding.sharded(d, tree, tree.grown()), lambda d: bpe.decode(bpe.encode(d)), lambda d: token_counts.token_lengths(d),
    ):
        assert run(df).count() == n
        assert run(df.limit(0)).count() == 0
    assert packing.packed(df).select("doc_id").where("doc_id is not null").distinct().count() == len(odd_texts)
    assert packing.packed(df.limit(0)).count() == 0
    assert token_counts.length_table(staged(token_counts.histogram(token_counts.token_lengths(df.limit(0))))).count() == 0


def brute_components(sets, percent):
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            i, j = find(a), find(b)
            root[max(i, j)] = min(i, j)
    return [find(k) for k in range(len(sets))]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_minhash_dedup(spark, odd_texts, k, percent):
    sets = []
    for t in odd_texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs(spark, odd_texts), words=k, percent=percent).collect()}
    assert [got[i]["n_shingles"] for i in range(len(sets))] == [len(s) for s in sets]
    want = brute_components(sets, percent)
    assert [got[i]["component_id"] for i in range(len(sets))] == want and len(set(want)) < len(want) - 10
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(sets)))
    left = {r["doc_id"] for r in minhash_dedup.deduplicate(docs(spark, odd_texts), words=k, percent=percent).collect()}
    assert left == {i for i in range(len(sets)) if want[i] == i}


def test_minhash_big_family_in_tiles(spark, monkeypatch):
    """A family larger than a tile is compared whole, across tiles and bands."""
    r = random.Random(3)
    base = words(r, 60)
    texts = [" ".join(w if r.random() > p else "y" + str(r.randint(0, 999)) for w in base) for p in (0.0, 0.02, 0.05, 0.08) for _ in range(60)]
    monkeypatch.setattr(minhash_dedup, "TILE_ROWS", 40)
    got = {x["doc_id"]: x["component_id"] for x in minhash_dedup.near_duplicates(docs(spark, texts), words=3, percent=85).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(58)} for t in texts]
    assert [got[i] for i in range(len(texts))] == brute_components(sets, 85)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for start in got:
        seen, todo = {start}, [start]
        while todo:
            todo += [y for y in near[todo.pop()] if y not in seen and not seen.add(y)]
        assert got[start] == min(seen)


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@@..1234 +-()_%é0", max_size=80))
def test_pii_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_added_spans_and_redaction(spark):
    cases = {"mail bob.smith (at) example (dot) com ok": "email", "call me at (415) 555-2671 now": "phone", "visa 4111.1111.1111.1111 ok": "card", "order 1234-5678 shipped": None, "std::vector of 2024-01-02": None, "see page 12, section 3.4.5": None}
    model = pii.default_model()
    for text, kind in cases.items():
        base, more = pii.find([text], model)[0]
        assert not base and [k for k, _, _ in more] == ([kind] if kind else []), text
    row = pii.redact(docs(spark, ["write a@b.com or +1 (017) 555-7713", None])).orderBy("doc_id").collect()
    assert row[0]["text"] == "write <EMAIL> or <PHONE>" and row[0]["n_chars"] == len(row[0]["text"]) and row[1]["text"] is None


@pytest.mark.parametrize("at", ["(at)", "[at]", "{at}", "<at>", "(@)", "[@]"])
def test_pii_spelled_out_addresses(at):
    """Every opener, with and without blanks, in either case: a guard must not hide what its pattern covers."""
    for dot, gap in itertools.product([".", "(dot)", "[dot]", "{dot}", "<dot>", " [dot] "], ["", " "]):
        address = f"bob{gap}{at}{gap}example{dot}org"
        for text in (f"contact {address} today", f"CONTACT {address.upper()} TODAY"):
            assert pii.find([text], pii.default_model()) == [([], [("email", 8, 8 + len(address))])], text


def test_pii_guards_are_necessary():
    for text in ("contact BOB AT EXAMPLE DOT COM now", "Bob at Example Dot com", "mail bob {AT} example.org", "a <at> b <dot> c", "x [@] y.z", "fe80::1", "call 415 555-2671"):
        want = [(kind, g, m.start(), m.end()) for g, (kind, _, pattern) in enumerate(pii.GENERATORS) for m in pattern.finditer(text)]
        assert want and pii.proposals(text) == want, text


def test_pii_model_holds_out():
    x, y = pii._generated(1500, seed=99)
    p = pii.default_model().probability(x)
    assert np.mean((p >= 0.5) == (y == 1)) > 0.95


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert len(by) == 150
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[1] < 3000 and f[1] != q for f in found)
        assert all(s == pytest.approx(x[q] @ x[v], rel=1e-12, abs=1e-12) for _, v, s in found)
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & {f[1] for f in found})
    assert hits / (20 * len(by)) >= 0.9
    assert len({r["vec_id"] for r in neighbours.nearest(df.limit(3), F.lit(True)).collect()}) == 3


@pytest.mark.parametrize("lengths", [[5] * 10, [2048] * 3 + [1] * 5, list(range(1, 2049, 7)), [1500] * 4 + [548] * 4, []])
def test_packing_solver(lengths):
    solution = packing.solve(Counter(lengths))
    used = Counter()
    for filling, times in solution:
        assert sum(filling) <= 2048
        for x in filling:
            used[x] += times
    assert used == Counter(lengths)
    bins, least = sum(t for _, t in solution), -(-sum(lengths) // 2048)
    assert bins <= least * 1.05 + 1


def test_packing(spark, odd_texts):
    texts = [*odd_texts, "stop <|endoftext|> here"]
    rows = packing.packed(docs(spark, texts), keep_ids=True).collect()
    tokenizer = packing.tokenizer(packing.VOCABULARY)
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        got = []
        for r in own:
            assert r["start"] == len(got) and r["length"] <= 2048
            part = np.frombuffer(r["ids"], "<u4").tolist()
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r["length"]
            got += part
        assert got == ids and all(r["length"] == 2048 for r in own[1:])
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_sharding(spark, odd_texts):
    n = 24
    tree = sharding.HashTree.regular(n)
    rows = sharding.sharded(docs(spark, [f"t{k}" for k in range(6000)]), tree, tree.grown()).collect()
    count = Counter(r["shard"] for r in rows)
    assert set(count) == set(range(n)) and max(count.values()) < 1.35 * 6000 / n
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert moved and {r["grown_shard"] for r in moved} == {n} and 0.5 < len(moved) * (n + 1) / 6000 < 1.6
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r["doc_id"]: r for r in sharding.sharded(docs(spark, odd_texts), tree, tree.grown()).collect()}
    for k, t in enumerate(odd_texts):
        raw = (t or "").encode()
        assert (again[k]["size"], again[k]["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


def test_sharding_by_weight(spark):
    heavy = sharding.HashTree((sharding.Shard(0, 0, 0, 1.0), sharding.Shard(1, 0, 1, 3.0), sharding.Shard(2, 1, 0, 4.0)))
    lighter = heavy.plus(sharding.Shard(1, 0, 1, 2.0))
    rows = sharding.assign(spark.range(8000).withColumnRenamed("id", "doc_id"), heavy, grown=lighter).collect()
    share = Counter(r["shard"] for r in rows)
    assert share[2] / 8000 == pytest.approx(0.5, abs=0.03) and share[1] / 8000 == pytest.approx(0.375, abs=0.03)
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {1}
    assert Counter(r["grown_shard"] for r in rows)[1] / 8000 == pytest.approx(0.5, abs=0.03)
    again = sharding.assign(spark.range(8000).withColumnRenamed("id", "doc_id"), lighter, grown=lighter.plus(sharding.Shard(3, 1, 1, 10.0))).collect()
    assert Counter(r["grown_shard"] for r in again)[3] / 8000 == pytest.approx(0.5, abs=0.03)
    assert {r["grown_shard"] for r in again if r["grown_shard"] != r["shard"]} == {3}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8), st.lists(st.text(alphabet=" \n\tab1'.é\x1c\x85²", max_size=40), max_size=8))
def test_bpe_like_the_library(a, b):
    texts = [t.encode("utf-8", "ignore").decode() for t in [*a, *b]]
    want = [library(bpe.RANKS).encode_ordinary(t) for t in texts]
    for coder in (bpe.duck_bpe(bpe.RANKS).units, unit_encoder(bpe.RANKS)):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_batch(texts)] == want


def test_bpe_round_trip(spark, odd_texts):
    rows = bpe.decode(bpe.encode(docs(spark, odd_texts))).collect()
    for r in rows:
        t = odd_texts[r["doc_id"]] or ""
        assert bytes(r["decoded"]) == t.encode() and r["ids"] == library(bpe.RANKS).encode_ordinary(t)
    other = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    few = bpe.decode(bpe.encode(docs(spark, odd_texts[:20]), ranks=other), ranks=other).collect()
    assert all(bytes(r["decoded"]) == (odd_texts[r["doc_id"]] or "").encode() for r in few)


def toxic_corpus(r, n):
    bad = ["vile", "rotten", "awful"]
    rows = []
    for k in range(n):
        w, toxic = words(r, r.randint(30, 120)), int(r.random() < 0.25)
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w), toxic))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus(random.Random(5), 800)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(9000, ""), (9001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(9100, 1, None)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(df, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(df, index).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([got[k]["predicted"] == y for k, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["predicted"] == got[9001]["predicted"] == 0
    assert not any(e["doc_id"] == str(k) for k, r in got.items() for e in r["evidence"])
    kept = {r["doc_id"] for r in toxicity.filtered(docs(spark, [t for _, t, _ in rows]), index).collect()}
    assert np.mean([(k in kept) == (y == 0) for k, _, y in rows]) > 0.97
    # the search that skips blocks is exact
    dense = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        for c in range(index.term_start[t], index.term_start[t + 1]):
            span = slice(index.cell_start[c], index.cell_start[c + 1])
            assert set(index.docs[span] // toxicity.BLOCK) == {index.cell_block[c]} and index.weights[span].max() == index.cell_max[c]
            dense[index.docs[span], t] = index.weights[span]
    for _, text, _ in rows[:60]:
        k, n = index.numbers(text)
        if len(k):
            q = np.zeros(len(index.terms))
            q[k] = toxicity.weigh(index.weight, k, n)
            cosines = dense @ q
            want = sorted(((-c, i) for i, c in enumerate(cosines) if c > 1e-12))[: toxicity.NEIGHBOURS]
            assert [c for c, _ in index.nearest([(k, n, None)])[0]] == pytest.approx([-c for c, _ in want])
    none = toxicity.fit(df, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(df, none).collect()} == {0.0}


def test_toxicity_of_varied_wording(spark):
    """Toxic texts that share no words: a near copy still meets its example, at the cosine of whole TF-IDF vectors."""
    r = random.Random(11)
    texts = {k: words(r, 40) for k in range(200)}
    texts |= {k: words(r, 20) + ["".join(r.choices("bcdfghklmnprstvw", k=9)) for _ in range(20)] for k in range(200, 240)}
    texts[9000] = texts[next(k for k in range(200, 240) if zlib.crc32(str(k).encode()) % 4 != 2)][:-2] + ["unseenone", "unseentwo"]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    index = toxicity.fit(df, spark.createDataFrame([(k, int(k >= 200)) for k in range(240)], "doc_id long, toxic int"))
    found = toxicity.scored(df.where("doc_id = 9000"), index).first()["evidence"]
    known = {k: w for k, w in texts.items() if str(k) in set(map(str, index.ids))}
    first = max(known, key=lambda k: len(set(known[k]) & set(texts[9000])))
    assert found and found[0]["doc_id"] == str(first) and found[0]["toxic"] == 1 and found[0]["cosine"] > 0.9
    # every word of every example has a term and weighs by how many of all documents hold it
    df_of = Counter(t for w in texts.values() for t in set(w))
    assert set(index.terms.to_pylist()) == {t for w in known.values() for t in w}
    toxic = sum(k >= 200 for k in known)
    for t, w in list(zip(index.terms.to_pylist(), index.weight, strict=True))[::7]:
        a, b = (sum(t in v for k, v in known.items() if (k >= 200) == side) for side in (True, False))
        c, d, n = toxic - a, len(known) - toxic - b, len(known)
        chi2 = n * (a * d - b * c) ** 2 / (toxic * (n - toxic) * (a + b) * (c + d))
        assert w == pytest.approx((np.log((1 + len(texts)) / (1 + df_of[t])) + 1) * (1 + chi2))


def test_token_counts(spark, odd_texts):
    lengths = sorted(len(library(bpe.RANKS).encode_ordinary(t or "")) for t in odd_texts)
    table = token_counts.length_table(staged(token_counts.histogram(token_counts.token_lengths(docs(spark, odd_texts)))))
    for r in table.collect():
        x = r["n_tokens"]
        assert r["n_docs"] == lengths.count(x) and r["docs_at_least"] == sum(v >= x for v in lengths) and r["docs_below"] == sum(v < x for v in lengths)
        assert r["tokens_at_least"] == sum(v for v in lengths if v >= x) and r["truncated_total"] == sum(min(v, x) for v in lengths)
        assert r["total_tokens"] == sum(lengths) and r["quantile"] == pytest.approx(sum(v <= x for v in lengths) / len(lengths))
    for limit in (0, 1, 17, 100, 10**6):
        assert token_counts.truncated_total(table, limit).first()["truncated_total"] == sum(min(v, limit) for v in lengths)
    assert token_counts.length_at_quantile(table, 0.5).first()["n_tokens"] == lengths[-(-len(lengths) // 2) - 1]


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    """Rounds of small jobs and their plans fill the driver; rounds until few edges are left find the same."""
    r = random.Random(4)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(k, 500) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 700)]
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "a string, b string")
    context = spark.sparkContext
    context.setLocalProperty("spark.jobGroup.id", "few-edges")
    got = sorted(components(df).collect())
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("few-edges")) <= 12
    monkeypatch.setattr(_graph, "AT_ONCE", 20)
    assert sorted(components(df).collect()) == got and len({c for _, c in got}) > 3
    assert components(df.limit(0)).count() == 0


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 8))
    x = np.concatenate([centre[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.18, centre[:3], centre[:3]])
    label = [int(v) for v in rng.integers(0, 3, len(x))]
    rows = [(k, v.tolist(), lb) for k, (v, lb) in enumerate(zip(x, label, strict=True))]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("inf")] * 8, 0), (903, x[0].tolist(), None), (904, [None] * 8, 1), (None, x[0].tolist(), 1)]
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) and all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in (900, 901, 902, 903, 904, None))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    root = list(range(len(x)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = Counter()
    for a, b in itertools.combinations(range(len(x)), 2):
        if label[a] == label[b] and u[a] @ u[b] >= 0.98:
            links[a] += 1
            links[b] += 1
            i, j = find(a), find(b)
            root[max(i, j)] = min(i, j)
    assert sum(links.values()) > 50
    assert [got[k]["n_links"] for k in range(len(x))] == [links[k] for k in range(len(x))]
    assert [got[k]["component_id"] for k in range(len(x))] == [find(k) for k in range(len(x))]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://e.org/a", "<html><head><title>T &amp; t</title><style>x{}</style></head><body><p>Hello <b>world</b></p><a href='/b'>next</a></body></html>"), (2, None, None), (3, "http://e.org/c", "<p>bad <<< markup"), (3, "http://e.org/c", "<p>bad <<< markup")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))
    made = warc.responses(pages)
    out = warc.derive(made, "page_id").collect()
    assert len(out) == 8 and warc.derive(made.limit(0), "page_id").count() == 0
    source = {r["page_id"]: warc.parse(bytes(r["record"])) for r in made.collect()}
    for r in out:
        headers, block = warc.parse(bytes(r["record"]))
        origin, body = source[r["page_id"]]
        assert headers["WARC-Refers-To"] == origin["WARC-Record-ID"] == r["refers_to"] and headers["WARC-Block-Digest"] == warc.sha1(block)
        assert headers["WARC-Refers-To-Date"] == origin["WARC-Date"] and r["payload_digest"] == origin["WARC-Payload-Digest"] == warc.sha1(warc.parse_http(body)[2])
        if r["page_id"] == 1:
            assert block == b"Hello world\nnext" if r["record_type"] == "conversion" else b'"title": "T & t"' in block and b"http://e.org/b" in block
    pairs = {r["record_id"]: r["concurrent_to"] for r in out}
    assert all(pairs[v] == k for k, v in pairs.items())
    files = warc.write_files(made.repartition(2), str(tmp_path / "w")).collect()
    assert sum(f["records"] for f in files) == 4 and all(open(f["file"], "rb").read(2) == b"\x1f\x8b" for f in files if f["records"])
    back = warc.read_files(spark, str(tmp_path / "w"))
    assert sorted(warc.parse(bytes(r["record"]))[1] for r in back.collect()) == sorted(warc.parse(bytes(r["record"]))[1] for r in made.collect())
    (tmp_path / "plain.warc").write_bytes(b"".join(bytes(r["record"]) for r in made.collect()))
    assert warc.read_files(spark, str(tmp_path / "plain.warc")).count() == 4
    broken = spark.createDataFrame([(1, b"no record"), (2, None)], "k long, record binary")
    assert {r["record_type"] for r in warc.derive(broken, "k").collect()} == {"metadata", "conversion"}


def test_rank_within(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("v"), "id")
    got = rank_within(staged(df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))), ["g"], [F.col("v"), F.col("id")], "r").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r["r"])
    assert len(got) == 500 and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    rows = [(k, t, "en", "s", len(t)) for k, t, _ in toxic_corpus(r, 300)]
    clean = next(t for _, t, *_ in rows if not re.search("vile|rotten|awful", t))
    rows += [(1000, clean, "en", "s", 1), (1001, clean + " a@b.com", "en", "s", 1), (1002, None, "en", "s", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(bool(re.search("vile|rotten|awful", t)))) for k, t, *_ in rows[:300]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs_]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], str(tmp_path))))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "packing"]
    assert all(x.columns == docs_.columns for x in seen[1:4])
    ids = [{x["doc_id"] for x in d.collect()} for d in seen]
    assert len(ids[0] - ids[1]) > 40 and not any(re.search("vile.*vile|rotten.*rotten", t or "") for _, t in seen[1].select("doc_id", "text").collect())
    assert 1000 not in ids[2] and 1002 in ids[2] and ids[2] == ids[3] == ids[4]
    assert not any("@" in (x["text"] or "") for x in seen[3].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def test_digests(spark, tmp_path):
    spark.createDataFrame([(1, "hello world a@b.com", "en", "s", 5), (2, None, "en", "s", None)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    six = {r["doc_id"]: r for r in bpe.op6_bpe(spark, str(tmp_path)).collect()}
    ids = library(bpe.RANKS).encode_ordinary("hello world a@b.com")
    assert six[1]["n_tokens"] == len(ids) and six[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert six[1]["decoded_sha256"] == hashlib.sha256(b"hello world a@b.com").hexdigest() and six[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    two = {r["doc_id"]: r for r in pii.op2_pii(spark, str(tmp_path)).collect()}
    assert two[1]["n_email"] == 1 and two[1]["spans"] == "email:12:19" and two[1]["base_sha256"] == hashlib.sha256(b"email:12:19").hexdigest()
    assert two[2]["spans"] == "" and two[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def oracle(sql, path, *tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con.sql(sql).df()


def same_rows(spark_df, want, columns):
    got = spark_df.select(*columns).toPandas()
    assert sorted(map(tuple, got.astype(object).values.tolist())) == sorted(map(tuple, want[columns].astype(object).values.tolist()))


SMALL = "/root/testdata/sf0.01"


def test_op1_and_op9_against_sql(spark):
    from tidemark.llm import queries

    same_rows(minhash_dedup.op1_near_duplicates(spark, SMALL), oracle(queries.NEAR_DUPLICATES, SMALL, "documents"), ["doc_id", "n_shingles", "component_id", "kept"])
    same_rows(embedding_dedup.op9_embedding_dedup(spark, SMALL), oracle(queries.EMBEDDING_DEDUP, SMALL, "embeddings"), ["vec_id", "n_links", "component_id", "kept"])


@pytest.mark.parametrize("n, keep, percent", [(7, 6, 85), (40, 37, 85), (400, 370, 85), (3000, 2760, 85)])
def test_minhash_misses_as_seldom_as_stated(n, keep, percent):
    """Pairs at the threshold agree in a place as often as they are similar, whatever their size, and meet in some tree."""
    rng = np.random.default_rng(n)
    depth, agree, missed, rounds = minhash_dedup.full_depth(percent), 0, 0, 600 if n < 1000 else 100
    for _ in range(rounds):
        both = rng.integers(0, 1 << 63, keep, dtype=np.uint64)
        a, b = (np.sort(np.concatenate([both, rng.integers(0, 1 << 63, n - keep, dtype=np.uint64)])) for _ in range(2))
        a, b = (minhash_dedup.mix(x) for x in (a, b))
        equal = (minhash_dedup.signature(np.sort(a)) == minhash_dedup.signature(np.sort(b))).reshape(minhash_dedup.TREES, minhash_dedup.DEEP)
        agree += equal.mean()
        missed += not equal[:, :depth].all(1).any()
    similarity = keep / (2 * n - keep)
    assert agree / rounds == pytest.approx(similarity, abs=0.01)
    expected = (1 - similarity**depth) ** minhash_dedup.TREES
    assert missed <= 3 + 3 * expected * rounds


def test_minhash_regions_are_found_across_partitions(spark):
    """Every pair with a common prefix of the full depth shares a region, wherever partitions of the order end."""
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 3, (300, minhash_dedup.TREES * minhash_dedup.DEEP)).astype(">u2")
    pool[200:] = pool[200]  # a hot prefix in every tree
    pool[200:, 7 :: minhash_dedup.DEEP] = rng.integers(0, 9, (100, minhash_dedup.TREES))
    rows = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(pool)], "node long, strings binary")
    for depth in (6, 8):
        regions = defaultdict(set)
        leader = {}
        for r in minhash_dedup.meetings(rows, depth).collect():
            regions[r["region"]].add(r["node"])
            leader.setdefault(r["region"], set()).add(r["leader"])
        assert all(len(v) == 1 and v <= regions[k] for k, v in leader.items())
        met = {p for v in regions.values() for p in itertools.combinations(sorted(v), 2)}
        strings = pool.reshape(300, minhash_dedup.TREES, minhash_dedup.DEEP)
        want = {(a, b) for a, b in itertools.combinations(range(300), 2) if (strings[a] == strings[b])[:, :depth].all(1).any()}
        least = {(a, b) for a, b in itertools.combinations(range(300), 2) if (strings[a] == strings[b])[:, : minhash_dedup.SHALLOW].all(1).any()}
        assert want <= met <= least and want


def test_minhash_of_repeated_ids(spark):
    """Rows of one doc_id are one document: it links with whatever one of its texts links to."""
    r = random.Random(8)
    a, b = " ".join(words(r, 60)), " ".join(words(r, 60))
    rows = [(1, a), (5, a + " more"), (5, b), (7, b + " less"), (5, ""), (9, "alone in the world"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["component_id"]) for x in minhash_dedup.near_duplicates(df, words=3, percent=85).collect() if x["doc_id"])
    assert got == [(1, 1), (5, 1), (5, 1), (5, 1), (7, 1), (9, 9)]
    left = sorted((x["doc_id"] or 0, x["text"]) for x in minhash_dedup.deduplicate(df, words=3, percent=85).collect())
    assert left == [(0, a), (1, a), (9, "alone in the world")]


def test_neighbours_of_odd_rows(spark):
    """Repeated ids are one vector; ragged ones take no part; ties, clashing columns, empty tables."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[31] = x[30]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(20, x[20].tolist()), (20, x[20].tolist()), (40, (x[40] + 9).tolist()), (70, [1.0] * 5), (80, []), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("mine")).withColumn("block", F.lit(1))
    x[40] = min(x[40].tolist(), (x[40] + 9).tolist())
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"]) for r in got] == [(q, k) for q in (0, 20, 40) for k in range(1, 11)]
    for q in (0, 20, 40):
        own = [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q]
        assert len({v for v, _ in own}) == 10 and q not in {v for v, _ in own}
        assert own == sorted(own, key=lambda f: (-f[1], f[0])) and all(s == pytest.approx(x[q] @ x[v]) for v, s in own)
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0 == neighbours.nearest(df, F.lit(False)).count()


def test_neighbours_forest_descends_to_the_longest_match():
    rng = np.random.default_rng(2)
    forest = neighbours.Forest(rng.normal(size=(500, 12)), 6.0, trees=7, bits=20)
    codes = forest._codes(np.hstack([rng.normal(size=(9, 12)), np.zeros((9, 1))]))
    bits = lambda v: format(int(v), "020b")
    common = lambda a, b: next((k for k, (p, q) in enumerate(zip(a, b, strict=True)) if p != q), 20)
    want = [[max(common(bits(c), bits(s)) for s in forest.sorted[t]) for c in codes[t]] for t in range(7)]
    assert forest.longest(codes).tolist() == want
    length = np.array([3, 5, 0, 7, 2, 4, 6, 8, 1])
    for j, rows in enumerate(forest.met(codes, length)):
        hit = {int(forest.order[t, k]) for t in range(7) for k, s in enumerate(forest.sorted[t]) if common(bits(codes[t, j]), bits(s)) >= length[j]}
        assert set(rows.tolist()) == hit


def test_op3_recall(spark):
    """The query over its whole table, against brute force."""
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    by = defaultdict(list)
    for r in neighbours.op3_neighbours(spark, SMALL).collect():
        by[r["query_id"]].append(r["vec_id"])
    hits = 0
    asks = np.flatnonzero(ids % 20 == 0)
    assert set(by) == set(ids[asks].tolist())
    for q in asks:
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(ids[np.argsort(-scores)[:20]].tolist()) & set(by[ids[q]]))
    assert hits >= 0.9 * 20 * len(asks)


def test_embedding_dedup_of_odd_rows(spark):
    """Repeated ids are one vector; ragged ones link with nothing."""
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (7, [1.0, 0.01], 1), (8, [1.0, 0.0, 0.0], 1), (9, [0.0, 1.0], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0], 2)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 0, 8), (9, 0, 9), (9, 0, 9), (10, 0, 10)]


def raw_record(headers, body, http="HTTP/1.1 200 OK"):
    block = "\r\n".join([http, *headers]).encode() + b"\r\n\r\n" + body
    return b"WARC/1.0\r\nwarc-type: response\r\nwarc-record-id: <urn:x:1>\r\nwarc-target-uri: http://e.org/\r\ncontent-length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("headers, body", [
    (["content-type: text/html; charset=latin-1"], "<p>caf\u00e9</p>".encode("latin-1")),
    (["Content-Type: text/html"], b"<html><head><meta charset='iso-8859-1'></head>" + "<p>caf\u00e9</p>".encode("latin-1")),
    (["Content-Type: text/html; charset=utf-8", "content-encoding: gzip"], gzip.compress("<p>caf\u00e9</p>".encode())),
    (["Content-Encoding: deflate"], zlib.compress("<p>caf\u00e9</p>".encode())),
    (["TRANSFER-ENCODING: chunked"], b"3\r\n<p>\r\n5;x=1\r\ncaf\xc3\xa9\r\n4\r\n</p>\r\n0\r\n\r\n"),
    (["Transfer-Encoding: chunked", "Content-Encoding: gzip"], (lambda z: f"{len(z):x}\r\n".encode() + z + b"\r\n0\r\n\r\n")(gzip.compress("<p>caf\u00e9</p>".encode()))),
])
def test_warc_of_real_archives(headers, body):
    """Header names in any case, charsets, content and transfer encodings."""
    meta, conversion = warc.derive_record(raw_record(headers, body))
    assert warc.parse(conversion["record"])[1].decode() == "caf\u00e9" and conversion["refers_to"] == "<urn:x:1>" and conversion["target_uri"] == "http://e.org/"
    assert b'"error"' not in warc.parse(meta["record"])[1] and meta["payload_digest"] == warc.sha1(body)


def test_warc_streams_records(monkeypatch):
    """Records come one by one whatever the size of a read; what stands between them is passed over."""
    records = [raw_record([], b"x" * n) for n in (0, 10, 5000, 3)]
    for data in (b"".join(records), b"junk\r\n\r\n" + b"".join(records), b"".join(gzip.compress(r) for r in records)):
        for size in (7, 64, 1 << 20):
            monkeypatch.setattr(warc, "READ_BYTES", size)
            assert [warc.parse(r)[1] for r in warc.split(io.BytesIO(data))] == [warc.parse(r)[1] for r in records]


def test_op10_against_a_plain_reading(spark):
    """The query over its whole table: every page's two records, built again one by one."""
    rows = warc.op10_warc(spark, SMALL).collect()
    pages = {p["page_id"]: p for p in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert Counter(r["page_id"] for r in rows) == {k: 2 for k in pages}
    for r in rows:
        p = pages[r["page_id"]]
        payload = (p["html"] or "").encode()
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        source = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response:{p.page_id}:{p.url or str()}:{digest}')}>"
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r.record_type}:{source}')}>"
        assert (r["record_id"], r["refers_to"], r["target_uri"], r["payload_digest"]) == (own, source, p["url"] or "", digest)


def test_warc_of_odd_pages(spark):
    """Long pages, repeated rows, pages that share an id, clashing columns."""
    rows = [(1, "u", "<p>" + "word " * 400_000 + "</p>"), (1, "u", "<p>a</p>"), (1, "v", "<p>a</p>"), (2, "w", "<p>b</p>"), (2, "w", "<p>b</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("mine")).withColumn("refers_to", F.lit(1))
    out = warc.derive(warc.responses(pages), "page_id").collect()
    assert len(out) == 10 and len({r["record_id"] for r in out}) == 8 and max(r["content_length"] for r in out) == 1_999_999


def test_pii_overlaps_against_brute_force():
    """Added spans: in order of probability, each that meets neither a base span nor one taken before."""
    r = random.Random(12)
    pieces = ["bob (at) example (dot) com", "(415) 555-2671", "4111.1111.1111.1111", "a@b.com", "+1 (017) 555-7713", "10.1.2.3", "0415 555 2671 4111 1111 1111 1111", "call", "order", "2001:db8:0:0:0:0:0:1", "555-2671-4415", "x [at] y.org"]
    model = pii.default_model()
    for _ in range(40):
        text = " ".join(r.choice(pieces) for _ in range(60))
        base, more = pii.find([text], model)[0]
        rows = pii.proposals(text)
        p = model.probability(np.array([pii.features(text, *row) for row in rows]))
        want: list = []
        free = [k for k, (_, _, a, b) in enumerate(rows) if not any(a < e and b > s for _, s, e in base)]
        for k in sorted(free, key=lambda k: (-p[k], k)):
            kind, _, a, b = rows[k]
            if p[k] >= model.thresholds[kind] and not any(a < e and b > s for _, s, e in want):
                want.append((kind, a, b))
        assert sorted(more) == sorted(want)


def test_pii_of_long_texts():
    """Long local parts are found whole, and time grows with the length."""
    local = "b" * 300
    for address in (f"{local}[at]example.org", f"{local} at example dot com"):
        assert pii.find([f"mail {address} now"], pii.default_model())[0][1] == [("email", 5, 5 + len(address))]
    text = "write a@b.com or call (415) 555-2671 or 10.0.0.1 ok " * 2500
    start = time.perf_counter()
    base, more = pii.find([text], pii.default_model())[0]
    once = time.perf_counter() - start
    assert len(base) == 5000 and len(more) == 2500
    start = time.perf_counter()
    pii.find([text * 4], pii.default_model())
    assert time.perf_counter() - start < 10 * once


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place for every length."""
    best, order = len(lengths), sorted(lengths, reverse=True)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(order):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= order[k]:
                left = list(rooms)
                left.remove(room)
                go(k + 1, [*left, room - order[k]])
        go(k + 1, [*rooms, capacity - order[k]])

    go(0, [])
    return best


def test_packing_is_optimal_on_small_cases():
    for seed in range(200):
        r = random.Random(seed)
        lengths = [r.randint(5, 70) for _ in range(r.randint(1, 11))]
        assert sum(n for _, n in packing.solve(Counter(lengths), 100)) == fewest(lengths, 100), lengths


def test_packing_of_tight_triplets():
    """300 triplets that fill 300 sequences exactly: greedy packing takes 307."""
    r = random.Random(0)
    lengths = []
    for _ in range(300):
        a = r.randint(520, 900)
        b = r.randint(520, max(520, 1528 - a))
        lengths += [a, b, 2048 - a - b]
    solution = packing.solve(Counter(lengths))
    assert sum((Counter({x: filling.count(x) * n for x in filling}) for filling, n in solution), Counter()) == Counter(lengths)
    assert all(sum(filling) <= 2048 for filling, _ in solution) and sum(n for _, n in solution) <= 302
    plain = packing.fewer(Counter(lengths[:30]), 10, 2048)
    assert plain and sum(map(Counter, plain), Counter()) == Counter(lengths[:30])
    assert packing.fewer(Counter([60, 60, 60]), 2, 100) is None


def test_packing_meets_the_bound_on_documents(spark):
    lengths = [r["length"] for r in packing.op4_packing(spark, SMALL).select("length").collect()]
    assert sum(n for _, n in packing.solve(Counter(lengths))) == -(-sum(lengths) // 2048)


def drawn(key, seed, level, name, weight):
    h = 42
    for raw in ((key or 0).to_bytes(8, "little", signed=True) if key is not None else b"", *(v.to_bytes(4, "little", signed=True) for v in (seed, level, name))):
        h = xxhash.xxh64_intdigest(raw, seed=h) if raw else h
    return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight


def test_op5_against_a_twin(spark):
    """The query over its whole table, against a plain descent of the same tree."""
    rows = sharding.op5_shards(spark, SMALL).collect()
    docs_ = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs_)
    slots = defaultdict(list)
    for r in rows:
        k = r["doc_id"]
        top, region = min((drawn(k, 20011, sharding.REGION, g, 8.0), g) for g in range(3))
        _, rack = min((drawn(k, 20011, sharding.RACK, 2 * region + j, 4.0), j) for j in range(2))
        _, shard = min((drawn(k, 20011, sharding.SHARD, n, 1.0), n) for n in range(8 * region + 4 * rack, 8 * region + 4 * rack + 4))
        late = drawn(k, 20011, sharding.ADDED, 24, 1.0)
        assert (r["region"], r["rack"], r["shard"], r["grown_shard"], r["law"]) == (region, rack, shard, 24 if late < top else shard, "key")
        assert (r["size"], r["text_crc32"]) == (len(docs_[k]) + 8, zlib.crc32(docs_[k]))
        slots[shard].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_bpe_long_words_come_through_the_recursion(monkeypatch):
    r = random.Random(9)
    long_ = ["".join(r.choice("abcdefgh\u00e9\u65e5") for _ in range(n)) for n in (300, 1500, 4000)] + ["x" * 5000]
    coder = bpe.DuckBpe(bpe.RANKS)
    coder.long = None  # the library is not asked
    want = [library(bpe.RANKS).encode_ordinary(t) for t in long_]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.units.encode_batch(long_)] == want
    assert coder.decode(pa.array(want, pa.list_(pa.int32()))) == [t.encode() for t in long_]
    with pytest.raises(ValueError):
        coder.decode(pa.array([[10**6]], pa.list_(pa.int32())))


def test_bpe_words_are_contracted_once(monkeypatch):
    """A word that stands alone and beside others goes through the recursion once, and a word that is kept never again."""
    coder, asked = bpe.DuckBpe(bpe.RANKS), []
    contract = coder.contract
    monkeypatch.setattr(coder, "contract", lambda raws, query=bpe.CONTRACT: asked.extend(raws) or contract(raws, query))
    r = random.Random(9)
    new = ["".join(r.choice("bcdfgklmnrstvz") + r.choice("aeiou") for _ in range(7)) for _ in range(50)]
    texts = ["x " + " ".join(new), "x " + " ".join(f"{w}, ({w})" for w in new), "x " + " ".join(f"{w}!" for w in new) + " " + "ab" * 200]
    want = [np.array(library(bpe.RANKS).encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert [coder.units.encode_batch([t])[0] for t in texts] == want and len(asked) == len(set(asked))
    assert coder.units.encode_batch(texts) == want
    assert all(len(u) <= 48 for u in coder.units.cache)


def test_bpe_round_trip_in_one_pass(spark, odd_texts):
    df = docs(spark, odd_texts).select("doc_id", "text", "ids", F.lit(1).alias("decoded"))
    got = bpe.round_trip(df)
    assert got.columns == ["doc_id", "ids", "decoded"] and got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = bpe.decode(bpe.encode(df).drop("text"))
    assert sorted(got.collect(), key=lambda x: x["doc_id"]) == sorted(want.select(*got.columns).collect(), key=lambda x: x["doc_id"])


def test_op8_against_brute_force(spark):
    """The query over its whole table."""
    lengths = [len(library(bpe.RANKS).encode_ordinary(r["text"] or "")) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = token_counts.op8_token_counts(spark, SMALL).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in rows} == Counter(lengths)
    for r in rows[::20]:
        assert r["truncated_total"] == sum(min(v, r["n_tokens"]) for v in lengths) and r["docs_at_least"] == sum(v >= r["n_tokens"] for v in lengths)


def test_op7_held_out_accuracy(spark):
    """The query over its whole table: held-out documents, whose labels it doesn't learn."""
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, SMALL).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in got.items())
    held = [(r["predicted"], labels[k]) for k, r in got.items() if r["held_out"] and labels.get(k) is not None]
    assert np.mean([p == y for p, y in held]) > 0.85 and sum(y for _, y in held) > 3  # 36 toxic examples; larger tables do better
    assert np.mean([p for p, y in held if y]) >= 0.8


def test_toxicity_of_odd_rows(spark):
    """Empty tables, long texts, repeated rows, ties, clashing columns."""
    rows = toxic_corpus(random.Random(5), 300)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit("mine"))
    index = toxicity.fit(df, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(900, "vile rotten awful " * 50_000), (901, "vile rotten"), (901, "vile rotten"), (None, "vile rotten"), (902, "\u65e5\u672c 12 !?")], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = sorted(((r["doc_id"] or 0), r["score"]) for r in toxicity.scored(odd, index).collect())
    assert [k for k, _ in got] == [0, 900, 901, 901, 902] and got[0][1] == got[2][1] == got[3][1] and all(0 <= s <= 1 for _, s in got)
    assert got[4][1] == index.blank
    assert toxicity.scored(df.limit(0), index).count() == 0 == toxicity.filtered(df.limit(0), index).count()
    assert toxicity.scored(df, toxicity.fit(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).select("score").distinct().count() == 1


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, no labels, long texts, repeated ids, rows without an id, clashing columns."""
    import corpus_pipeline

    def tables(name, rows, labels):
        df = spark.createDataFrame(rows, DOCS)
        for c in ("score", "spans", "component_id", "kept", "length", "k", "row"):
            df = df.withColumn(c, F.lit("mine"))
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        return str(tmp_path / name)

    assert corpus_pipeline.run(spark, tables("empty", [], [])).count() == 0
    r = random.Random(2)
    long_ = " ".join(words(r, 60_000))
    one, two = " ".join(words(r, 50)), " ".join(words(r, 50))
    rows = [(1, long_, "en", "s", 1), (2, long_ + " end", "en", "s", 1), (3, one, "en", "s", 1), (3, two, "en", "s", 1), (None, two, "en", "s", 1), (None, None, "en", "s", None), (7, "", "en", "s", 0)]
    path = tables("odd", rows, [(1, 1, None)])
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(path + "/documents.parquet"), path)
    assert first.count() == 7 and first.columns[5:] == ["score", "spans", "component_id", "kept", "length", "k", "row"]
    out = corpus_pipeline.run(spark, path).collect()
    assert Counter(x["doc_id"] for x in out if x["piece"] == 0) == {1: 1, 3: 1, None: 2, 7: 1}
    kept = spark.createDataFrame([(min(one, two),)], "text string")
    assert {x["ids_crc32"] for x in out if x["doc_id"] == 3} == {x["ids_crc32"] for x in packing.packed(kept.withColumn("doc_id", F.lit(3))).collect()}
