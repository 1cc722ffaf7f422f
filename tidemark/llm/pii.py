"""Operator 2 - personal data by candidate gradient boosting.

Four base patterns (email, ip, card, phone) give spans that always stay. High-recall generators
propose further, overlapping spans: spelled-out addresses, national phone numbers, cards with odd
separators, IPv6. Boosted trees score each proposal by its format and its context, the scores are
calibrated on held-out proposals, and a proposal is taken above its kind's threshold if no base span
and no better proposal overlaps it. The trees are fitted on the driver from ``TRAIN`` generated
proposals of either label; nothing is learned from the corpus.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Texts of any length are
read whole, in time that grows with their length. Repeated rows get equal spans, each row its own. An
empty table gives an empty result; other columns pass through, and one named like the output is
replaced.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import modest_batches
from .boosting import BoostedTrees, platt

KINDS = ("email", "ip", "card", "phone")
#: Generated training proposals, and the precision that thresholds hold on held-out ones.
TRAIN, PRECISION = 8000, 0.99

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind as listed and then by start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) < 20 and int(p) <= 255 or len(p) >= 20 and int(p.lstrip("0")[:20] or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


AT = r"\s?(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\])\s?"
DOT = r"(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\s?|\.)"
#: Kind, what a text must hold for the pattern to match at all (cheap to look for), and the pattern.
GENERATORS: tuple[tuple[str, re.Pattern | None, re.Pattern], ...] = (
    ("email", re.compile(r"[(\[{<](?:at|@)[)\]}>]", re.I), re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I)),
    ("email", re.compile(" dot ", re.I), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+", re.I)),
    ("phone", None, re.compile(r"(?<![0-9A-Za-z+.])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")),
    ("card", None, re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}(?:[ ]{0,2}[./_–-]?[ ]{0,2}[0-9]{4}){2}[ ]{0,2}[./_–-]?[ ]{0,2}[0-9]{1,7}(?![0-9A-Za-z])")),
    ("ip", re.compile(":"), re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![0-9A-Za-z:])")),
)
CONTEXT = tuple(re.compile(p, re.I) for p in (r"phone|tel\b|tel[.:]|call|mobile|cell|fax|whatsapp|contact|\bdial", r"mail|write|contact|reach|@", r"card|visa|master|amex|credit|debit|\bcc\b|pay", r"\bip\b|ipv6|host|server|addr|login|client", r"version|\bv\b|order|invoice|isbn|issn|sku|part|serial|ticket|ref|page|section|figure|no\.|nr\.|date|year|price|total|mac\b|hash|score|\bid\b"))
MONEY = frozenset("$€£¥#=/%*")
FEATURES = 23


def features(text: str, kind: str, generator: int, start: int, end: int) -> list[float]:
    """Format of the span and its neighbourhood."""
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    before, left, right = text[max(0, start - 40) : start], text[start - 1 : start], text[end : end + 1]
    tail = re.split(r"[^A-Za-z]+", span)[-1] if kind == "email" else ""
    seps = {c for c in span if not c.isalnum()}
    return [
        *(float(kind == k) for k in KINDS), float(generator), float(len(span)), float(len(digits)), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[0]),
        float(len(seps)), float("(" in span), float(digits.startswith("00")), float(13 <= len(digits) <= 19 and luhn(digits)), float(2 <= len(tail) <= 6),
        float(left in MONEY) + 2.0 * float(left.isalnum()), float(right in MONEY), *(float(bool(p.search(before))) for p in CONTEXT),
    ]


def proposals(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, generator, start, end) of every proposal; they may overlap."""
    out = []
    for g, (kind, needs, pattern) in enumerate(GENERATORS):
        if needs and not needs.search(text):
            continue
        out += [(kind, g, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def _generated(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of proposals in invented sentences: personal data in a telling context, and look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    hex_ = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, k)))

    def valid_card() -> str:
        body = r.choice("3456") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def positive() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            dot = r.choice([".", " (dot) ", "[dot]", " [dot] "])
            text = r.choice([f"{word()}.{word()} (at) {word()}{dot}com", f"{word()}[at]{word()}{dot}org", f"{word()}{d(2)} at {word()} dot com", f"{word()} at {word()} dot co dot uk", f"{word()} [at] {word()}{dot}net"])
            return r.choice(["mail me: ", "contact ", "write to ", "e-mail: ", "reach me at ", word() + " "]), text
        if kind == "phone":
            sep = r.choice(" .-")
            text = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}"])
            return r.choice(["phone: ", "call ", "tel. ", "my mobile is ", "fax ", "contact: ", "whatsapp "]), text
        if kind == "card":
            c = valid_card()
            sep = r.choice([".", "/", " - ", "  ", "_", "–"])
            return r.choice(["card ", "visa: ", "credit card number ", "pay with ", "my cc "]), sep.join(c[i : i + 4] for i in range(0, 16, 4))
        return r.choice(["host ", "ip ", "server ", "login from ", "client addr "]), ":".join(f"{hex_(4)}" for _ in range(8))

    def negative() -> tuple[str, str]:
        return r.choice(["", "order ", "invoice no. ", "version ", "isbn ", "part ", "page ", "total $", "ref ", "date ", word() + " ", "figure ", "id=", "serial ", "mac "]), r.choice([f"{d(4)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(4)}", f"{d(2)}-{d(4)}-{d(4)}", f"{d(4)}.{d(4)}.{d(4)}.{d(3)}", f"{d(4)}/{d(4)}/{d(4)}/{d(4)}", f"19{d(2)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{word()} at {word()} dot {word()}ness", "::", f"{hex_(4)}::", f"{d(2)}::{d(2)}"])

    x, y = [], []
    while len(y) < n:
        label = int(r.random() < 0.5)
        before, body = positive() if label else negative()
        lead = " ".join(word() for _ in range(r.randint(3, 8))) + " " + before
        text = lead + body + r.choice([" ", ". ", ", "]) + word()
        lo, hi = len(lead), len(lead) + len(body)
        for kind, g, a, b in proposals(text):
            if a < hi and b > lo:
                x.append(features(text, kind, g, a, b))
                y.append(int(label and abs(a - lo) <= 1 and abs(b - hi) <= 1))
    return np.array(x, float).reshape(-1, FEATURES), np.array(y, float)


class Model:
    """Trees, calibration and a threshold per kind."""

    def __init__(self, n: int = TRAIN, precision: float = PRECISION, seed: int = 5):
        x, y = _generated(n, seed)
        held = np.arange(len(y)) % 4 == 3
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        margin = self.trees.margin(x[held])
        self.slope, self.offset = platt(margin, y[held])
        p = self.probability(x[held])
        self.thresholds = {}
        for k, kind in enumerate(KINDS):
            own = x[held][:, k] == 1
            order = np.argsort(-p[own], kind="stable")
            hits, score = y[held][own][order], p[own][order]
            good = np.flatnonzero(np.cumsum(hits) / np.arange(1, len(hits) + 1) >= precision) if len(hits) else []
            self.thresholds[kind] = max(0.5, float(score[good[-1]])) if len(good) else 2.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.margin(x) + self.offset)))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return Model()


class Taken:
    """Disjoint ranges of a text, in order: those that are taken, neighbours merged."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a), self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1  # the last that starts before b
        return k >= 0 and self.ends[k] > a

    def add(self, a: int, b: int) -> None:
        """Take a range that meets none."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a), self.ends.insert(k, b)


def find(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    bases = [base_spans(t) for t in texts]
    rows, owner, taken = [], [], [Taken(b) for b in bases]
    for k, t in enumerate(texts):
        for kind, g, a, b in proposals(t):
            if not taken[k].meets(a, b):
                rows.append((kind, g, a, b)), owner.append(k)
    added: list[list[Span]] = [[] for _ in texts]
    if rows:
        p = model.probability(np.array([features(texts[k], *row) for k, row in zip(owner, rows, strict=True)]))
        for j in np.argsort(-p, kind="stable").tolist():
            kind, _, a, b = rows[j]
            if p[j] >= model.thresholds[kind] and not taken[owner[j]].meets(a, b):
                taken[owner[j]].add(a, b)
                added[owner[j]].append((kind, a, b))
    return [(base, sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))) for base, more in zip(bases, added, strict=True)]


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def detect(df: DataFrame, text: str = "text", spans: str = "spans", model: Model | None = None) -> DataFrame:
    """``df`` with the spans of its texts (kind, start, end, base), by kind as listed and then by start."""
    model = model or default_model()
    modest_batches(df.sparkSession)
    df = df.drop(spans)
    k = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find([t or "" for t in batch.column(k).to_pylist()], model)
            rows = [sorted([{"kind": x, "start": a, "end": b, "base": base} for base, own in ((True, own_), (False, more)) for x, a, b in own], key=lambda s: (KINDS.index(s["kind"]), s["start"], s["end"])) for own_, more in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, SPAN_ARROW)], names=[*batch.schema.names, spans])

    return df.mapInArrow(run, df.select("*", F.expr(f"cast(array() as {SPAN})").alias(spans)).schema)


def redact_text(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars", model: Model | None = None) -> DataFrame:
    """``df`` with personal data in its texts replaced; ``n_chars``, if there, is the new length. Null texts stay null."""
    model = model or default_model()
    modest_batches(df.sparkSession)
    k = df.columns.index(text)
    c = df.columns.index(n_chars) if n_chars in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(k).to_pylist()
            out = [None if t is None else redact_text(t, base + more) for t, (base, more) in zip(texts, find([t or "" for t in texts], model), strict=True)]
            columns = batch.columns
            columns[k] = pa.array(out, batch.schema.field(k).type)
            if c is not None:
                counted = pa.array([None if t is None else len(t) for t in out], pa.int64())
                columns[c] = pa.array([old if new is None else new for old, new in zip(columns[c].to_pylist(), counted.to_pylist(), strict=True)], batch.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ``base_sha256`` are of the base spans, ``spans`` holds base and added ones."""
    docs = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return docs.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
