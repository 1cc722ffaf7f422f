"""Operator 5 - sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At every level each child of the node it stands in draws
``-ln(u)/weight``, with ``u`` hashed from the row's id and the child's name and ``weight`` the sum of
the child's shards; the least draw wins. So a row goes to a child with the chance of its weight, and
only the children of the chosen nodes are drawn, however many shards there are elsewhere.

The least draw of the top level is exponential with the weight of the whole tree. What is added later,
a shard or more weight for one, draws against it in the same way, and takes a row if its own draw is
less: rows move only into the shard whose weight grew, with the chance that its new share asks for, and
nothing moves in any other subtree.

Law: ``key`` - the id and the tree alone decide. Null ids share one draw and so one shard; equal ids
share a shard, repeated rows have slots of their own; null and empty texts have size 8; texts of any
length count whole. An empty table gives an empty result. Only the named columns are read. All
expressions are built in; no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import rank_within, staged

REGION, RACK, SHARD, ADDED = range(4)


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


@dataclass(frozen=True)
class HashTree:
    """Shards grouped in racks of regions, and what was added since; weights must be positive."""

    shards: tuple[Shard, ...]
    seed: int = 20011
    added: tuple[Shard, ...] = ()

    def __post_init__(self):
        if not self.shards or any(s.weight <= 0 for s in (*self.shards, *self.added)):
            raise ValueError("a hash tree needs shards with positive weights")

    @classmethod
    def regular(cls, n: int, per_rack: int = 4, racks_per_region: int = 2, seed: int = 20011) -> HashTree:
        per_region = per_rack * racks_per_region
        return cls(tuple(Shard(i, i // per_region, i % per_region // per_rack) for i in range(n)), seed)

    def plus(self, shard: Shard) -> HashTree:
        """The tree with a new shard, or with more weight for one that it has."""
        return replace(self, added=(*self.added, shard))

    def grown(self, per_rack: int = 4, racks_per_region: int = 2) -> HashTree:
        """The tree with one more shard in the next free place of a regular layout."""
        n, per_region = max(s.number for s in (*self.shards, *self.added)) + 1, per_rack * racks_per_region
        return self.plus(Shard(n, n // per_region, n % per_region // per_rack))

    def draw(self, key: Column, level: int, name: Column, weight: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(self.seed), F.lit(level), name), 11)
        return -F.log((bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)) / weight

    def _winner(self, key: Column, level: int, children: Column) -> Column:
        """``struct<draw, name>`` of the child with the least draw; ``children`` are ``struct<name, weight>``."""
        return F.array_min(F.transform(children, lambda c: F.struct(self.draw(key, level, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"))))

    def _nodes(self) -> list[dict[tuple, float]]:
        """Of each level, the paths of its nodes and their weights."""
        levels: list[dict[tuple, float]] = [{}, {}, {}]
        for s in self.shards:
            path = (s.region, s.rack, s.number)
            for depth in range(3):
                levels[depth][path[: depth + 1]] = levels[depth].get(path[: depth + 1], 0.0) + s.weight
        return levels

    def descend(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with ``__least`` (the top level's draw), ``__region, __rack, __shard``, each by one level's draws."""
        regions, racks, shards = self._nodes()
        child = lambda name, weight: F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"))
        # names are places in the lists of the level above, shards their numbers
        first = list(regions)
        second = {r: [p for p in racks if p[:1] == r] for r in first}
        own = lambda rack: F.array(*[child(p[2], w) for p, w in shards.items() if p[:2] == rack])
        top = F.array(*[child(k, regions[r]) for k, r in enumerate(first)])
        middle = F.array(*[F.array(*[child(sum(len(second[q]) for q in first[:k]) + j, racks[p]) for j, p in enumerate(second[r])]) for k, r in enumerate(first)])
        every = [p for r in first for p in second[r]]
        bottom = F.array(*[own(p) for p in every])
        name = lambda level, at: self._winner(F.col(key), level, F.element_at(at[0], F.col(at[1]) + 1))["name"]
        out = df.withColumn("__top", self._winner(F.col(key), REGION, top))
        out = out.withColumns({"__least": F.col("__top")["draw"], "__place": F.col("__top")["name"]}).drop("__top")
        out = out.withColumn("__rack", name(RACK, (middle, "__place")))
        out = out.withColumn("__shard", name(SHARD, (bottom, "__rack")))
        named = lambda values, at: F.element_at(F.array(*map(F.lit, values)), F.col(at) + 1)
        return out.withColumns({"__region": named([r[0] for r in first], "__place"), "__rack": named([p[1] for p in every], "__rack")}).drop("__place")

    def place(self, key: str) -> Column:
        """``struct<draw, region, rack, shard>`` from the columns of :meth:`descend` and the draws of what was added."""
        least = F.struct(F.col("__least").alias("draw"), F.col("__region").alias("region"), F.col("__rack").alias("rack"), F.col("__shard").alias("shard"))
        late = [F.struct(self.draw(F.col(key), ADDED + k, F.lit(s.number), F.lit(float(s.weight))).alias("draw"), F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack"), F.lit(s.number).alias("shard")) for k, s in enumerate(self.added)]
        return F.array_min(F.array(least, *late)) if late else least


def assign(df: DataFrame, tree: HashTree, key: str = "doc_id", grown: HashTree | None = None) -> DataFrame:
    """``df`` with ``region, rack, shard`` (and ``grown_shard``, by a tree grown from ``tree``); columns of those names are replaced."""
    if grown and (grown.shards, grown.seed) != (tree.shards, tree.seed):
        raise ValueError("a grown tree adds to the one it grew from")
    out = tree.descend(df, key).withColumn("__at", tree.place(key))
    if grown:
        out = out.withColumn("grown_shard", grown.place(key)["shard"])
    return out.withColumns({c: F.col("__at")[c] for c in ("region", "rack", "shard")}).drop("__at", "__least", "__region", "__rack", "__shard")


def sharded(df: DataFrame, tree: HashTree, grown: HashTree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A manifest: one row per row of ``df`` with size, checksum, shard, slot in the shard and grown shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = staged(assign(rows, tree, "doc_id", grown).withColumn("law", F.lit("key")))
    return rank_within(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = HashTree.regular(24)
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), tree, tree.grown())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")
