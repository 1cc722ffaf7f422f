"""Units of work for comparing all rows of a group with each other, in bounded tiles.

A group is dealt into tiles of bounded rows and weight, inside bands; only tiles of the same or
neighbouring bands meet. A unit is one pair of tiles (or one tile with itself). Each row goes to the
units of its tile, so no task holds more than two tiles however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import maybe_broadcast


def units(rows: DataFrame, group: str, band: str, weight: Column, row: Column, tile_rows: int, tile_weight: int, alone: str | None = None) -> DataFrame:
    """``rows`` with ``unit`` (an id of the pair of tiles) and ``side`` (0, 1, or 2 where a tile meets itself).

    ``row`` deals rows to tiles by hash. Rows whose unit could hold nothing else are dropped; if
    ``alone`` is given, only when the count in that column is 1 as well.
    """
    cells = rows.groupBy(F.col(group).alias("g"), F.col(band).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("weight"))
    cells = cells.withColumn("parts", F.greatest(F.ceil(F.col("rows") / tile_rows), F.ceil(F.col("weight") / tile_weight)).cast("int"))
    # what each cell needs to know of its neighbour above
    up = cells.select("g", (F.col("n") - 1).alias("n"), F.col("parts").alias("above"))
    down = cells.select("g", (F.col("n") + 1).alias("n"), F.col("parts").alias("below"))
    cells = cells.join(up, ["g", "n"], "left").join(down, ["g", "n"], "left").fillna(0, ["above", "below"])
    cells = maybe_broadcast(cells.drop("weight").withColumnRenamed("rows", "cell_rows"), 64)
    x = rows.join(cells, (rows[group] == cells["g"]) & (rows[band] == cells["n"])).drop("g")
    x = x.withColumn("part", F.pmod(F.xxhash64(row, F.lit(3)), F.col("parts")).cast("int"))
    name = lambda n1, p1, n2, p2: F.xxhash64(F.col(group), n1, p1, n2, p2)
    n, p = F.col("n"), F.col("part")
    # side 0 is the lower tile; a tile meets itself once
    same = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(name(n, F.least(p, q), n, F.greatest(p, q)).alias("unit"), F.when(p == q, 2).when(p < q, 0).otherwise(1).alias("side")))
    none = F.array().cast("array<struct<unit:bigint,side:int>>")
    above = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda q: F.struct(name(n, p, n + 1, q).alias("unit"), F.lit(0).alias("side")))).otherwise(none)
    below = F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda q: F.struct(name(n - 1, q, n, p).alias("unit"), F.lit(1).alias("side")))).otherwise(none)
    lone = (F.col("cell_rows") == 1) & (F.col("above") + F.col("below") == 0)
    if alone:
        lone = lone & (F.col(alone) == 1)
    x = x.where(~lone).withColumn("u", F.explode(F.concat(same, above, below)))
    return x.select(*rows.columns, "u.unit", "u.side")
