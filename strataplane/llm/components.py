"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplane.llm.common import Scratch


#: Parts that a centre's edges are dealt to, where some centre has more than HOT of them.
SALTS, HOT = 1024, 10_000


def _with_nearest(edges: DataFrame, hot: bool) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v) with m, the smallest neighbour of u or u itself; and (u, m) alone.

    With ``hot``, no task meets all edges of a centre: they are dealt by
    (u, salt of v), each part's minimum goes to u, and u's minimum back to its
    at most SALTS parts.
    """
    if not hot:
        low = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return edges.join(low, "u"), low
    salted = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("p"))
    low = parts.groupBy("u").agg(F.least(F.min("p"), F.first("u")).alias("m"))
    return salted.join(parts.select("u", "s").join(low, "u"), ["u", "s"]).drop("s"), low


def _mark(edges: DataFrame, by: str = "v") -> tuple[tuple, int]:
    """(what tells edge tables apart, most edges of one ``by``); sums combine before the shuffle."""
    each = edges.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    n, x, most = each.agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first()
    return (n, x), most or 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in ``edges`` (u, v), component the smallest id reachable.

    Alternates large-star and small-star steps until the edges stay the same,
    which takes about log(n) rounds; each round's edges are a written table.
    Centres of many edges are dealt to parts, so their edges never meet in one task.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, most = _mark(now)
    most = max(most, _mark(now, "u")[1])
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_nearest(both, most > HOT)[0].where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs, low = _with_nearest(large, most > HOT)
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = scratch.save(small.where("u <> v").distinct())
        scratch.drop(now)
        (now, before), (mark, most) = (after, mark), _mark(after)
        if mark == before:
            break
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
