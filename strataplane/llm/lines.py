"""Line dedup by site-relative frequency.

For each host, a line's ratio is the share of the host's distinct pages that
contain it.  Lines above the ratio are boilerplate and go.  Equal pages count
once, so copies of one article do not turn its lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplane.llm.common import BROADCAST_BYTES, Scratch, is_word

#: In the gap of the measured line shares (README), and the pages that a line needs at a small host.
RATIO, LEAST_PAGES = 0.06, 3


def boilerplate(docs: DataFrame, host_col: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): for each host that has any, the hashes of its boilerplate lines.

    A page holds each line once, so a host has fewer than (mean lines a page) / ratio of them.
    """
    page = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lines = F.array_distinct(F.transform(F.filter(F.split("t", "\n"), is_word), lambda x: F.xxhash64(x)))
    distinct = page.select("host", F.xxhash64("t").alias("a"), F.length("t").alias("b"), lines.alias("lines")).groupBy("host", "a", "b").agg(F.first("lines").alias("lines"))
    total = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    often = seen.join(total, "host").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of text, and _n_lines, _n_dropped.

    A line is what stands between newlines; lines without a word are never
    boilerplate.  A null text stays null with 0 lines; a null host counts as
    the empty host.  Repeated rows stay; hosts of under ``least`` pages keep
    all.  Other columns are carried along whatever their names; own columns
    named _n_lines or _n_dropped are replaced.
    """
    bad = Scratch(docs.sparkSession, "lines").save(boilerplate(docs, host_col, ratio, least))
    size = bad.agg(F.coalesce(F.sum(F.size("lines") * 8 + 64), F.lit(0))).first()[0]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(row.alias("row"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), F.split(F.col("text").cast("string"), "\n").alias("own"))
    out = carried.join(F.broadcast(bad) if size <= BROADCAST_BYTES else bad, "host", "left")
    here = F.array_intersect(F.transform("own", lambda x: F.xxhash64(x)), F.col("lines"))
    out = out.select("row", "own", F.when(F.col("lines").isNotNull(), here).alias("here"))
    kept = F.when(F.coalesce(F.size("here"), F.lit(0)) > 0, F.filter("own", lambda x: ~F.array_contains("here", F.xxhash64(x)))).otherwise(F.col("own"))
    out = out.select("row", "own", kept.alias("kept"))
    n = F.coalesce(F.size("own"), F.lit(0)).cast("long")
    counts = {"_n_lines": n, "_n_dropped": (n - F.coalesce(F.size("kept"), F.lit(0))).cast("long")}
    own = [F.array_join("kept", "\n").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in counts]
    return out.select(*own, *[v.alias(c) for c, v in counts.items()])
