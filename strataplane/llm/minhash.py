"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges.

Distinct shingle sets ("classes") are sketched with one hash function: the top
bits of a shingle's value choose a bin and the smallest value in the bin is
kept.  Empty bins borrow from a non-empty bin chosen by a fixed random probe
sequence (optimal densification).  Bands of bins are buckets.  Instead of all
pairs in a bucket, each member is compared with one centre, so candidates grow
with the number of members; comparisons are exact, on full sets.  Buckets whose
members are not one component afterwards are finished exactly: first with
further centres, then by comparing what is still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataplane.llm.common import Scratch
from strataplane.llm.components import components
from strataplane.llm.shingles import U, mix, shingle_sets

#: 32 bands of 6 bins: a pair at 0.85 shares no band with probability 3e-7, one at 0.4 shares one with probability 0.12.
BANDS, ROWS = 32, 6
#: Centres differ by band modulo this, so groups of near copies meet several centres in the first round.
CENTRES = 4
#: Shingles in a block of the exact comparison that follows the stars; a set of more is a block with few others.
BLOCK = 100_000
#: Parts that the members of one centre are dealt to when they are verified.
SALTS = 256
#: Blocks of outside members that one task compares.
SPREAD = 8
MAX_PROBES = 64


def _probe_table(bins: int) -> np.ndarray:
    """probe[i, j]: the bin that empty bin j tries i-th."""
    grid = np.arange(MAX_PROBES * bins, dtype=U).reshape(MAX_PROBES, bins)
    return (mix(grid + U(0x51ED270B35)) % U(bins)).astype(np.int64)


def sketch(values: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """Densified one-permutation sketch of a sorted set of 64-bit values."""
    where = (values >> U(32)) * U(bins) >> U(32)
    used, first = np.unique(where.astype(np.int64), return_index=True)
    out = np.zeros(bins, dtype=U)
    filled = np.zeros(bins, dtype=bool)
    out[used], filled[used] = values[first], True
    source = np.arange(bins)
    empty = np.flatnonzero(~filled)
    for i in range(MAX_PROBES):
        if not len(empty):
            break
        at = probes[i, empty]
        hit = filled[at]
        source[empty[hit]] = at[hit]
        empty = empty[~hit]
    source[empty] = used[0]  # a set of very few values: fixed choice, equal for equal sets of bins
    return out[source]


def band_keys(values: np.ndarray, bands: int, rows: int, probes: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, distinct between bands."""
    bins = sketch(values, bands * rows, probes).reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = mix(key * U(0x100000001B3) + bins[:, r])
    return key


def _sketcher(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probe_table(bands * rows)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, max(1, len(texts)), 2000):
                part = texts.slice(at, 2000)
                sets = shingle_sets(part.to_pylist(), width)
                weight = [mix(s).sum(dtype=U) if len(s) else U(0) for s in sets]
                other = [mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U) if len(s) else U(0) for s in sets]
                keys = [band_keys(s, bands, rows, probes) for s in sets if len(s)]
                flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([bands if len(s) else 0 for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, 2000),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array(weight, U).view(np.int64), pa.int64()),
                        pa.array(np.array(other, U).view(np.int64), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _set_maker(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 1000):
                sets = shingle_sets(texts.slice(at, 1000).to_pylist(), width)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([s.view(np.int64) for s in sets]) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "set"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those with 100 * intersection >= percent * union of their full sets.

    ``a`` is a centre of many pairs: they are dealt to SALTS parts by ``b``,
    and the centre's set travels once to each part, not once a member.
    """
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    left = salted.select("a", "s").distinct().join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = salted.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(left, ["a", "s"])
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _compare_blocks(percent: int):
    """Rows hold a block of sets xs and a block ys: for each x one partner of every other component, by one inverted index a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for row in range(batch.num_rows):
                (xi, xc, xs), (yi, yc, ys) = (_unpack(batch.column(c)[row]) for c in (0, 1))
                sizes = np.array([len(s) for s in ys])
                owner = np.repeat(np.arange(len(ys)), sizes)
                flat = np.concatenate(ys)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                for i, c, s in zip(xi, xc, xs, strict=True):
                    lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                    n = hi - lo
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    shared = np.bincount(owner[at], minlength=len(ys))
                    near = np.flatnonzero((100 * shared >= percent * (sizes + len(s) - shared)) & (yc != c))
                    if len(near):
                        _, first = np.unique(yc[near], return_index=True)
                        u += [i] * len(first)
                        v += yi[near[first]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _unpack(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    items = cell.values
    ids, comps = (items.field(n).to_numpy(zero_copy_only=False) for n in ("id", "comp"))
    ends, flat = items.field("set").offsets.to_numpy(), items.field("set").values.to_numpy(zero_copy_only=False)
    return ids, comps, [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _side_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of the same application with settings of its own, so that other queries keep theirs."""
    side = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if side.conf.isModifiable(name):
            side.conf.set(name, value)
    for name, value in settings.items():
        side.conf.set(name.replace("__", "."), value)
    return side


def apart(held: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) that the stars left out, from bucket members (key, id, comp); ``sets`` is a written table.

    In each bucket that holds several components, the members outside the
    largest one (the lead) have to be compared with all the others.  Buckets of
    one lead are taken together, and blocks of their outside members are
    compared with blocks of all their members, so no row is made for a pair.
    The work is the product of the outside members and all members of a lead;
    the stars before it keep the outside few (README: what check_h needs).
    """
    parts = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    lead = parts.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("lead"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    sized = sets.select("id", F.size("set").alias("n"))
    chosen = scratch.save(held.join(lead, "key").groupBy("lead", "id").agg(F.first("comp").alias("comp")).join(sized, "id"))
    side = _side_session(held.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="4")  # a row holds two blocks of sets
    member, sets = scratch.reread(chosen, side), scratch.reread(sets, side)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        size = rows.groupBy("lead").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
        block = F.pmod(F.xxhash64("id"), F.col("blocks"))
        return rows.drop("n").join(size, "lead").join(sets, "id").withColumn("block", block).groupBy("lead", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("id", "comp", "set")).alias(name))

    # a large group's outside blocks are dealt to several tasks, SPREAD to each
    outside = member.where("comp <> lead")
    xs = blocks(outside, "xs").withColumn("share", F.floor(F.col("block") / SPREAD))
    shares = outside.groupBy("lead").agg(F.ceil(F.ceil(F.sum("n") / BLOCK) / SPREAD).alias("shares"))
    ys = blocks(member, "ys").join(shares, "lead").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    pairs = xs.select("lead", "share", "xs").join(ys.select("lead", "share", "ys"), ["lead", "share"]).select("xs", "ys")
    return scratch.reread(scratch.save(pairs.mapInArrow(_compare_blocks(percent), "u long, v long")), held.sparkSession)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing; equal
    texts link through their class; a null doc_id is its own component (null)
    and is kept.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.save(docs.mapInArrow(_sketcher(width, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"))

    # classes of equal sets; the smallest doc_id stands for its class
    known = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(known.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands")))
    spread = classes.select("id", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    buckets = scratch.save(spread.join(shared, "key"))

    # stars: each member of a bucket with the bucket's centre
    rank = F.xxhash64("id", F.col("band") % CENTRES)
    centre = buckets.groupBy("key").agg(F.min_by(F.struct("id", "n"), F.struct(rank, "id")).alias("c"))
    pairs = buckets.join(centre, "key").where("id <> c.id").where(100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
    first = scratch.save(pairs.select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct())
    nodes = buckets.select("id").distinct()
    sets = (docs.join(nodes.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(_set_maker(width), "id long, set array<long>"))
    own = classes.select("id", "n_shingles")
    sets = scratch.save(sets.join(own, "id").where(F.size("set") == F.col("n_shingles")).select("id", "set"))  # rows that repeat a doc_id with other texts
    edges = scratch.save(verify(first, sets, percent))
    found = scratch.save(components(edges, scratch))
    held = buckets.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    edges = scratch.save(edges.unionByName(apart(held, sets, percent, scratch)))
    found = scratch.save(components(edges, scratch))
    named = classes.join(found, "id", "left").select(F.col("n_shingles").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("component", "id").alias("component"))
    out = sketched.join(named, (F.col("n_shingles") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
