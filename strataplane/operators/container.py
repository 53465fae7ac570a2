"""Container resolution as joins and windows: properties, references, runs, offsets, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def item_properties(associations: DataFrame, properties: DataFrame) -> DataFrame:
    """Associations (item, pos, prop_index, essential) with their properties (prop_index, type, ..).

    Index 0 means none; a transformative property must be essential to count.
    """
    linked = associations.where("prop_index <> 0").join(properties, "prop_index")
    return linked.where(F.col("essential") | ~F.col("type").isin("clap", "irot", "imir"))


def first_property(linked: DataFrame, value: str) -> DataFrame:
    """(item, type, value): the first of each type in association order; combines before the shuffle."""
    return linked.groupBy("item", "type").agg(F.min_by(value, F.struct("pos", "prop_index")).alias(value))


def unique_violations(linked: DataFrame) -> DataFrame:
    """(item, type, n) where an item has a property type more than once."""
    return linked.groupBy("item", "type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def auxiliary(edges: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """(item, aux): edges (from_id, to_id) in either direction that end at an item (id) of a kind; the smallest id wins."""
    either = edges.select(F.col("to_id").alias("item"), F.col("from_id").alias("aux")).unionByName(edges.select(F.col("from_id").alias("item"), F.col("to_id").alias("aux")))
    of_kind = kinds.where(F.col("kind") == kind).select(F.col("id").alias("aux"))
    return either.join(of_kind, "aux", "left_semi").groupBy("item").agg(F.min("aux").alias("aux"))


def preferred(ids: Column, first: Column, other: Column) -> Column:
    """Whether ``first`` stands before ``other`` in an ordered group; false unless both are in it."""
    a, b = F.array_position(ids, first), F.array_position(ids, other)
    return (a > 0) & (b > 0) & (a < b)


def expand_runs(runs: DataFrame, keys: list[str], count: str, value: str) -> DataFrame:
    """(keys, i, value): run-length rows, one a sample; runs are explodes, so they may split over tasks."""
    return runs.select(*keys, F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)).alias("i"), value)


def chunk_runs(chunks: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Chunks (key, chunk) with the run (key, first_chunk, per_chunk) that holds them: the last that starts at or before.

    As-of join without a range join: runs and chunks in one ordered window.
    """
    both = chunks.select(key, "chunk", F.lit(None).cast("bigint").alias("per_chunk"), F.lit(1).alias("side")).unionByName(runs.select(key, F.col("first_chunk").alias("chunk"), F.col("per_chunk").cast("bigint").alias("per_chunk"), F.lit(0).alias("side")))
    w = W.partitionBy(key).orderBy("chunk", "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("per_chunk", F.last("per_chunk", ignorenulls=True).over(w)).where("side = 1 and per_chunk is not null").drop("side")


def sample_offsets(samples: DataFrame, keys: list[str], order: list[str], base: str, size: str) -> DataFrame:
    """Adds offset: the chunk's base and the sizes before the sample in its chunk."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return samples.withColumn("offset", F.col(base) + F.coalesce(F.sum(size).over(w), F.lit(0)))


#: Values of the order that one task sums at most for a key, as a power of two.
SPAN_BITS = 16


def sum_before(rows: DataFrame, key: str, order: str, value: str, name: str, span_bits: int = SPAN_BITS) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows of the key that come earlier by ``order``, integers that are unique within it; 0 for the first.

    A key is dealt to spans of ``order``, so one that holds most rows takes
    many tasks.  Each span begins with a row that carries the sum of the spans
    before it, which is taken over one row a span.  Null keys are one key; the
    names ``_span`` and ``_carried`` are taken.
    """
    dealt = rows.withColumn("_span", F.shiftright(F.col(order).cast("bigint"), span_bits))
    w = W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = dealt.groupBy(key, "_span").agg(F.sum(value).alias("s")).select(key, "_span", F.coalesce(F.sum("s").over(w), F.lit(0)).cast("bigint").alias("_carried"))
    each = dealt.withColumn("_carried", F.lit(None).cast("bigint")).unionByName(carried, allowMissingColumns=True)
    within = W.partitionBy(key, "_span").orderBy(F.col("_carried").desc_nulls_last(), order).rowsBetween(W.unboundedPreceding, -1)
    total = F.sum(F.coalesce("_carried", value, F.lit(0))).over(within).cast("bigint")
    return each.withColumn(name, total).where("_carried is null").drop("_span", "_carried")


def timeline(samples: DataFrame, key: str, order: str, duration: str, timescale: int) -> DataFrame:
    """Adds start_ticks and start_ms, the running sum of durations before each sample."""
    ticks = sum_before(samples, key, order, duration, "start_ticks")
    return ticks.withColumn("start_ms", F.call_function("div", F.col("start_ticks") * 1000, F.lit(timescale).cast("bigint")))


def repetitions(track: Column, segment: Column, repeats: Column) -> Column:
    """Times that a sequence repeats: 0 without the flag, -1 (without end) for a null track, -2 (unknown) for an empty segment, else ceil(track / segment) - 1."""
    n = F.call_function("div", track + segment - 1, F.when(segment > 0, segment).otherwise(F.lit(1).cast("bigint"))) - 1
    return F.when(~repeats, F.lit(0).cast("bigint")).when(segment.isNull() | (segment <= 0), F.lit(-2).cast("bigint")).when(track.isNull(), F.lit(-1).cast("bigint")).otherwise(n)


def in_operating_point(temporal: Column, spatial: Column, idc: int) -> Column:
    """Whether a record with these layers belongs to an operating point; idc 0 takes all."""
    if idc == 0:
        return F.lit(True)
    point = F.lit(idc).cast("bigint")
    one = F.lit(1).cast("bigint")
    bit = lambda n: F.call_function("shiftright", point, n.cast("int")).bitwiseAND(one) == 1
    return bit(temporal) & bit(spatial + 8)


def refreshed_slots(frames: DataFrame, stream: str, order: str, mask: str, slots: int = 8) -> DataFrame:
    """(stream, slot, frame): the last frame in order whose mask has the slot's bit; combines before the shuffle."""
    each = frames.select(stream, order, F.explode(F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.call_function("shiftright", F.col(mask), s).bitwiseAND(F.lit(1).cast("bigint")) == 1)).alias("slot"))
    return each.groupBy(stream, "slot").agg(F.max(order).alias("frame"))


def payloads(extents: DataFrame, key: str, order: str, part: str) -> DataFrame:
    """(key, payload, n): the parts of each key in order, concatenated."""
    return extents.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, part))), lambda x: x[part]), "").alias("payload"), F.count(F.lit(1)).alias("n"))
