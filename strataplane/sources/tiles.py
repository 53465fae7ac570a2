"""Tile groups and tile lists of coded-video records: ranges of a payload as rows, without copying its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataplane.sources.headers import FRAME, Bits

TILE_GROUP, TILE_LIST = 4, 8
#: Entries of a list and anchor frames, at most.
MOST_ENTRIES, MOST_ANCHORS = 512, 128
TILES = "stream_id string, obu_index long, frame long, tile int, offset long, length long, error string"
ENTRIES = "stream_id string, obu_index long, entry int, output_columns int, output_rows int, anchor int, tile_row int, tile_column int, offset long, length long, error string"


def group(data: bytes, at: int, columns: int, rows: int, index_bits: int, size_bytes: int) -> list[tuple[int, int, int]]:
    """(tile, offset, length) of the tiles of a group whose header begins at byte ``at``; the last one takes what is left."""
    total, head = columns * rows, Bits(data[at : at + 3])
    first, last = 0, total - 1
    if total > 1 and head.flag():
        first, last = head.u(index_bits), head.u(index_bits)
    if first > last:
        raise ValueError("a tile group ends before it starts")
    if last >= total:
        raise ValueError("a tile group leaves the frame")
    at += head.at + 7 >> 3
    out = []
    for tile in range(first, last):
        if at + size_bytes > len(data):
            raise ValueError("a tile size leaves the record")
        n = int.from_bytes(data[at : at + size_bytes], "little") + 1
        at += size_bytes
        if at + n > len(data):
            raise ValueError("a tile leaves the record")
        out.append((tile, at, n))
        at += n
    return [*out, (last, at, len(data) - at)]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for i, (stream, index, frame, at, columns, lines, index_bits, size_bytes) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True)):
            try:
                if columns is None:
                    raise ValueError("no frame header")
                data = batch.column(8)[i].as_py() or b""
                rows += [(stream, index, frame, *tile, None) for tile in group(data, at, columns, lines, index_bits, size_bytes)]
            except ValueError as e:
                rows.append((stream, index, frame, None, None, None, "a tile group ends early" if "early" in str(e) else str(e)))
        names = [f.split()[0] for f in TILES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=names)


def tile_ranges(records: DataFrame, headers: DataFrame) -> DataFrame:
    """TILES rows of the tile groups among ``records`` (stream_id, obu_index, unit, type, payload), by the frame header in force.

    ``headers``: rows of ``headers.headers`` with ``tiling`` and ``header_bits`` among its fields.  A record of type FRAME holds its own header; other groups take the
    last header before them in their unit.  A group without header, or that leaves its frame or record, gives one row with an error and no tile.  Offsets are from the
    payload's first byte.
    """
    t = F.col("header.tiling")
    known = headers.where("header is not null").select(
        "stream_id", F.coalesce("unit", F.lit(0).cast("long")).alias("unit"), F.col("obu_index").alias("at"), F.struct(F.col("obu_index").alias("frame"), t["columns"].alias("columns"), t["rows"].alias("rows"), (t["log2_columns"] + t["log2_rows"]).alias("bits"), t["size_bytes"].alias("size_bytes"), F.shiftright(F.col("header.header_bits") + 7, 3).cast("long").alias("head")).alias("own")
    )
    held = records.where(F.col("type").isin(FRAME, TILE_GROUP)).select("stream_id", "obu_index", F.coalesce("unit", F.lit(0).cast("long")).alias("unit"), "type", "payload")
    # the header in force, over rows without payloads
    marks = known.withColumn("group", F.lit(0)).unionByName(held.select("stream_id", "unit", F.col("obu_index").alias("at"), F.lit(None).cast(known.schema["own"].dataType).alias("own"), F.lit(1).alias("group")))
    before = W.partitionBy("stream_id", "unit").orderBy("at", "group").rowsBetween(W.unboundedPreceding, 0)
    force = marks.withColumn("own", F.last("own", ignorenulls=True).over(before)).where("group = 1").select("stream_id", F.col("at").alias("obu_index"), "own")
    joined = held.join(force, ["stream_id", "obu_index"]).withColumn("own", F.when((F.col("type") != FRAME) | (F.col("own.frame") == F.col("obu_index")), F.col("own")))
    chosen = joined.select("stream_id", "obu_index", "own.frame", F.when(F.col("type") == FRAME, F.col("own.head")).otherwise(0).alias("at"), "own.columns", "own.rows", "own.bits", "own.size_bytes", "payload")
    return chosen.mapInArrow(_ranges, TILES)


def entries(data: bytes) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(output columns, output rows, anchor, row, column, offset, length) of the entries of a tile list."""
    if len(data) < 4:
        raise ValueError("a tile list ends early")
    columns, rows, n = data[0] + 1, data[1] + 1, int.from_bytes(data[2:4], "big") + 1
    if n > MOST_ENTRIES:
        raise ValueError("a tile list has too many entries")
    if n > columns * rows:
        raise ValueError("a tile list has more entries than places")
    at = 4
    for _ in range(n):
        if at + 5 > len(data):
            raise ValueError("a tile list ends early")
        anchor, row, column, length = data[at], data[at + 1], data[at + 2], int.from_bytes(data[at + 3 : at + 5], "big") + 1
        at += 5
        if anchor >= MOST_ANCHORS:
            raise ValueError("an anchor frame is beyond the most")
        if at + length > len(data):
            raise ValueError("a tile leaves the record")
        yield columns, rows, anchor, row, column, at, length
        at += length
    if at < len(data):
        raise ValueError("bytes after the last tile")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), *[pa.int32()] * 6, pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for stream, index, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            try:
                rows += [(stream, index, i, *e, None) for i, e in enumerate(list(entries(data or b"")))]
            except ValueError as e:
                rows.append((stream, index, *[None] * 8, str(e)))
        names = [f.split()[0] for f in ENTRIES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 11, kinds, strict=True)], names=names)


def tile_lists(records: DataFrame) -> DataFrame:
    """ENTRIES rows of the tile lists among ``records``; a list that is wrong anywhere gives one row with an error instead."""
    return records.where(F.col("type") == TILE_LIST).select("stream_id", "obu_index", "payload").mapInArrow(_entries, ENTRIES)


def resolve(lists: DataFrame, anchors: DataFrame) -> DataFrame:
    """``lists`` (ENTRIES) with the frame of each entry's anchor and its tile number there, from ``anchors`` (stream_id, anchor, frame, columns, rows).

    An entry whose anchor is not stored, or whose tile lies outside that frame's tiles, has an error and neither.  Place in the output: entries fill it by rows.
    """
    joined = lists.join(anchors, ["stream_id", "anchor"], "left")
    inside = (F.col("tile_row") < F.col("rows")) & (F.col("tile_column") < F.col("columns"))
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("frame").isNull(), "the anchor frame is not there").when(~inside, "a tile is outside its anchor frame")
    good = problem.isNull()
    place = lambda c: F.when(good, c.cast("int"))
    return joined.select(
        "stream_id", "obu_index", "entry", "anchor", F.when(good, F.col("frame")).alias("frame"), place(F.col("tile_row") * F.col("columns") + F.col("tile_column")).alias("tile"),
        place(F.call_function("div", F.col("entry").cast("long"), F.col("output_columns").cast("long"))).alias("output_row"), place(F.col("entry") % F.col("output_columns")).alias("output_column"), "offset", "length", problem.alias("error"),
    )
