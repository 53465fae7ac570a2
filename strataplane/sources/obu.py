"""Record source: coded-video byte streams to typed records, and header fields as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Record types by id.
TYPES = {1: "sequence_header", 2: "temporal_delimiter", 3: "frame_header", 4: "tile_group", 5: "metadata", 6: "frame", 7: "redundant_frame_header", 8: "tile_list", 15: "padding"}
PAYLOAD_LIMIT = 256 << 20
SCHEMA = "stream_id string, obu_index long, stream_offset long, unit long, type int, temporal_id int, spatial_id int, payload binary, error string"


def leb128(data: bytes, at: int) -> tuple[int, int]:
    """(value, bytes used); raises ValueError past eight bytes, the end, or 32 bits."""
    value = 0
    for i in range(8):
        if at + i >= len(data):
            raise ValueError("a length ends early")
        value |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            if value >> 32:
                raise ValueError("a length is over 32 bits")
            return value, i + 1
    raise ValueError("a length has over eight bytes")


def _record(data: bytes, at: int, end: int, sized: int | None) -> tuple[int, int, int, int, bytes]:
    """(next, type, temporal, spatial, payload) of the record at ``at``; ``sized``: its length if it stands outside."""
    first = data[at]
    if first & 0x80:
        raise ValueError("the forbidden bit is set")
    kind, extended, has_size, head = first >> 3 & 15, bool(first & 4), bool(first & 2), 1
    temporal = spatial = 0
    if extended:
        if at + 1 >= end:
            raise ValueError("a header ends early")
        temporal, spatial, head = data[at + 1] >> 5, data[at + 1] >> 3 & 3, 2
    stop = end if sized is None else at + sized
    if has_size:
        n, used = leb128(data, at + head)
        head += used
        stop = at + head + n
    if stop > end or stop - at - head > PAYLOAD_LIMIT:
        raise ValueError("a payload leaves the stream")
    if kind not in TYPES:
        raise ValueError(f"unknown record type {kind}")
    return stop, kind, temporal, spatial, data[at + head : stop]


def split(data: bytes, framing: str = "lowoverhead") -> Iterator[tuple]:
    """(index, offset, unit, type, temporal, spatial, payload, error); an error row ends the stream."""
    index, unit, at = 0, -1, 0
    try:
        if framing == "lowoverhead":
            while at < len(data):
                stop, kind, t, s, payload = _record(data, at, len(data), None)
                unit += kind == 2 or unit < 0
                yield index, at, unit, kind, t, s, payload, None
                index, at = index + 1, stop
            return
        while at < len(data):
            size, used = leb128(data, at)
            at, unit = at + used, unit + 1
            unit_end = at + size
            if unit_end > len(data):
                raise ValueError("a unit leaves the stream")
            while at < unit_end:
                size, used = leb128(data, at)
                at += used
                frame_end = at + size
                if frame_end > unit_end:
                    raise ValueError("a frame leaves its unit")
                while at < frame_end:
                    size, used = leb128(data, at)
                    at += used
                    if not size or at + size > frame_end:
                        raise ValueError("a record leaves its frame")
                    _, kind, t, s, payload = _record(data, at, at + size, size)
                    yield index, at, unit, kind, t, s, payload, None
                    index, at = index + 1, at + size
    except ValueError as e:
        yield index, at, max(unit, 0), None, None, None, None, str(e)


def records(streams: DataFrame, framing: str = "lowoverhead", types: tuple[int, ...] | None = None) -> DataFrame:
    """SCHEMA rows of streams (stream_id, content); ``types`` keeps only some, before they leave the reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for stream, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(stream, *r) for r in split(content or b"", framing) if types is None or r[3] is None or r[3] in types]
                cols = list(zip(*rows, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return streams.select("stream_id", "content").mapInArrow(run, SCHEMA)


def type_name(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, n in TYPES.items():
        out = F.when(kind == i, F.lit(n)).otherwise(out)
    return out


def bits(payload: Column) -> Column:
    """A payload's bits as a string of 0 and 1, most significant first."""
    return F.array_join(F.transform(F.split(F.hex(payload), "(?<=\\G..)"), lambda h: F.when(h != "", F.lpad(F.conv(h, 16, 2), 8, "0"))), "")


def field(bit_string: Column, first: int, n: int) -> Column:
    """``n`` bits as an unsigned integer."""
    return F.conv(F.substring(bit_string, first + 1, n), 2, 10).cast("bigint")


def still_sequence_header(payload: Column) -> Column:
    """Fields of a reduced still-picture sequence header: profile, level, size; null of other headers."""
    b = bits(F.substring(payload, 1, 16))
    reduced = field(b, 4, 1) == 1
    wb, hb = field(b, 10, 4) + 1, field(b, 14, 4) + 1
    part = lambda at, n: F.conv(F.substring(b, (at + 1).cast("int"), n.cast("int")), 2, 10).cast("bigint") + 1
    return F.when(reduced, F.struct(field(b, 0, 3).alias("profile"), field(b, 5, 5).alias("level"), part(F.lit(18), wb).alias("width"), part(F.lit(18) + wb, hb).alias("height")))


def trailing_bits_ok(payload: Column) -> Column:
    """Whether the payload ends with a one bit and zeros: some bit is set."""
    return F.hex(payload).rlike("[1-9A-F]")
