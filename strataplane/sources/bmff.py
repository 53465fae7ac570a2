"""Container source: binary files to typed tables, with Column parsing of properties.

``scan`` walks the box tree of each file in a small generator (one box header at
a time, no payload copies) and gives one row a box; everything after that is
column arithmetic on slices of ``content`` and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataplane.functions.integers import let, unsigned

# Boxes that hold boxes, with the bytes before their children.
PARENTS = {"meta": 4, "iprp": 0, "ipco": 0, "moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "edts": 0, "dinf": 0, "iref": 4, "tref": 0, "grpl": 0}
INPUT_LIMIT = 256 << 20
#: Entries of a sample table, at most.
SAMPLE_LIMIT = 1_000_000
#: Payloads up to this size come with the box; larger ones, and media data, are read where they are needed.
SMALL, MEDIA = 1 << 16, {"mdat", "idat"}
SCHEMA = "path string, box_id int, parent int, depth int, type string, offset long, payload_offset long, payload_size long, size_zero boolean, error string, data binary"


def read_files(spark: SparkSession, path: str, limit: int = INPUT_LIMIT, pattern: str = "*") -> DataFrame:
    """(path, length, content) of files; content is null for those of over ``limit`` bytes, which ``scan`` reports.

    Two scans, so that the filter on length keeps large files from being read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    read = files.where(F.col("length") <= limit).select("path", "length", "content")
    return read.unionByName(files.where(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content")))


def boxes(content: bytes) -> Iterator[tuple]:
    """(box_id, parent, depth, type, offset, payload_offset, payload_size, size_zero, error) in file order."""
    todo, n = [(0, len(content), None, 0)], 0
    while todo:
        at, end, parent, depth = todo.pop()
        if at >= end:
            continue
        if end - at < 8:
            yield n, parent, depth, None, at, at, end - at, False, "truncated header"
            n += 1
            continue
        size, kind, head = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1 and end - at >= 16:
            size, head = int.from_bytes(content[at + 8 : at + 16], "big"), 16
        zero = size == 0
        if zero:
            size = end - at
        why = None if head <= size <= end - at else "size out of range"
        stop = at + size if why is None else end
        yield n, parent, depth, kind, at, at + head, stop - at - head, zero, why
        todo.append((stop, end, parent, depth))
        if why is None and kind in PARENTS:
            todo.append((at + head + PARENTS[kind], stop, n, depth + 1))
        n += 1


def scan(files: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """SCHEMA rows, one a box; a truncated or oversized box is a row with ``error`` and ends its level, as is a file over the input limit.

    With ``types``, only boxes of these types and rows with an error leave the reader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None:
                    rows.append((path, 0, None, 0, None, 0, 0, None, False, "input over the limit", None))
                    continue
                for b in boxes(content):
                    kind, first, size = b[3], b[5], b[6]
                    if types is not None and kind not in types and b[8] is None:
                        continue
                    small = b[8] is None and kind not in PARENTS and kind not in MEDIA and size <= SMALL
                    rows.append((path, *b, content[first : first + size] if small else None))
            columns = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def payload(content: Column, box: str = "") -> Column:
    """The payload bytes of a box row next to its file's content."""
    return F.substring(content, (F.col(box + "payload_offset") + 1).cast("int"), F.col(box + "payload_size").cast("int"))


def with_payload(files: DataFrame, scanned: DataFrame, *types: str) -> DataFrame:
    """Boxes of the given types with their payload ``data``."""
    rows = scanned.where(F.col("type").isin(*types) & F.col("error").isNull())
    if not set(types) & (MEDIA | set(PARENTS)):
        held = rows.where("data is not null")
        rest = rows.where("data is null")
    else:
        held, rest = rows.where("false"), rows
    # only boxes whose payload did not come with the scan meet their file's content again
    return held.unionByName(rest.drop("data").join(files.select("path", "content"), "path").withColumn("data", payload(F.col("content"))).drop("content"))


def fourcc(data: Column, at: int | Column) -> Column:
    return F.decode(F.substring(data, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(4)), "ISO-8859-1")


def brands(data: Column) -> Column:
    """Major and compatible brands of a file-type box."""
    n = F.floor((F.octet_length(data) - 8) / 4).cast("int")
    rest = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: fourcc(data, i * 4 + 8))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(fourcc(data, 0)), rest)


def is_brand(data: Column, *names: str) -> Column:
    return F.arrays_overlap(brands(data), F.array(*[F.lit(n) for n in names]))


# ---- properties: structs from payload slices


def ispe(data: Column) -> Column:
    return F.struct(unsigned(data, 4, 4).alias("width"), unsigned(data, 8, 4).alias("height"))


def av1c(data: Column) -> Column:
    """Decoder configuration: marker and version, profile, level, depth, subsampling."""
    b0, b1, b2 = (unsigned(data, i, 1) for i in range(3))
    high, twelve = b2.bitwiseAND(64) != 0, b2.bitwiseAND(32) != 0
    return F.struct(
        (b0 == 0x81).alias("valid"),
        F.shiftright(b1, 5).alias("profile"),
        b1.bitwiseAND(31).alias("level"),
        F.when(high & twelve, 12).when(high, 10).otherwise(8).alias("depth"),
        (b2.bitwiseAND(16) != 0).alias("monochrome"),
        F.when(b2.bitwiseAND(16) != 0, "400").when(b2.bitwiseAND(12) == 12, "420").when(b2.bitwiseAND(12) == 8, "422").otherwise("444").alias("chroma"),
    )


def colr(data: Column) -> Column:
    kind = fourcc(data, 0)
    nclx = kind == "nclx"
    return F.struct(
        kind.alias("kind"),
        F.when(nclx, unsigned(data, 4, 2)).alias("primaries"),
        F.when(nclx, unsigned(data, 6, 2)).alias("transfer"),
        F.when(nclx, unsigned(data, 8, 2)).alias("matrix"),
        F.when(nclx, unsigned(data, 10, 1) >= 128).alias("full_range"),
        F.when(kind.isin("prof", "rICC"), F.substring(data, 5, 1 << 30)).alias("icc"),
    )


def pixi(data: Column) -> Column:
    n = unsigned(data, 4, 1).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: unsigned(data, i + 5, 1)))


def pasp(data: Column) -> Column:
    return F.struct(unsigned(data, 0, 4).alias("h"), unsigned(data, 4, 4).alias("v"))


def _signed32(v: Column) -> Column:
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def clap(data: Column) -> Column:
    names = ("width", "height", "x", "y")
    part = lambda k: _signed32(unsigned(data, 4 * k, 4))
    return F.struct(*[F.struct((unsigned(data, 8 * i, 4) if i < 2 else part(2 * i)).alias("n"), unsigned(data, 8 * i + 4, 4).alias("d")).alias(n) for i, n in enumerate(names)])


def irot(data: Column) -> Column:
    return unsigned(data, 0, 1).bitwiseAND(3)


def imir(data: Column) -> Column:
    return unsigned(data, 0, 1).bitwiseAND(1)


def layer_selector(data: Column) -> Column:
    """Spatial layer, null for the highest."""
    return F.nullif(unsigned(data, 0, 2), F.lit(0xFFFF))


def auxc(data: Column) -> Column:
    """The auxiliary type, a string that ends at a byte 0."""
    return F.split_part(F.decode(F.substring(data, 5, 1 << 30), "ISO-8859-1"), F.lit("\x00"), F.lit(1))


def primary_item(data: Column) -> Column:
    return F.when(unsigned(data, 0, 1) == 0, unsigned(data, 4, 2)).otherwise(unsigned(data, 4, 4))


def handler(data: Column) -> Column:
    return fourcc(data, 8)


def _indefinite(v: Column, n: int) -> Column:
    return F.nullif(v, F.lit((1 << 8 * n) - 1).cast("bigint")) if n == 4 else v


def track_header(data: Column) -> Column:
    """Track id, duration (null: without end) and size in whole samples, by version."""
    long = unsigned(data, 0, 1) == 1
    size = lambda at: F.shiftright(F.when(long, unsigned(data, at + 12, 4)).otherwise(unsigned(data, at, 4)), 16)
    endless = F.substring(data, 29, 8) == F.lit(b"\xff" * 8)
    duration = F.when(long, F.when(~endless, unsigned(data, 28, 8))).otherwise(_indefinite(unsigned(data, 20, 4), 4))
    return F.struct(F.when(long, unsigned(data, 20, 4)).otherwise(unsigned(data, 12, 4)).alias("track_id"), duration.alias("duration"), size(76).alias("width"), size(80).alias("height"))


def media_header(data: Column) -> Column:
    long = unsigned(data, 0, 1) == 1
    return F.struct(F.when(long, unsigned(data, 20, 4)).otherwise(unsigned(data, 12, 4)).alias("timescale"), F.when(long, unsigned(data, 24, 8)).otherwise(unsigned(data, 16, 4)).alias("duration"))


def edit_list(data: Column) -> Column:
    """Whether the list repeats, its entries and the first one's duration; ``valid`` if a repeating list has one entry of some duration."""
    long, repeats, n = unsigned(data, 0, 1) == 1, unsigned(data, 3, 1).bitwiseAND(1) == 1, unsigned(data, 4, 4)
    segment = F.when(long, unsigned(data, 8, 8)).otherwise(unsigned(data, 8, 4))
    return F.struct(repeats.alias("repeats"), n.alias("entries"), segment.alias("segment"), (~repeats | ((n == 1) & (segment > 0))).alias("valid"))


def sample_entry(data: Column) -> Column:
    """Number of sample descriptions and the first one's format."""
    return F.struct(unsigned(data, 4, 4).alias("entries"), fourcc(data, 12).alias("format"))


def last_sync(data: Column) -> Column:
    """The largest sample number of stss."""
    return F.array_max(_many(data, 8, unsigned(data, 4, 4), 4, lambda at: unsigned(data, at, 4)))


def grid(payload: Column) -> Column:
    """Rows, columns and output size of a grid item's payload; valid for version 0 without bytes behind."""
    wide = unsigned(payload, 1, 1).bitwiseAND(1) == 1
    size = lambda k: F.when(wide, unsigned(payload, 4 + 4 * k, 4)).otherwise(unsigned(payload, 4 + 2 * k, 2))
    length = F.when(wide, 12).otherwise(8)
    return F.struct(((unsigned(payload, 0, 1) == 0) & (F.octet_length(payload) == length)).alias("valid"), (unsigned(payload, 2, 1) + 1).alias("rows"), (unsigned(payload, 3, 1) + 1).alias("columns"), size(0).alias("width"), size(1).alias("height"))


#: Fractions of a tone map's channel, in order, and whether each has a sign.
MAP_FRACTIONS = (("low", True), ("high", True), ("gamma", False), ("base_offset", True), ("alternate_offset", True))


def tone_map(payload: Column) -> Column:
    """A tone map item's payload: versions, headrooms and three channels, each fraction as numerator and denominator.

    One stored channel stands for all three.  ``error`` is set where a
    file is unreadable (too short for its versions); ``valid`` is false for
    those, for other versions and least versions than 0, for a denominator or
    gamma of 0, a high below its low, and for bytes behind that version 0 doesn't know.
    """
    return let(payload, _tone_map)


def _tone_map(payload: Column) -> Column:
    size = F.octet_length(payload)
    least, writer, flags = unsigned(payload, 1, 2), unsigned(payload, 3, 2), unsigned(payload, 5, 1)
    each = flags.bitwiseAND(128) != 0

    def fraction(at, signed: bool) -> Column:
        n = unsigned(payload, at, 4)
        n = F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n) if signed else n
        return F.struct(n.alias("n"), unsigned(payload, at + 4, 4).alias("d"))

    def channel(c: int) -> Column:
        at = F.when(each, 22 + 40 * c).otherwise(22)
        return F.struct(*[fraction(at + 8 * i, signed).alias(name) for i, (name, signed) in enumerate(MAP_FRACTIONS)])

    needed = F.when(each, 142).otherwise(62)
    error = F.when((size < 1) | ((unsigned(payload, 0, 1) == 0) & (size < 5)), F.lit("too short"))
    known = (size >= 6) & (unsigned(payload, 0, 1) == 0) & (least == 0) & F.when(writer == 0, size == needed).otherwise(size >= needed)
    base, alternate = fraction(6, False), fraction(14, False)

    def sound(c: Column) -> Column:
        whole = c["gamma"]["n"] != 0
        for name, _ in MAP_FRACTIONS:
            whole &= c[name]["d"] != 0
        return whole & (c["high"]["n"] * c["low"]["d"] >= c["low"]["n"] * c["high"]["d"])

    channels = F.array(*[channel(c) for c in range(3)])
    valid = known & (base["d"] != 0) & (alternate["d"] != 0) & F.forall(channels, sound)
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), error.alias("error"), least.alias("least_version"), writer.alias("writer_version"), each.alias("multichannel"), (flags.bitwiseAND(64) != 0).alias("base_colours"), base.alias("base_headroom"), alternate.alias("alternate_headroom"), channels.alias("channels"))


# ---- tables of items, extents, links and runs


def held(data: Column, start: int, count: Column, step: int) -> Column:
    """Whether ``count`` records of ``step`` bytes from ``start`` are there and no more than SAMPLE_LIMIT; null counts are not."""
    return F.coalesce((count <= SAMPLE_LIMIT) & (count * step <= F.octet_length(data) - start), F.lit(False))


def _many(data: Column, start: int, count: Column, step: int, f) -> Column:
    """f(offset) for ``count`` records of ``step`` bytes from ``start``; null where there are none or the box does not hold them."""
    n = F.when(held(data, start, count, step) & (count > 0), count)
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: f(i * step + start))


def items(boxed: DataFrame) -> DataFrame:
    """(path, item_id, type, name) from infe boxes of version 2 or 3 (path, data)."""
    d = F.col("data")
    v3 = unsigned(d, 0, 1) == 3
    at = F.when(v3, 8).otherwise(6)
    return boxed.where("data is not null").select("path", F.when(v3, unsigned(d, 4, 4)).otherwise(unsigned(d, 4, 2)).alias("item_id"), fourcc(d, at + 2).alias("type"), F.split_part(F.decode(F.substring(d, at + 7, F.octet_length(d)), "UTF-8"), F.lit("\x00"), F.lit(1)).alias("name"))


class _Cursor:
    """A position in a box's bytes; ValueError past their end."""

    def __init__(self, data: bytes | None, at: int = 0):
        self.data, self.at = data or b"", at

    def take(self, n: int) -> int:
        return int.from_bytes(self.bytes(n), "big")

    def bytes(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("a box ends early")
        return self.data[self.at - n : self.at]


def _walked(boxed: DataFrame, columns: str, walk) -> DataFrame:
    """(path, columns.., error): rows of ``walk(cursor)`` for each box (path, data); what follows a problem is one row with its text and no values."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [pa.string(), *[kinds[c.split()[1]] for c in columns.split(", ")], pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for row in walk(_Cursor(data)):
                        out.append((path, *row, None))
                except ValueError as e:
                    out.append((path, *[None] * len(names), str(e)))
            cols = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, fields, strict=True)], names=["path", *names, "error"])

    return boxed.select("path", "data").mapInArrow(run, f"path string, {columns}, error string")


def _entries(c: _Cursor) -> Iterator[tuple]:
    version = c.take(1)
    c.take(3)
    for _ in range(c.take(4 if version else 2)):
        size = c.take(4)
        if size < 8:
            raise ValueError("an entry is shorter than its header")
        c.take(4)
        yield (c.bytes(size - 8),)


def infe_boxes(iinf: DataFrame) -> DataFrame:
    """(path, data, error) of the entries in iinf boxes (path, data)."""
    return _walked(iinf, "data binary", _entries)


def _associations(c: _Cursor) -> Iterator[tuple]:
    version, flags = c.take(1), c.take(3)
    step = 2 if flags & 1 else 1
    top = 1 << 8 * step - 1
    for _ in range(c.take(4)):
        item = c.take(4 if version else 2)
        for pos in range(c.take(1)):
            v = c.take(step)
            yield item, pos, v & top - 1, bool(v & top)


def associations(boxed: DataFrame) -> DataFrame:
    """(path, item, pos, prop_index, essential, error) from ipma boxes (path, data)."""
    return _walked(boxed, "item long, pos int, prop_index long, essential boolean", _associations)


def _locations(c: _Cursor) -> Iterator[tuple]:
    version = c.take(1)
    c.take(3)
    if version > 2:
        raise ValueError("another version")
    (offset_size, length_size), (base_size, index_size) = divmod(c.take(1), 16), divmod(c.take(1), 16)
    wide = 4 if version == 2 else 2
    for _ in range(c.take(wide)):
        item = c.take(wide)
        method = c.take(2) & 15 if version else 0
        c.take(2)
        base = c.take(base_size)
        for pos in range(c.take(2)):
            if version:
                c.take(index_size)
            offset = base + c.take(offset_size)
            length = c.take(length_size)
            if max(offset, length) >= 1 << 63:
                raise ValueError("an extent leaves the file")
            yield item, method, pos, offset, length


def extents(boxed: DataFrame) -> DataFrame:
    """(path, item, method, pos, offset, length, error) from iloc boxes (path, data), offsets with their base."""
    return _walked(boxed, "item long, method int, pos int, offset long, length long", _locations)


def references(boxed: DataFrame) -> DataFrame:
    """(path, ref_type, from_id, pos, to_id) from the boxes in iref (path, type, data).

    The box's length tells the width of ids: 4 + 2 n bytes with 16, 6 + 4 n with 32 bits.
    """
    d = F.col("data")
    narrow = F.octet_length(d) == 4 + 2 * unsigned(d, 2, 2)
    ids = F.when(narrow, _many(d, 4, unsigned(d, 2, 2), 2, lambda at: unsigned(d, at, 2))).otherwise(_many(d, 6, unsigned(d, 4, 2), 4, lambda at: unsigned(d, at, 4)))
    return boxed.select("path", F.col("type").alias("ref_type"), F.when(narrow, unsigned(d, 0, 2)).otherwise(unsigned(d, 0, 4)).alias("from_id"), F.posexplode(ids).alias("pos", "to_id"))


def track_references(scanned: DataFrame, boxed: DataFrame) -> DataFrame:
    """(path, track_box, ref_type, pos, track, error) from the boxes in tref, which hold 32-bit track numbers.

    ``scanned``: the file's boxes, tref among them; ``boxed``: (path, parent, type, data) of the reference boxes.  track_box is the box_id of the
    trak.  A box without numbers, with a part of one, or with the number 0 gives a row with an error.
    """
    owners = scanned.where("type = 'tref'").select("path", F.col("box_id").alias("parent"), F.col("parent").alias("track_box"))
    d = F.col("data")
    n = F.call_function("div", F.octet_length(d).cast("long"), F.lit(4).cast("long"))
    ids = _many(d, 0, n, 4, lambda at: unsigned(d, at, 4))
    whole = (F.octet_length(d) % 4 == 0) & (n > 0)
    each = F.when(whole, ids).otherwise(F.array(F.lit(None).cast("long")))
    out = boxed.join(owners, ["path", "parent"]).select("path", "track_box", F.col("type").alias("ref_type"), whole.alias("whole"), F.posexplode(each).alias("pos", "track"))
    return out.select("path", "track_box", "ref_type", F.when(F.col("whole"), F.col("pos")).alias("pos"), "track", F.when(~F.col("whole"), "not a list of track numbers").when(F.col("track") == 0, "a track number is 0").alias("error"))


def track_links(scanned: DataFrame, boxed: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, from_track, ref_type, pos, to_track): ``track_references`` without errors, with the number of the track that holds them.

    ``headers``: (path, parent, track_id) of the tkhd boxes.
    """
    own = headers.select("path", F.col("parent").alias("track_box"), F.col("track_id").alias("from_track"))
    return track_references(scanned, boxed).where("error is null").join(own, ["path", "track_box"]).select("path", "from_track", "ref_type", "pos", F.col("track").alias("to_track"))


def _descriptions(c: _Cursor) -> Iterator[tuple]:
    c.take(4)
    for i in range(c.take(4)):
        size, kind = c.take(4), c.bytes(4).decode("latin-1")
        entry = _Cursor(c.bytes(size - 8) if size >= 8 else b"")
        if kind != "av01":
            yield i, kind, None, None, None, None, None
            continue
        entry.bytes(24)
        width, height = entry.take(2), entry.take(2)
        entry.bytes(50)
        found: dict[str, bytes] = {}
        while entry.at < len(entry.data):
            size, name = entry.take(4), entry.bytes(4).decode("latin-1")
            if size < 8:
                raise ValueError("a box is shorter than its header")
            payload = entry.bytes(size - 8)
            if name in ("av1C", "auxi") and name in found:
                raise ValueError(f"more than one {name}")
            found[name] = payload
        kind_of = found.get("auxi")
        if kind_of is not None and (kind_of[:4] != bytes(4) or b"\0" not in kind_of[4:]):
            raise ValueError("an auxiliary type of another version")
        yield i, kind, width, height, found.get("av1C"), found.get("colr"), kind_of[4:].split(b"\0")[0].decode("utf-8", "replace") if kind_of else None


def sample_entries(boxed: DataFrame) -> DataFrame:
    """(path, entry, format, width, height, config, colour, auxiliary_type, error) of the sample descriptions in stsd boxes (path, data).

    config and colour are the payloads of av1C and colr, for ``av1c`` and ``colr``.
    """
    return _walked(boxed, "entry int, format string, width int, height int, config binary, colour binary, auxiliary_type string", _descriptions)


def payloads(files: DataFrame, parts: DataFrame, idat: DataFrame | None = None) -> DataFrame:
    """(path, item, payload, error): extents (path, item, method, pos, offset, length) read and joined in order.

    Extents of method 0 (or without a method) count from the file's start,
    those of method 1 from the payload of the file's idat box, given by
    ``idat`` (path, payload_offset).  A length of 0 reaches to the end.  Each file's content is read once for all its items; an item with an
    extent that leaves the file, or of another method, has an error and no payload.
    """
    if "method" not in parts.columns:
        parts = parts.withColumn("method", F.lit(0))
    lists = parts.where("item is not null").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("item", "pos", "method", "offset", "length"))).alias("parts"))
    if idat is None:
        lists = lists.withColumn("idat_at", F.lit(None).cast("long"))
    else:
        lists = lists.join(idat.groupBy("path").agg(F.min("payload_offset").cast("long").alias("idat_at")), "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, numbers, found, errors = [], [], [], []
            for i, (path, own, idat_at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                content = memoryview(batch.column(3)[i].as_buffer() or b"")
                pieces: dict[int, list] = {}
                for part in own:
                    base = {0: 0, 1: idat_at}.get(part["method"])
                    at = None if base is None else base + part["offset"]
                    end = None if at is None else at + part["length"] if part["length"] else len(content)
                    inside = at is not None and at <= end <= len(content)
                    pieces.setdefault(part["item"], []).append(content[at:end] if inside else None)
                for item, got in pieces.items():
                    whole = all(p is not None for p in got)
                    paths.append(path)
                    numbers.append(item)
                    found.append(b"".join(got) if whole else None)
                    errors.append(None if whole else "an extent leaves the file")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), pa.array(found, pa.binary()), pa.array(errors, pa.string())], names=["path", "item", "payload", "error"])

    return lists.join(files.select("path", "content"), "path").select("path", "parts", "idat_at", "content").mapInArrow(run, "path string, item long, payload binary, error string")


def runs(data: Column, names: tuple[str, ...]) -> Column:
    """Array of structs of 32-bit fields from a counted table box (stts, stsc)."""
    step = 4 * len(names)
    return _many(data, 8, unsigned(data, 4, 4), step, lambda at: F.struct(*[unsigned(data, at + 4 * i, 4).alias(n) for i, n in enumerate(names)]))


def chunk_offsets(data: Column, kind: Column) -> Column:
    """Offsets of stco or co64."""
    return F.when(kind == "co64", _many(data, 8, unsigned(data, 4, 4), 8, lambda at: unsigned(data, at, 8))).otherwise(_many(data, 8, unsigned(data, 4, 4), 4, lambda at: unsigned(data, at, 4)))


def sample_sizes(data: Column) -> Column:
    """Sizes of stsz: uniform, or one a sample; null beyond SAMPLE_LIMIT or where the box does not hold them."""
    uniform, n = unsigned(data, 4, 4), unsigned(data, 8, 4)
    return F.when(uniform > 0, F.array_repeat(uniform, F.when(n <= SAMPLE_LIMIT, n).cast("int"))).otherwise(_many(data, 12, n, 4, lambda at: unsigned(data, at, 4)))


def table_error(data: Column, kind: Column) -> Column:
    """What is wrong with the count of a sample table (stsz, stts, stsc, stss, stco, co64); null if nothing."""
    n = F.when(kind == "stsz", unsigned(data, 8, 4)).otherwise(unsigned(data, 4, 4))
    step = F.when(kind == "stsc", 12).when(kind.isin("stts", "co64"), 8).otherwise(4)
    bare = (kind == "stsz") & (unsigned(data, 4, 4) > 0)  # one size for all samples
    start = F.when(kind == "stsz", 12).otherwise(8)
    return F.when(n.isNull(), "a table ends early").when(n > SAMPLE_LIMIT, "over the limit of samples").when(~bare & (n * step > F.octet_length(data) - start), "a table ends early")
