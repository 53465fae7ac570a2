"""Files built box by box and record by record."""

import struct

from pyspark.sql import functions as F

from strataplane.operators import container
from strataplane.sources import bmff, obu
from strataplane.streaming import slots


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


def full(kind, version, flags, *parts):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def still():
    infe = lambda i, t: full("infe", 2, 0, struct.pack(">HH4s", i, 0, t), b"name%d\0" % i)
    ipco = box("ipco", full("ispe", 0, 0, struct.pack(">II", 640, 480)), box("av1C", bytes([0x81, 0x24, 0x0C, 0])), box("colr", b"nclx", struct.pack(">HHHB", 9, 16, 9, 0x80)), full("pixi", 0, 0, bytes([3, 8, 8, 8])), box("irot", b"\x01"), full("auxC", 0, 0, b"urn:alpha\0x"), box("clap", struct.pack(">IIIIiIiI", 600, 1, 400, 1, -3, 2, 5, 1)))
    ipma = full("ipma", 0, 0, struct.pack(">I", 2), struct.pack(">HB", 1, 3), bytes([0x81, 0x82, 0x05]), struct.pack(">HB", 2, 1), bytes([0x86]))
    iloc = full("iloc", 1, 0, bytes([0x44, 0x40]), struct.pack(">H", 2), struct.pack(">HHHIH", 1, 0, 0, 0, 2), struct.pack(">IIII", 4, 2, 0, 3), struct.pack(">HHHIH", 2, 0, 0, 8, 1), struct.pack(">II", 1, 2))
    iinf = full("iinf", 0, 0, struct.pack(">H", 2), infe(1, b"av01"), infe(2, b"av01"))
    iref = full("iref", 0, 0, box("auxl", struct.pack(">HHH", 2, 1, 1)))
    meta = full("meta", 0, 0, full("hdlr", 0, 0, struct.pack(">I4s", 0, b"pict")), full("pitm", 0, 0, struct.pack(">H", 1)), iloc, iinf, iref, box("iprp", ipco, ipma))
    return box("ftyp", b"avif", bytes(4), b"mif1", b"avis") + meta + box("mdat", bytes(range(10)))


def tables(spark, tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    read = bmff.read_files(spark, str(tmp_path), pattern="*.bin")
    return read, bmff.scan(read)


def test_still_image(spark, tmp_path):
    files, scanned = tables(spark, tmp_path, still=still())
    assert [r.type for r in scanned.where("depth = 0").orderBy("offset").collect()] == ["ftyp", "meta", "mdat"]
    get = lambda t: bmff.with_payload(files, scanned, t)
    assert get("ftyp").select(bmff.brands(F.col("data")).alias("b")).first().b == ["avif", "mif1", "avis"]
    assert get("ispe").select(bmff.ispe(F.col("data")).alias("v")).first().v.asDict() == {"width": 640, "height": 480}
    config = get("av1C").select(bmff.av1c(F.col("data")).alias("v")).first().v
    assert (config.valid, config.profile, config.level, config.depth, config.chroma) == (True, 1, 4, 8, "420")
    assert get("colr").select(bmff.colr(F.col("data")).alias("v")).first().v[1:5] == (9, 16, 9, True)
    assert get("pixi").select(bmff.pixi(F.col("data")).alias("v")).first().v == [8, 8, 8]
    assert get("irot").select(bmff.irot(F.col("data")).alias("v")).first().v == 1
    assert get("auxC").select(bmff.auxc(F.col("data")).alias("v")).first().v == "urn:alpha"
    aperture = get("clap").select(bmff.clap(F.col("data")).alias("v")).first().v
    assert (tuple(aperture.width), tuple(aperture.x), tuple(aperture.y)) == ((600, 1), (-3, 2), (5, 1))
    named = bmff.items(bmff.infe_boxes(get("iinf").select("path", "data"))).orderBy("item_id").collect()
    assert [(r.item_id, r.type, r.name) for r in named] == [(1, "av01", "name1"), (2, "av01", "name2")]
    edges = bmff.references(get("auxl").select("path", "type", "data")).collect()
    assert [(e.ref_type, e.from_id, e.pos, e.to_id) for e in edges] == [("auxl", 2, 0, 1)]
    links = bmff.associations(get("ipma").select("path", "data"))
    assert sorted((r.item, r.pos, r.prop_index, r.essential) for r in links.collect()) == [(1, 0, 1, True), (1, 1, 2, True), (1, 2, 5, False), (2, 0, 6, True)]
    props = spark.createDataFrame([(1, "ispe"), (2, "av1C"), (5, "irot"), (6, "auxC")], "prop_index long, type string")
    kept = container.item_properties(links.select("item", "pos", "prop_index", "essential"), props)
    assert sorted((r.item, r.type) for r in kept.collect()) == [(1, "av1C"), (1, "ispe"), (2, "auxC")]
    parts = bmff.extents(get("iloc").select("path", "data"))
    got = {r.item: bytes(r.payload) for r in bmff.payloads(files, parts).collect()}
    data = still()
    assert got == {1: data[4:6] + data[0:3], 2: data[9:11]}


def test_broken_boxes(spark, tmp_path):
    _, scanned = tables(spark, tmp_path, short=still()[:60], tiny=b"abc", empty=b"", zero=struct.pack(">I4s", 0, b"mdat") + b"xyz")
    rows = {(r.path.rsplit("/", 1)[1], r.type): r for r in scanned.collect()}
    assert rows["short.bin", "meta"].error == "size out of range"
    assert rows["tiny.bin", None].error == "truncated header"
    assert rows["zero.bin", "mdat"].size_zero and rows["zero.bin", "mdat"].payload_size == 3


def test_sample_tables(spark):
    rows = spark.createDataFrame([(full("stts", 0, 0, struct.pack(">I", 2), struct.pack(">IIII", 3, 10, 1, 20))[8:], full("co64", 0, 0, struct.pack(">I", 2), struct.pack(">QQ", 5, 1 << 33))[8:], full("stsz", 0, 0, struct.pack(">III", 0, 2, 7), struct.pack(">I", 9))[8:])], "a binary, b binary, c binary")
    r = rows.select(bmff.runs(F.col("a"), ("count", "delta")).alias("a"), bmff.chunk_offsets(F.col("b"), F.lit("co64")).alias("b"), bmff.sample_sizes(F.col("c")).alias("c")).first()
    assert [tuple(x) for x in r.a] == [(3, 10), (1, 20)] and r.b == [5, 1 << 33] and r.c == [7, 9]


def record(kind, payload, layer=None, sized=True):
    head = bytes([kind << 3 | (4 if layer else 0) | (2 if sized else 0)]) + (bytes([layer[0] << 5 | layer[1] << 3]) if layer else b"")
    return head + (bytes([len(payload)]) if sized else b"") + payload


def test_records(spark):
    low = record(2, b"") + record(1, b"\x18\x00") + record(6, b"abc", (1, 2)) + record(2, b"") + record(6, b"d")
    inner = [record(2, b"", sized=False), record(6, b"abc", (1, 2), sized=False)]
    frame = b"".join(bytes([len(r)]) + r for r in inner)
    unit = bytes([len(frame)]) + frame
    annex = bytes([len(unit)]) + unit
    streams = spark.createDataFrame([("low", low), ("bad", low[:-1]), ("none", None)], "stream_id string, content binary")
    rows = obu.records(streams).orderBy("stream_id", "obu_index").collect()
    assert [(r.type, r.unit, r.temporal_id, r.spatial_id, bytes(r.payload)) for r in rows if r.stream_id == "low"] == [(2, 0, 0, 0, b""), (1, 0, 0, 0, b"\x18\x00"), (6, 0, 1, 2, b"abc"), (2, 1, 0, 0, b""), (6, 1, 0, 0, b"d")]
    assert [r.error for r in rows if r.stream_id == "bad"][-1] == "a payload leaves the stream"
    got = obu.records(spark.createDataFrame([("a", annex)], "stream_id string, content binary"), "annexb", types=(6,)).collect()
    assert [(r.type, r.temporal_id, bytes(r.payload)) for r in got] == [(6, 1, b"abc")]


def test_still_sequence_header(spark):
    text = "000" + "1" + "1" + "00100" + f"{9:04b}" + f"{8:04b}" + f"{639:010b}" + f"{479:09b}"
    data = int(text.ljust(64, "0"), 2).to_bytes(8, "big")
    v = spark.createDataFrame([(data,)], "p binary").select(obu.still_sequence_header(F.col("p")).alias("v")).first().v
    assert (v.profile, v.level, v.width, v.height) == (0, 4, 640, 480)


def test_slots_stream_equals_batch(spark, tmp_path):
    schema = "stream_id string, frame long, mask long, show long"
    rows = [(f"s{i % 3}", i, (i * 37) % 256, (i % 8) if i % 5 == 4 else -1) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = slots.decode_order(spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("slot_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.stream_id, r.frame, r.shown, tuple(r.slots))
    want = slots.decode_batch(spark.createDataFrame(rows, schema))
    assert sorted(map(key, spark.table("slot_rows").collect())) == sorted(map(key, want.collect()))


def test_cut_and_forged_boxes(spark):
    """Counts and lengths that a box does not hold: rows with an error, nothing that grows with a stated number."""
    big = (1 << 31) - 1
    size = lambda d: spark.createDataFrame([(d,)], "data binary").select(bmff.sample_sizes(F.col("data")).alias("n"), bmff.table_error(F.col("data"), F.lit("stsz")).alias("e")).first()
    assert size(bytes(4) + (7).to_bytes(4, "big") + big.to_bytes(4, "big")).e == "over the limit of samples" and size(bytes(8) + big.to_bytes(4, "big")).n is None
    assert size(bytes(4) + (7).to_bytes(4, "big") + (3).to_bytes(4, "big")).n == [7, 7, 7] and size(b"\0").e == "a table ends early"
    rows = [("a", bytes(4) + (0xFFFFFFFF).to_bytes(4, "big") + b"\0\1\1\x81"), ("b", None), ("c", b"\0\0\0\0\0\0\0\0")]
    got = bmff.associations(spark.createDataFrame(rows, "path string, data binary")).orderBy("path", "error").collect()
    assert [(r.path, r.item, r.error) for r in got] == [("a", 1, None), ("a", None, "a box ends early"), ("b", None, "a box ends early")]
    extents = bmff.extents(spark.createDataFrame([("a", b"\1\0\0\0\x44\x40\0\1"), ("b", b"\3\0\0\0\x44\x40\0\1")], "path string, data binary")).orderBy("path").collect()
    assert [r.error for r in extents] == ["a box ends early", "another version"]
    parts = spark.createDataFrame([("a", 1, 0, 0, 2, 3), ("a", 1, 0, 1, 0, 1), ("a", 2, 0, 0, 5, 9), ("a", 3, 1, 0, 0, 1), ("a", 4, 0, 0, 6, 0), ("b", 1, 0, 0, 0, 1)], "path string, item long, method int, pos int, offset long, length long")
    files = spark.createDataFrame([("a", b"01234567"), ("b", None)], "path string, content binary")
    got = {(r.path, r.item): (None if r.payload is None else bytes(r.payload), r.error) for r in bmff.payloads(files, parts).collect()}
    assert got == {("a", 1): (b"2340", None), ("a", 2): (None, "an extent leaves the file"), ("a", 3): (None, "an extent leaves the file"), ("a", 4): (b"67", None), ("b", 1): (None, "an extent leaves the file")}


def test_many_entries_are_linear(spark):
    """20,000 entries and as many extents of one file."""
    entry = (21).to_bytes(4, "big") + b"infe" + b"\2\0\0\0\0\1\0\0av01\0"
    n = 20_000
    iinf = spark.createDataFrame([("a", bytes(4) + n.to_bytes(2, "big") + entry * n)], "path string, data binary")
    assert bmff.items(bmff.infe_boxes(iinf)).where("type = 'av01'").count() == n
    parts = spark.range(n).selectExpr("'a' AS path", "1L AS item", "0 AS method", "int(id) AS pos", "id AS offset", "1L AS length")
    files = spark.createDataFrame([("a", bytes(i % 251 for i in range(n)))], "path string, content binary")
    assert bytes(bmff.payloads(files, parts).first().payload) == bytes(i % 251 for i in range(n))
