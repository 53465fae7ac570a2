"""Queries on the container and record sources: files and streams built from rows of part, scanned back.

A part k of size s becomes one small file with every kind of box; the SQL says
from the same row what the scan has to find.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataplane.functions.integers import let
from strataplane.plans.base import query, table
from strataplane.sources import bmff, obu


def u(v: Column | int | str, n: int) -> Column:
    """Big-endian unsigned integer of ``n`` bytes."""
    value = F.lit(v) if isinstance(v, int) else F.expr(v) if isinstance(v, str) else v
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))


def raw(v: bytes) -> Column:
    return F.lit(v)


def box(kind: str, *parts: Column) -> Column:
    return let(F.concat(*parts) if len(parts) > 1 else parts[0], lambda b: F.concat(u(F.octet_length(b) + 8, 4), raw(kind.encode()), b))


def full(kind: str, version: int, flags: int, *parts: Column) -> Column:
    return box(kind, raw(bytes([version, 0, 0, flags])), *parts)


def _negative(e: str) -> str:
    return f"(({e}) + 4294967296) % 4294967296"


def still_file() -> Column:
    """ftyp, mdat, meta and moov of a part (k, s)."""
    infe = lambda i, kind, name: full("infe", 2, 0, u(i, 2), u(0, 2), kind, F.encode(name, "UTF-8"), raw(b"\0"))
    ipco = box(
        "ipco",
        full("ispe", 0, 0, u("s * 8", 4), u("s * 4 + 1", 4)),
        box("av1C", raw(b"\x81"), u("k % 3 * 32 + k % 32", 1), u("k % 128", 1), raw(b"\0")),
        box("colr", raw(b"nclx"), u("k % 13 + 1", 2), u("k % 18", 2), u("k % 10", 2), u("k % 2 * 128", 1)),
        full("pixi", 0, 0, u(3, 1), u("8 + k % 3 * 2", 1), u(8, 1), u(10, 1)),
        box("pasp", u("k", 4), u("s", 4)),
        box("clap", u("k", 4), u(1, 4), u("s", 4), u(2, 4), u(_negative("-(k % 50)"), 4), u(2, 4), u(_negative("s - 25"), 4), u(1, 4)),
        box("irot", u("k % 4", 1)),
        box("imir", u("k % 2", 1)),
        full("auxC", 0, 0, F.encode(F.concat(F.lit("urn:a:"), F.col("s")), "UTF-8"), raw(b"\0tail")),
        box("lsel", u("if(k % 4 = 0, 65535, k % 5)", 2)),
        box("abcd", F.encode(F.concat(F.lit("opaque"), F.col("k")), "UTF-8")),
    )
    ipma = full("ipma", 0, 0, u(2, 4), u(1, 2), raw(b"\x03\x81\x82\x05"), u(2, 2), raw(b"\x01\x86"))
    iloc = full("iloc", 1, 0, raw(b"\x44\x40"), u(2, 2), u(1, 2), u(0, 2), u(0, 2), u(32, 4), u(2, 2), u(3, 4), u(2, 4), u(0, 4), u(3, 4), u(2, 2), u(1, 2), u(0, 2), u(0, 4), u(1, 2), u(1, 4), u(3, 4))
    iinf = full("iinf", 0, 0, u(2, 2), infe(1, raw(b"av01"), F.concat(F.lit("a"), F.col("k"))), infe(2, F.when(F.expr("k % 5 = 0"), raw(b"grid")).otherwise(raw(b"av01")), F.lit("b")))
    iref = full("iref", 0, 0, box("auxl", u(2, 2), u(1, 2), u(1, 2)), box("dimg", u(1, 2), u(2, 2), u(2, 2), u(1, 2)))
    pict = full("hdlr", 0, 0, u(0, 4), F.when(F.expr("k % 7 = 0"), raw(b"vide")).otherwise(raw(b"pict")), raw(bytes(13)))
    idat = box("idat", F.encode(F.concat(F.lit("idat"), F.col("k")), "UTF-8"))
    meta = full("meta", 0, 0, pict, full("pitm", 0, 0, u("k % 2 + 1", 2)), iloc, iinf, iref, idat, box("iprp", ipco, ipma))
    stbl = box(
        "stbl",
        full("stsd", 0, 0, u(1, 4), box("av01", raw(bytes(78)))),
        full("stts", 0, 0, u(2, 4), u("k % 5 + 1", 4), u("s", 4), u(2, 4), u(7, 4)),
        full("stsc", 0, 0, u(2, 4), u(1, 4), u("k % 3 + 1", 4), u(1, 4), u(4, 4), u(2, 4), u(1, 4)),
        full("stsz", 0, 0, u(0, 4), u(3, 4), u("k", 4), u("s", 4), u(9, 4)),
        full("stco", 0, 0, u(2, 4), u("k * 16", 4), u("k * 16 + s", 4)),
        full("stss", 0, 0, u(3, 4), u(1, 4), u("k % 9 + 2", 4), u(2, 4)),
    )
    tkhd = full("tkhd", 0, 3, raw(bytes(8)), u("k", 4), u(0, 4), u("if(k % 4 = 0, 4294967295, s * 10)", 4), raw(bytes(52)), u("s * 65536", 4), u("(s + 1) * 65536", 4))
    elst = box("elst", raw(bytes(3)), u("k % 2", 1), u(1, 4), u("k % 3", 4), u(0, 4), raw(b"\0\1\0\0"))
    mdhd = full("mdhd", 0, 0, raw(bytes(8)), u("s * 100", 4), u("k", 4), u(0, 4))
    moov = box("moov", box("trak", tkhd, box("edts", elst), box("mdia", mdhd, full("hdlr", 0, 0, u(0, 4), raw(b"pict"), raw(bytes(13))), box("minf", stbl))))
    ftyp = box("ftyp", raw(b"avif"), u(0, 4), raw(b"mif1"), F.when(F.expr("k % 3 = 0"), raw(b"avis")).otherwise(raw(b"tmap")))
    return F.concat(ftyp, box("mdat", F.encode(F.concat(F.lit("media"), F.col("k")), "UTF-8")), meta, moov)


def files(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"))
    return parts.select(F.col("k").cast("string").alias("path"), still_file().alias("content")).withColumn("length", F.octet_length("content"))


def _boxes(spark, d, *types):
    """(k, type, data, ...) of boxes of the given types."""
    f = files(spark, d)
    return bmff.with_payload(f, bmff.scan(f, types), *types).withColumn("k", F.col("path").cast("bigint"))


_P = "WITH f AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s FROM part)"
_B = lambda e: f"CAST({e} AS BIGINT)"

#: name: box, columns from the parsed value v, the same in SQL
PARSED = {
    "ispe": ("ispe", bmff.ispe, {"width": ("v.width", _B("s * 8")), "height": ("v.height", _B("s * 4 + 1"))}),
    "av1c": (
        "av1C",
        bmff.av1c,
        {
            "valid": ("v.valid", "true"),
            "profile": ("v.profile", _B("k % 3 + k % 32 // 32")),
            "level": ("v.level", _B("k % 32")),
            "depth": ("v.depth", "CAST(CASE WHEN k % 128 >= 96 THEN 12 WHEN k % 128 >= 64 THEN 10 ELSE 8 END AS INTEGER)"),
            "monochrome": ("v.monochrome", "(k // 16) % 2 = 1"),
            "chroma": ("v.chroma", "CASE WHEN (k // 16) % 2 = 1 THEN '400' WHEN (k // 4) % 4 = 3 THEN '420' WHEN (k // 4) % 4 = 2 THEN '422' ELSE '444' END"),
        },
    ),
    "colr": ("colr", bmff.colr, {"kind": ("v.kind", "'nclx'"), "primaries": ("v.primaries", _B("k % 13 + 1")), "transfer": ("v.transfer", _B("k % 18")), "matrix": ("v.matrix", _B("k % 10")), "full_range": ("v.full_range", "k % 2 = 1")}),
    "pixi": ("pixi", bmff.pixi, {"n": ("size(v)", "CAST(3 AS INTEGER)"), "first": ("v[0]", _B("8 + k % 3 * 2")), "last": ("v[2]", _B("10"))}),
    "pasp": ("pasp", bmff.pasp, {"h": ("v.h", "k"), "v": ("v.v", "s")}),
    "clap": ("clap", bmff.clap, {"wn": ("v.width.n", "k"), "hd": ("v.height.d", _B("2")), "xn": ("v.x.n", _B("-(k % 50)")), "yn": ("v.y.n", _B("s - 25"))}),
    "irot": ("irot", bmff.irot, {"code": ("v", _B("k % 4"))}),
    "imir": ("imir", bmff.imir, {"axis": ("v", _B("k % 2"))}),
    "auxc": ("auxC", bmff.auxc, {"urn": ("v", "'urn:a:' || s")}),
    "layer_selector": ("lsel", bmff.layer_selector, {"layer": ("v", _B("CASE WHEN k % 4 = 0 THEN NULL ELSE k % 5 END"))}),
    "opaque_property": ("abcd", lambda x: F.decode(x, "UTF-8"), {"payload": ("v", "'opaque' || k")}),
    "primary_item": ("pitm", bmff.primary_item, {"item": ("v", _B("k % 2 + 1"))}),
    "track_header": ("tkhd", bmff.track_header, {"track_id": ("v.track_id", "k"), "duration": ("v.duration", _B("CASE WHEN k % 4 = 0 THEN NULL ELSE s * 10 END")), "width": ("v.width", "s"), "height": ("v.height", _B("s + 1"))}),
    "media_header": ("mdhd", bmff.media_header, {"timescale": ("v.timescale", _B("s * 100")), "duration": ("v.duration", "k")}),
    "edit_list": ("elst", bmff.edit_list, {"repeats": ("v.repeats", "k % 2 = 1"), "entries": ("v.entries", _B("1")), "segment": ("v.segment", _B("k % 3")), "valid": ("v.valid", "k % 2 = 0 OR k % 3 > 0")}),
    "sample_entry": ("stsd", bmff.sample_entry, {"entries": ("v.entries", _B("1")), "format": ("v.format", "'av01'")}),
    "sync_table": ("stss", bmff.last_sync, {"last": ("v", _B("k % 9 + 2"))}),
    "chunk_offset_table": ("stco", lambda x: bmff.chunk_offsets(x, F.col("type")), {"n": ("size(v)", "CAST(2 AS INTEGER)"), "first": ("v[0]", _B("k * 16")), "second": ("v[1]", _B("k * 16 + s"))}),
    "sample_size_table": ("stsz", bmff.sample_sizes, {"n": ("size(v)", "CAST(3 AS INTEGER)"), "first": ("v[0]", "k"), "second": ("v[1]", "s")}),
}
for _name, (_type, _parse, _cols) in PARSED.items():
    query(f"bmff_{_name}", f"{_P} SELECT k, {', '.join(f'{sql} AS {c}' for c, (_, sql) in _cols.items())} FROM f")(
        (lambda t, p, cols: lambda spark, d: _boxes(spark, d, t).withColumn("v", p(F.col("data"))).select("k", *[F.expr(e).alias(c) for c, (e, _) in cols.items()]))(_type, _parse, _cols)
    )

_TYPES = {0: "ftyp mdat meta moov", 1: "hdlr pitm iloc iinf iref idat iprp trak", 2: "auxl dimg ipco ipma tkhd edts mdia", 3: "ispe av1C colr pixi pasp clap irot imir auxC lsel abcd elst mdhd hdlr minf", 4: "stbl", 5: "stsd stts stsc stsz stco stss"}


@query("bmff_boxes", f"{_P}, t AS (SELECT * FROM (VALUES {', '.join(f'({depth}, {chr(39)}{n}{chr(39)})' for depth, names in _TYPES.items() for n in names.split())}) t(depth, type)) SELECT k, CAST(depth AS INTEGER) AS depth, type FROM f, t")
def bmff_boxes(spark, d):
    """Every box of every file with its depth."""
    return bmff.scan(files(spark, d)).where("error is null").select(F.col("path").cast("bigint").alias("k"), "depth", "type")


@query("bmff_brands", f"{_P} SELECT k, k % 3 = 0 AS animated, k % 3 <> 0 AS tone_mapped, CAST(3 AS INTEGER) AS n FROM f")
def bmff_brands(spark, d):
    b = _boxes(spark, d, "ftyp")
    return b.select("k", bmff.is_brand(F.col("data"), "avis").alias("animated"), bmff.is_brand(F.col("data"), "tmap").alias("tone_mapped"), F.size(bmff.brands(F.col("data"))).alias("n"))


@query("bmff_handler", f"{_P} SELECT k, k % 7 <> 0 AS ok FROM f")
def bmff_handler(spark, d):
    """Whether the metadata handler, the one at depth 1, is that of pictures."""
    return _boxes(spark, d, "hdlr").where("depth = 1").select("k", (bmff.handler(F.col("data")) == "pict").alias("ok"))


@query("bmff_items", f"{_P} SELECT k, CAST(1 AS BIGINT) AS item_id, 'av01' AS type, 'a' || k AS name FROM f UNION ALL SELECT k, 2, CASE WHEN k % 5 = 0 THEN 'grid' ELSE 'av01' END, 'b' FROM f")
def bmff_items(spark, d):
    found = bmff.items(bmff.infe_boxes(_boxes(spark, d, "iinf").select("path", "data")))
    return found.select(F.col("path").cast("bigint").alias("k"), "item_id", "type", "name")


@query("bmff_associations", f"{_P} SELECT k, CAST(item AS BIGINT) AS item, CAST(pos AS INTEGER) AS pos, CAST(prop AS BIGINT) AS prop_index, essential FROM f, (VALUES (1, 0, 1, true), (1, 1, 2, true), (1, 2, 5, false), (2, 0, 6, true)) t(item, pos, prop, essential)")
def bmff_associations(spark, d):
    found = bmff.associations(_boxes(spark, d, "ipma").select("path", "data"))
    return found.select(F.col("path").cast("bigint").alias("k"), "item", "pos", "prop_index", "essential")


@query("bmff_references", f"{_P} SELECT k, ref_type, CAST(a AS BIGINT) AS from_id, CAST(pos AS INTEGER) AS pos, CAST(b AS BIGINT) AS to_id FROM f, (VALUES ('auxl', 2, 0, 1), ('dimg', 1, 0, 2), ('dimg', 1, 1, 1)) t(ref_type, a, pos, b)")
def bmff_references(spark, d):
    found = bmff.references(_boxes(spark, d, "auxl", "dimg").select("path", "type", "data"))
    return found.select(F.col("path").cast("bigint").alias("k"), "ref_type", "from_id", "pos", "to_id")


@query("bmff_extents", f"{_P} SELECT k, CAST(item AS BIGINT) AS item, CAST(method AS INTEGER) AS method, CAST(pos AS INTEGER) AS pos, CAST(a AS BIGINT) AS \"offset\", CAST(n AS BIGINT) AS length FROM f, (VALUES (1, 0, 0, 35, 2), (1, 0, 1, 32, 3), (2, 1, 0, 1, 3)) t(item, method, pos, a, n)")
def bmff_extents(spark, d):
    found = bmff.extents(_boxes(spark, d, "iloc").select("path", "data"))
    return found.select(F.col("path").cast("bigint").alias("k"), "item", "method", "pos", "offset", "length")


@query("bmff_payloads", f"{_P} SELECT k, CAST(1 AS BIGINT) AS item, substr('media' || k, 4, 2) || substr('media' || k, 1, 3) AS payload FROM f UNION ALL SELECT k, 2, substr('idat' || k, 2, 3) FROM f")
def bmff_payloads(spark, d):
    """Items put together from two extents of the file, and from one of its idat box."""
    f = files(spark, d)
    scanned = bmff.scan(f)
    parts = bmff.extents(bmff.with_payload(f, scanned, "iloc").select("path", "data"))
    found = bmff.payloads(f, parts, scanned.where("type = 'idat' and depth = 1"))
    return found.select(F.col("path").cast("bigint").alias("k"), "item", F.decode("payload", "UTF-8").alias("payload"))


@query("bmff_time_to_sample", f"{_P} SELECT k, CAST(0 AS INTEGER) AS run, CAST(k % 5 + 1 AS BIGINT) AS n, s AS delta FROM f UNION ALL SELECT k, 1, 2, 7 FROM f")
def bmff_time_to_sample(spark, d):
    return _boxes(spark, d, "stts").select("k", F.posexplode(bmff.runs(F.col("data"), ("count", "delta"))).alias("run", "x")).select("k", "run", F.col("x.count").alias("n"), F.col("x.delta").alias("delta"))


@query("bmff_sample_to_chunk", f"{_P} SELECT k, CAST(0 AS INTEGER) AS run, CAST(1 AS BIGINT) AS first_chunk, CAST(k % 3 + 1 AS BIGINT) AS per_chunk FROM f UNION ALL SELECT k, 1, 4, 2 FROM f")
def bmff_sample_to_chunk(spark, d):
    each = _boxes(spark, d, "stsc").select("k", F.posexplode(bmff.runs(F.col("data"), ("first_chunk", "per_chunk", "description"))).alias("run", "x"))
    return each.select("k", "run", "x.first_chunk", "x.per_chunk")


@query("grid_payload", f"{_P} SELECT k, k % 4 <> 3 AS valid, CAST(k % 6 + 1 AS BIGINT) AS rows, CAST(s % 4 + 1 AS BIGINT) AS columns, CAST(s * 64 AS BIGINT) AS width, CAST(s * 32 AS BIGINT) AS height FROM f")
def grid_payload(spark, d):
    """Grid descriptions with 16 and 32 bit sizes; every fourth has a byte too many."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"))
    narrow = F.concat(raw(b"\0\0"), u("k % 6", 1), u("s % 4", 1), u("s * 64", 2), u("s * 32", 2))
    wide = F.concat(raw(b"\0\1"), u("k % 6", 1), u("s % 4", 1), u("s * 64", 4), u("s * 32", 4))
    data = F.concat(F.when(F.expr("k % 2 = 0"), narrow).otherwise(wide), F.when(F.expr("k % 4 = 3"), raw(b"x")).otherwise(raw(b"")))
    return parts.select("k", bmff.grid(data).alias("v")).select("k", "v.*")


@query(
    "tone_map_payload",
    f"{_P}, v AS (SELECT k, s, k % 2 = 0 AS multi, k % 11 <> 3 AND k % 13 <> 5 AND k % 7 <> 2 AND k % 5 <> 1 AND k % 17 <> 4 AND NOT (k % 2 = 0 AND k % 3 = 1 AND s > 20) AS valid FROM f), c AS (SELECT *, unnest([0, 1, 2]) AS c FROM v)"
    " SELECT k, CAST(c AS INTEGER) AS channel, valid, multi, k % 4 >= 2 AS base_colours, CAST(s AS BIGINT) AS base_n, CAST(k % 7 + 3 AS BIGINT) AS alternate_d, CAST(CASE WHEN multi THEN c * (k % 3) - 30 ELSE -30 END AS BIGINT) AS low_n,"
    " CAST(CASE WHEN multi AND c = 1 AND k % 3 = 1 AND s > 20 THEN -s - 100 ELSE s END AS BIGINT) AS high_n, CAST(CASE WHEN k % 5 = 1 THEN 0 ELSE 1 END AS BIGINT) AS gamma_n FROM c WHERE k % 11 <> 3",
)
def tone_map_payload(spark, d):
    """Channels of tone maps of one or three; some have a wrong version, a byte too many or too few, a gamma or denominator of 0 or a high below its low."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"))

    def channel(c: int, multi: bool) -> Column:
        low = u(_negative(f"{c} * (k % 3) - 30" if multi else "-30"), 4)
        high = u(_negative("if(k % 3 = 1 and s > 20, -s - 100, s)" if multi and c == 1 else "s"), 4)
        return F.concat(low, u(2, 4), high, u(2, 4), u("if(k % 5 = 1, 0, 1)", 4), u(1, 4), u(0, 4), u("if(k % 17 = 4, 0, 64)", 4), u(0, 4), u(64, 4))

    head = F.concat(u("if(k % 13 = 5, 1, 0)", 1), u(0, 2), u(0, 2), u("if(k % 2 = 0, 128, 0) + if(k % 4 >= 2, 64, 0)", 1), u("s", 4), u(1, 4), u("k", 4), u("k % 7 + 3", 4))
    body = F.when(F.expr("k % 2 = 0"), F.concat(*[channel(c, True) for c in range(3)])).otherwise(channel(0, False))
    data = F.concat(head, body, F.when(F.expr("k % 7 = 2"), raw(b"x")).otherwise(raw(b"")))
    cut = F.when(F.expr("k % 11 = 3"), raw(b"\0\0\0\0")).otherwise(data)

    def rows(v: Column) -> Column:
        head = [v["valid"].alias("valid"), v["multichannel"].alias("multi"), v["base_colours"].alias("base_colours"), v["base_headroom"]["n"].alias("base_n"), v["alternate_headroom"]["d"].alias("alternate_d")]
        each = lambda c: F.struct(*head, *[c[name]["n"].alias(f"{name}_n") for name in ("low", "high", "gamma")])
        return F.when(v["error"].isNull(), F.transform(v["channels"], each))

    return parts.select("k", F.posexplode(let(bmff.tone_map(cut), rows)).alias("channel", "c")).select("k", "channel", "c.*")


# ---- records: one stream a part, of a delimiter, a frame in a layer and a padding record


def streams(spark, d, framing: str):
    k = F.col("p_partkey")
    text = F.encode(F.concat(F.lit("frame"), k), "UTF-8")
    layers = F.expr("cast(p_partkey % 8 * 32 + p_partkey % 4 * 8 as bigint)")
    size = lambda c: u(F.octet_length(c), 1)
    if framing == "lowoverhead":
        content = F.concat(raw(b"\x12\x00"), raw(b"\x36"), u(layers, 1), size(text), text, raw(b"\x7a\x01\x00"))
    else:
        first, second = raw(b"\x10"), F.concat(raw(b"\x34"), u(layers, 1), text)
        frame = F.concat(size(first), first, size(second), second)
        unit = let(frame, lambda f: F.concat(u(F.octet_length(f), 1), f))
        content = let(unit, lambda x: F.concat(u(F.octet_length(x), 1), x))
    return table(spark, d, "part").select(k.cast("string").alias("stream_id"), content.alias("content"))


for _framing, _more in {"lowoverhead": " UNION ALL SELECT p_partkey, 2, 'padding', 0, 0, NULL FROM part", "annexb": ""}.items():
    query(
        f"obu_records_{_framing}",
        f"SELECT p_partkey AS k, CAST(0 AS BIGINT) AS i, 'temporal_delimiter' AS type, CAST(0 AS INTEGER) AS tid, CAST(0 AS INTEGER) AS sid, NULL AS payload FROM part UNION ALL SELECT p_partkey, 1, 'frame', CAST(p_partkey % 8 AS INTEGER), CAST(p_partkey % 4 AS INTEGER), 'frame' || p_partkey FROM part{_more}",
    )(
        (lambda framing: lambda spark, d: obu.records(streams(spark, d, framing), framing).select(F.col("stream_id").cast("bigint").alias("k"), F.col("obu_index").alias("i"), obu.type_name(F.col("type")).alias("type"), F.col("temporal_id").alias("tid"), F.col("spatial_id").alias("sid"), F.when(F.col("type") == 6, F.decode("payload", "UTF-8")).alias("payload")))(_framing)
    )


@query("still_sequence_header", "SELECT p_partkey AS k, CAST(p_partkey % 3 AS BIGINT) AS profile, CAST(p_partkey % 32 AS BIGINT) AS level, CAST(p_size * 16 AS BIGINT) AS width, CAST(p_size * 9 AS BIGINT) AS height FROM part")
def still_sequence_header(spark, d):
    """Reduced still-picture headers written bit by bit and read back."""
    bits = lambda e, n: F.lpad(F.bin(F.expr(e)), n, "0")
    text = F.rpad(F.concat(bits("p_partkey % 3", 3), F.lit("11"), bits("p_partkey % 32", 5), bits("11", 4), bits("10", 4), bits("p_size * 16 - 1", 12), bits("p_size * 9 - 1", 11)), 48, "0")
    data = F.unhex(F.lpad(F.conv(text, 2, 16), 12, "0"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), obu.still_sequence_header(data).alias("v")).select("k", "v.*")


@query("trailing_bits", "SELECT p_partkey AS k, p_partkey % 2 = 1 OR p_size % 3 > 0 AS ok FROM part")
def trailing_bits(spark, d):
    data = F.concat(u("p_partkey % 2", 1), u("p_size % 3 * 64", 1), raw(b"\0"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), obu.trailing_bits_ok(data).alias("ok"))
