"""Files to image properties in one call: one scan of the boxes, one row a file.

The boxes of a file (small payloads only) meet in one group, the counted tables among them are walked once, and the rest is array expressions: the
primary item, its properties by number, what refers to it, and its extents.  Coded samples are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplane.functions.integers import let
from strataplane.sources import bmff

#: Names of alpha and depth images.
ALPHA = ("urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", "urn:mpeg:hevc:2015:auxid:1")
DEPTH = ("urn:mpeg:mpegB:cicp:systems:auxiliary:depth", "urn:mpeg:hevc:2015:auxid:2")
_LINK = pa.struct([("item", pa.int64()), ("prop", pa.int64()), ("essential", pa.bool_())])
_ITEM = pa.struct([("item", pa.int64()), ("type", pa.string())])
_EXTENT = pa.struct([("item", pa.int64()), ("method", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_EDGE = pa.struct([("type", pa.string()), ("from", pa.int64()), ("to", pa.int64())])
_TABLES = "links array<struct<item:long,prop:long,essential:boolean>>, items array<struct<item:long,type:string>>, extents array<struct<item:long,method:int,offset:long,length:long>>, edges array<struct<type:string,`from`:long,to:long>>, wrong string"


def _item(data: bytes) -> dict:
    c = bmff._Cursor(data)
    version = c.take(1)
    c.take(3)
    if version not in (2, 3):
        raise ValueError("an item of another version")
    number = c.take(4 if version == 3 else 2)
    c.take(2)
    return {"item": number, "type": c.bytes(4).decode("latin-1")}


def _edges(version: int, kind: str, data: bytes) -> Iterator[dict]:
    c = bmff._Cursor(data)
    width = 4 if version else 2
    source = c.take(width)
    for _ in range(c.take(2)):
        yield {"type": kind, "from": source, "to": c.take(width)}


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, ipma, iinf, iloc, iref boxes) to (path, _TABLES); the first problem is told, and what stood before it is kept."""
    kinds = [pa.string(), *[pa.list_(k) for k in (_LINK, _ITEM, _EXTENT, _EDGE)], pa.string()]
    for batch in batches:
        out = []
        for path, ipma, iinf, iloc, version, refs in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            links, found, extents, edges, wrong = [], [], [], [], None
            try:
                for data in ipma:
                    links += [{"item": i, "prop": p, "essential": e} for i, _, p, e in bmff._associations(bmff._Cursor(data))]
                for data in iinf:
                    found += [_item(entry) for (entry,) in bmff._entries(bmff._Cursor(data))]
                for data in iloc:
                    extents += [{"item": i, "method": m, "offset": o, "length": n} for i, m, _, o, n in bmff._locations(bmff._Cursor(data))]
                for r in refs:
                    edges += _edges(version or 0, r["type"], r["data"] or b"")
            except ValueError as e:
                wrong = str(e)
            out.append((path, links, found, extents, edges, wrong))
        cols = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["path", "links", "items", "extents", "edges", "wrong"])


def _first(boxes: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(boxes, lambda b: b["type"] == kind), F.lit(1))


def images(files: DataFrame) -> DataFrame:
    """One row for each of ``files`` (path, content).

    path, brand, animated, primary, type, width, height, depth, chroma, monochrome, primaries, transfer, matrix, full_range, icc_bytes, channels (bits each),
    rotation (quarter turns), mirror (axis), cropped, alpha and depth_map (items), premultiplied, gain_map, exif and xmp (whether items describe the primary one), tiles (cells of a grid), parts (its extents), tracks, items (their number), error.

    error is null for a file with a primary item and readable tables; else it tells the first problem, and fields that depend on what is missing are null.  A null or
    empty content is no image.
    """
    scanned = bmff.scan(files)
    one = F.struct("box_id", "parent", "depth", "type", "data")
    whole = scanned.groupBy("path").agg(F.sort_array(F.collect_list(F.when(F.col("error").isNull(), one))).alias("boxes"), F.min(F.when(F.col("error").isNotNull(), F.struct("offset", "error")))["error"].alias("broken"))
    below = lambda kind: F.filter("boxes", lambda b: b["parent"] == _first(F.col("boxes"), kind)["box_id"])
    data = lambda kind: F.filter(F.transform(F.filter("boxes", lambda b: b["type"] == kind), lambda b: b["data"]), lambda d: d.isNotNull())
    held = whole.select(
        "path", "broken", below("ipco").alias("props"), below("iref").alias("refs"), data("ipma").alias("ipma"), data("iinf").alias("iinf"), data("iloc").alias("iloc"),
        _first(F.col("boxes"), "pitm")["data"].alias("pitm"), _first(F.col("boxes"), "ftyp")["data"].alias("ftyp"), F.size(F.filter("boxes", lambda b: b["type"] == "trak")).alias("tracks"),
    )
    # ids in reference boxes are as wide as their total length says: all boxes of an iref are of one version
    narrow = F.forall("refs", lambda r: F.octet_length(r["data"]) == 4 + 2 * bmff.unsigned(r["data"], 2, 2))
    held = held.withColumn("version", F.when(F.coalesce(narrow, F.lit(True)), 0).otherwise(1))
    tables = held.select("path", "ipma", "iinf", "iloc", "version", F.transform("refs", lambda r: F.struct(r["type"].alias("type"), r["data"].alias("data"))).alias("refs"), F.struct("broken", "props", "pitm", "ftyp", "tracks").alias("kept"))
    # the struct is carried along, so nothing is joined back
    walked = _carried(tables)
    primary = bmff.primary_item(F.col("kept.pitm"))
    made = walked.withColumn("primary", F.when(F.col("kept.pitm").isNotNull(), primary))
    own = lambda item: F.transform(F.filter("links", lambda x: x["item"] == item), lambda x: F.try_element_at(F.col("kept.props"), x["prop"].cast("int")))
    made = made.withColumn("own", own(F.col("primary")))
    prop = lambda kind: _first(F.col("own"), kind)["data"]
    named = lambda urns: F.array_min(F.transform(F.filter("edges", lambda e: (e["type"] == "auxl") & (e["to"] == F.col("primary")) & F.exists(own(e["from"]), lambda p: (p["type"] == "auxC") & bmff.auxc(p["data"]).isin(*urns))), lambda e: e["from"]))
    described = lambda kind: F.coalesce(F.exists("edges", lambda e: (e["type"] == "cdsc") & (e["to"] == F.col("primary")) & F.exists("items", lambda i: (i["item"] == e["from"]) & (i["type"] == kind))), F.lit(False))
    made = made.withColumns({"ispe": let_or_null(prop("ispe"), bmff.ispe), "av1c": let_or_null(prop("av1C"), bmff.av1c), "colr": let_or_null(prop("colr"), bmff.colr), "alpha": named(ALPHA), "depth_map": named(DEPTH)})
    made = made.withColumn("found", F.try_element_at(F.filter("items", lambda i: i["item"] == F.col("primary")), F.lit(1)))
    problem = F.when(F.col("kept.ftyp").isNull(), "no file type").when(F.col("kept.broken").isNotNull(), F.col("kept.broken")).when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("primary").isNull(), "no primary item").when(F.col("found").isNull(), "the primary item is not there")
    cells = F.size(F.filter("edges", lambda e: (e["type"] == "dimg") & (e["from"] == F.col("primary"))))
    return made.select(
        "path", bmff.fourcc(F.col("kept.ftyp"), 0).alias("brand"), bmff.is_brand(F.col("kept.ftyp"), "avis").alias("animated"), "primary", F.col("found.type").alias("type"), "ispe.width", "ispe.height", "av1c.depth", "av1c.chroma", "av1c.monochrome",
        "colr.primaries", "colr.transfer", "colr.matrix", "colr.full_range", F.octet_length("colr.icc").alias("icc_bytes"), let_or_null(prop("pixi"), bmff.pixi).alias("channels"), let_or_null(prop("irot"), bmff.irot).alias("rotation"), let_or_null(prop("imir"), bmff.imir).alias("mirror"),
        prop("clap").isNotNull().alias("cropped"), "alpha", "depth_map", F.coalesce(F.exists("edges", lambda e: (e["type"] == "prem") & (e["from"] == F.col("primary")) & (e["to"] == F.col("alpha"))), F.lit(False)).alias("premultiplied"),
        F.exists("items", lambda i: i["type"] == "tmap").alias("gain_map"), described("Exif").alias("exif"), described("mime").alias("xmp"), F.when(F.col("found.type") == "grid", cells).alias("tiles"),
        F.transform(F.filter("extents", lambda x: x["item"] == F.col("primary")), lambda x: F.struct(x["method"].alias("method"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("parts"), F.col("kept.tracks").alias("tracks"), F.size("items").alias("items"), problem.alias("error"),
    )


def let_or_null(value: Column, body) -> Column:
    return let(value, lambda v: F.when(v.isNotNull(), body(v)))


def _carried(tables: DataFrame) -> DataFrame:
    """``tables`` with their boxes walked; the struct ``kept`` goes along."""
    kept = tables.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in _tables(iter([batch])):
                yield pa.RecordBatch.from_arrays([*got.columns, batch.column(6)], names=[*got.schema.names, "kept"])

    return tables.mapInArrow(run, f"path string, {_TABLES}, kept {kept}")
