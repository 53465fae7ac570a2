"""Image properties of whole files, one file a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataplane.plans.base import query, table
from strataplane.plans.containers import box, full, raw, u
from strataplane.sources import image


def image_file():
    """An image with a grid or coded primary item, and for some alpha, depth, EXIF and XMP items, turns and an ICC profile."""
    infe = lambda i, kind, more=b"": full("infe", 2, 0, u(i, 2), u(0, 2), kind, raw(b"\0" + more))
    kind = F.when(F.expr("k % 6 = 5"), raw(b"grid")).otherwise(raw(b"av01"))
    props = box(
        "ipco",
        full("ispe", 0, 0, u("s * 16", 4), u("s * 9", 4)), box("av1C", raw(b"\x81"), u("k % 32", 1), u("case k % 4 when 0 then 12 when 1 then 72 when 2 then 0 else 28 end", 1), raw(b"\0")),
        F.when(F.expr("k % 3 = 0"), box("colr", raw(b"prof"), F.encode(F.repeat(F.lit("i"), F.col("s").cast("int")), "UTF-8"))).otherwise(box("colr", raw(b"nclx"), u("k % 13", 2), u(13, 2), u("k % 10", 2), u("k % 2 * 128", 1))),
        full("pixi", 0, 0, u(3, 1), u(8, 1), u(10, 1), u("8 + k % 3", 1)), box("irot", u("k % 4", 1)), box("imir", u("k % 2", 1)), full("auxC", 0, 0, raw(b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0")), full("auxC", 0, 0, raw(b"urn:mpeg:hevc:2015:auxid:2\0")),
        box("zzzz", raw(b"opaque")),
    )
    turned = F.when(F.expr("k % 5 = 0"), raw(b"\x00\x01\x07\x81\x82\x83\x84\x85\x86\x09")).otherwise(raw(b"\x00\x01\x05\x81\x82\x83\x84\x09"))
    ipma = full("ipma", 0, 0, u(3, 4), turned, raw(b"\x00\x02\x02\x01\x87"), raw(b"\x00\x03\x01\x88"))
    iinf = full("iinf", 0, 0, u(5, 2), infe(1, kind), infe(2, raw(b"av01")), infe(3, raw(b"av01")), infe(4, raw(b"Exif")), infe(5, raw(b"mime"), b"application/rdf+xml\0"))
    edge = lambda when, name, *ids: F.when(F.expr(when), box(name, u(ids[0], 2), u(len(ids) - 1, 2), *[u(i, 2) for i in ids[1:]])).otherwise(raw(b""))
    iref = full("iref", 0, 0, edge("k % 2 = 0", "auxl", 2, 1), edge("k % 7 = 0", "auxl", 3, 1), edge("k % 4 = 0", "prem", 1, 2), edge("k % 5 = 1", "cdsc", 4, 1), edge("k % 5 < 2", "cdsc", 5, 1), edge("k % 6 = 5", "dimg", 1, 2, 3))
    iloc = full("iloc", 0, 0, raw(b"\x44\0"), u(1, 2), u(1, 2), u(0, 2), u(1, 2), u("k", 4), u("s", 4))
    pitm = F.when(F.expr("k % 13 = 2"), raw(b"")).otherwise(full("pitm", 0, 0, u("if(k % 17 = 1, 9, 1)", 2)))
    whole = F.concat(box("ftyp", raw(b"avif"), u(0, 4), F.when(F.expr("k % 8 = 0"), raw(b"avis")).otherwise(raw(b"mif1"))), full("meta", 0, 0, pitm, iinf, iloc, iref, box("iprp", props, ipma)))
    return F.when(F.expr("k % 11 = 3"), F.expr("substring(whole, 1, octet_length(whole) - 3)")).when(F.expr("k % 19 = 4"), raw(b"")).otherwise(F.col("whole")), whole


@query(
    "image_properties",
    "WITH f AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s FROM part), e AS (SELECT *, k % 11 = 3 AS cut, k % 19 = 4 AND k % 11 <> 3 AS none, CASE WHEN k % 13 = 2 THEN NULL WHEN k % 17 = 1 THEN 9 ELSE 1 END AS item FROM f)"
    " SELECT k, CASE WHEN NOT none THEN 'avif' END AS brand, CASE WHEN NOT none THEN k % 8 = 0 END AS animated, CASE WHEN item = 1 THEN CASE WHEN k % 6 = 5 THEN 'grid' ELSE 'av01' END END AS type, CASE WHEN item = 1 THEN s * 16 END AS width, CASE WHEN item = 1 THEN s * 9 END AS height,"
    " CAST(CASE WHEN item = 1 THEN CASE k % 4 WHEN 1 THEN 10 ELSE 8 END END AS INTEGER) AS depth, CASE WHEN item = 1 THEN CASE k % 4 WHEN 0 THEN '420' WHEN 1 THEN '422' WHEN 2 THEN '444' ELSE '400' END END AS chroma, CASE WHEN item = 1 AND k % 3 <> 0 THEN k % 13 END AS primaries,"
    " CAST(CASE WHEN item = 1 AND k % 3 = 0 THEN s END AS INTEGER) AS icc_bytes, CASE WHEN item = 1 THEN 8 + k % 3 END AS third_channel, CASE WHEN item = 1 AND k % 5 = 0 THEN k % 4 END AS rotation, CASE WHEN item = 1 AND k % 5 = 0 THEN k % 2 END AS mirror,"
    " CASE WHEN item = 1 AND k % 2 = 0 THEN CAST(2 AS BIGINT) END AS alpha, CASE WHEN item = 1 AND k % 7 = 0 THEN CAST(3 AS BIGINT) END AS depth_map, item = 1 AND k % 4 = 0 AND item IS NOT NULL AS premultiplied, item = 1 AND k % 5 = 1 AND item IS NOT NULL AS exif, item = 1 AND k % 5 < 2 AND item IS NOT NULL AS xmp,"
    " CAST(CASE WHEN item = 1 AND k % 6 = 5 THEN 2 END AS INTEGER) AS tiles, CASE WHEN item = 1 THEN k END AS \"offset\", CASE WHEN item IS NULL THEN 'no primary item' WHEN item = 9 THEN 'the primary item is not there' END AS error FROM e WHERE NOT cut AND NOT none"
    " UNION ALL SELECT k, 'avif', k % 8 = 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, false, false, NULL, NULL, 'size out of range' FROM e WHERE cut",
)
def image_properties(spark, d):
    """Properties of the primary image of each file; some files are cut, empty or lack a primary item.

    An empty file has no box and thus no row.
    """
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"))
    content, whole = image_file()
    files = parts.withColumn("whole", whole).select(F.col("k").cast("string").alias("path"), content.alias("content"))
    got = image.images(files)
    return got.select(
        F.col("path").cast("bigint").alias("k"), "brand", "animated", "type", "width", "height", "depth", "chroma", "primaries", "icc_bytes", F.get("channels", F.lit(2)).alias("third_channel"), "rotation", "mirror",
        "alpha", "depth_map", "premultiplied", "exif", "xmp", "tiles", F.get("parts", F.lit(0))["offset"].alias("offset"), "error",
    )
