"""Queries of derived syntax values, and of pixel words of both widths."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataplane.functions import syntax
from strataplane.functions.integers import div, lit64, round_shift
from strataplane.plans.base import BLOCKS, PX, blocks, query, table

INT = "bigint"

_WIDE = [f"s[4 * p + {k + 1}]" for k in range(4)]
_SIGNED = "CASE WHEN {0} >= 32768 THEN {0} - 65536 ELSE {0} END"


@query(
    "pixel_int_to_long",
    f"WITH {BLOCKS} SELECT vec_id, p, CAST((" + _SIGNED.format(f"({_WIDE[0]} * 257)") + f") * 281474976710656 + {_WIDE[1]} * 257 * 4294967296 + {_WIDE[2]} * 257 * 65536 + {_WIDE[3]} * 257 AS BIGINT) AS argb FROM (SELECT vec_id, s, unnest(range(0, 16)) AS p FROM blk)",
)
def pixel_int_to_long(spark, d):
    """Pixels of four 8-bit channels as four 16-bit channels in a signed long: each times 257."""
    each = blocks(spark, d).select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.struct(p.alias("p"), F.slice("s", p * 4 + 1, 4).alias("c")))).alias("r"))
    out = lit64(0)
    for k in range(4):
        out = out.bitwiseOR(F.shiftleft(F.element_at("r.c", k + 1) * 257, 16 * (3 - k)))
    return each.select("vec_id", F.col("r.p").cast(INT).alias("p"), out.alias("argb"))


_WORDS = ("(l_orderkey * 31 % 65536)", "(l_partkey * 97 % 65536)", "(l_suppkey * 661 % 65536)", "(CAST(l_quantity AS BIGINT) * 1311 % 65536)")
_BYTES = [f"(({w} * 255 + 32767) // 65535)" for w in _WORDS]


@query(
    "pixel_long_to_int",
    f"SELECT l_orderkey, l_linenumber, CAST((CASE WHEN {_BYTES[0]} >= 128 THEN {_BYTES[0]} - 256 ELSE {_BYTES[0]} END) * 16777216 + {_BYTES[1]} * 65536 + {_BYTES[2]} * 256 + {_BYTES[3]} AS INTEGER) AS argb FROM lineitem",
)
def pixel_long_to_int(spark, d):
    """Pixels of four 16-bit channels as four 8-bit channels in a signed int, rounded."""
    words = [F.col("l_orderkey") * 31, F.col("l_partkey") * 97, F.col("l_suppkey") * 661, F.col("l_quantity").cast(INT) * 1311]
    out = lit64(0)
    for w in words:
        out = F.shiftleft(out, 8) + div((w.cast(INT) % 65536) * 255 + 32767, lit64(65535))
    signed = F.when(out >= 1 << 31, out - (1 << 32)).otherwise(out)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", signed.cast("int").alias("argb"))


@query("has_aux_type", "SELECT l_orderkey, bool_or(l_shipmode = 'AIR') AS has_air, bool_or(l_shipmode = 'none') AS has_none FROM (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'AIR' ELSE l_returnflag END AS l_shipmode FROM lineitem) GROUP BY l_orderkey")
def has_aux_type(spark, d):
    """Whether an image carries an auxiliary image of a type."""
    kinds = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, F.lit("AIR")).otherwise(F.col("l_returnflag")).alias("kind"))
    return kinds.groupBy("l_orderkey").agg(F.bool_or(F.col("kind") == "AIR").alias("has_air"), F.bool_or(F.col("kind") == "none").alias("has_none"))


@query(
    "uvlc_decode",
    "WITH w AS (SELECT l_orderkey, l_linenumber, (l_partkey * 1000003 + l_suppkey * 8191 + l_orderkey) % 2147483647 * 2147483647 >> CAST(l_orderkey % 40 AS INTEGER) AS w FROM lineitem), n AS (SELECT *, 2 * length(bin(w)) - 63 AS past FROM w) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN w > 0 AND past >= 0 THEN (w >> CAST(past AS INTEGER)) - 1 END AS BIGINT) AS v FROM n",
)
def uvlc_decode(spark, d):
    """Variable-length unsigned codes at the head of 62-bit words; null where a code runs past its word."""
    head = (F.col("l_partkey").cast(INT) * 1000003 + F.col("l_suppkey") * 8191 + F.col("l_orderkey")) % 2147483647 * 2147483647
    word = F.call_function("shiftright", head, (F.col("l_orderkey") % 40).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", syntax.uvlc(word, 62).alias("v"))


@query(
    "superres_frame_size",
    "SELECT l_orderkey, l_linenumber, CAST(fw AS BIGINT) AS width, CAST(2 * ((fw + 7) // 8) AS BIGINT) AS units FROM (SELECT l_orderkey, l_linenumber, ((l_partkey % 8192 + 1) * 8 + (9 + l_suppkey % 8) // 2) // (9 + l_suppkey % 8) AS fw FROM lineitem)",
)
def superres_frame_size(spark, d):
    """Coded width and its 4 x 4 units of upscaled frames."""
    width = syntax.superres_width((F.col("l_partkey") % 8192 + 1).cast(INT), (F.col("l_suppkey") % 8 + 9).cast(INT))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", width.alias("width"), syntax.units4(width).alias("units"))


@query(
    "tile_columns",
    "WITH b AS (SELECT l_orderkey, l_linenumber, (2 * ((l_partkey * 37 % 16384 + 1 + 7) // 8) + 15) // 16 AS sb, l_suppkey % 3 AS finer FROM lineitem), k AS (SELECT *, CASE WHEN sb <= 64 THEN 0 WHEN sb <= 128 THEN 1 WHEN sb <= 256 THEN 2 ELSE 3 END AS least, CAST(ceil(log2(least(sb, 64))) AS BIGINT) AS most FROM b), t AS (SELECT *, least(greatest(most, least), least + finer) AS k FROM k), u AS (SELECT *, (sb + CAST(power(2, k) AS BIGINT) - 1) // CAST(power(2, k) AS BIGINT) AS tw FROM t), s AS (SELECT l_orderkey, l_linenumber, sb, tw, unnest(range(0, sb, tw)) AS start FROM u) SELECT l_orderkey, l_linenumber, CAST(start // tw AS BIGINT) AS tile, CAST(start AS BIGINT) AS start, CAST(least(tw, sb - start) AS BIGINT) AS width FROM s",
)
def tile_columns(spark, d):
    """Uniform tile columns of frames: place, start and width in superblocks."""
    side = (F.col("l_partkey") * 37 % 16384 + 1).cast(INT)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.shiftright(syntax.units4(side) + 15, 4).alias("sb"), syntax.tile_starts(side, F.col("l_suppkey") % 3).alias("starts"))
    each = rows.select("l_orderkey", "l_linenumber", "sb", "starts", F.posexplode("starts").alias("tile", "start"))
    end = F.when(F.col("tile") + 1 < F.size("starts"), F.get("starts", F.col("tile") + 1)).otherwise(F.col("sb"))
    return each.select("l_orderkey", "l_linenumber", F.col("tile").cast(INT).alias("tile"), "start", (end - F.col("start")).alias("width"))


@query("segment_quantiser", "SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(255, l_partkey % 256 + l_suppkey * 7 % 511 - 255)) AS BIGINT) AS qindex FROM lineitem")
def segment_quantiser(spark, d):
    q = syntax.segment_quantiser((F.col("l_partkey") % 256).cast(INT), (F.col("l_suppkey") * 7 % 511 - 255).cast(INT))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.cast(INT).alias("qindex"))


@query(
    "intra_copy_check",
    "WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 7 % 256 AS BIGINT) AS y4, CAST(l_suppkey * 13 % 256 AS BIGINT) AS x4, CAST(4 << CAST(l_linenumber % 4 AS INTEGER) AS BIGINT) AS w, CAST(4 << CAST(l_orderkey % 4 AS INTEGER) AS BIGINT) AS h, -(l_partkey * 131 % 4096) * CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 2 END AS r, (l_suppkey * 977 + l_orderkey * 8) % 8192 - 4096 AS c, l_orderkey % 2 = 0 AS chroma FROM lineitem), a AS (SELECT *, r - r % 4 AS row, c - c % 4 AS col FROM m), e AS (SELECT *, y4 * 32 + row AS up, x4 * 32 + col AS lf, (y4 * 4 + h) * 8 + row AS dn, (x4 * 4 + w) * 8 + col AS rt FROM a), f AS (SELECT *, y4 // 16 AS hr, x4 // 16 AS hc, ((dn // 8) - 1) // 64 AS sr, ((rt // 8) - 1) // 64 AS sc FROM e) SELECT l_orderkey, l_linenumber, row % 8 = 0 AND col % 8 = 0 AND up >= 0 AND lf >= 0 AND dn <= 8192 AND rt <= 8192 AND NOT (chroma AND ((w < 8 AND lf < 32) OR (h < 8 AND up < 32))) AND sr * 16 + sc < hr * 16 + hc - 4 AND sr <= hr AND sc < hc - 4 + 5 * (hr - sr) AS allowed FROM f",
)
def intra_copy_check(spark, d):
    """Whether blocks of a 1024 x 1024 tile may copy from their own frame."""
    power = lambda c: F.call_function("shiftleft", lit64(4), (c % 4).cast("int"))
    c = {
        "y4": (F.col("l_partkey") * 7 % 256).cast(INT),
        "x4": (F.col("l_suppkey") * 13 % 256).cast(INT),
        "w": power(F.col("l_linenumber")),
        "h": power(F.col("l_orderkey")),
        "r": -(F.col("l_partkey") * 131 % 4096).cast(INT) * F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(2),
        "c": ((F.col("l_suppkey") * 977 + F.col("l_orderkey") * 8) % 8192 - 4096).cast(INT),
        "chroma": F.col("l_orderkey") % 2 == 0,
    }
    each = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in c.items()])
    moved = each.withColumns({"row": F.col("r") - F.col("r") % 4, "col": F.col("c") - F.col("c") % 4})
    ok = syntax.copy_allowed(*[F.col(k) for k in ("row", "col", "y4", "x4", "h", "w")], (0, 0, 256, 256), False, F.col("chroma"))
    return moved.select("l_orderkey", "l_linenumber", ok.alias("allowed"))


#: Weights of a block's own prediction by distance from the edge, for an overlap of four rows.
OVERLAP_4 = (39, 50, 59, 64)


@query("obmc_blend", f"WITH {PX} SELECT a.vec_id, a.y * 8 + a.x AS i, CAST(CASE WHEN a.y < 4 THEN ([39, 50, 59, 64][a.y + 1] * a.v + (64 - [39, 50, 59, 64][a.y + 1]) * b.v + 32) >> 6 ELSE a.v END AS BIGINT) AS v FROM px a JOIN px b ON b.vec_id = a.vec_id AND b.y = 7 - a.y AND b.x = a.x")
def obmc_blend(spark, d):
    """The upper half of a block blended with the prediction by the block above, by the mask of four rows."""
    each = blocks(spark, d).select("vec_id", "s", F.posexplode("s").alias("i", "v"))
    y, x = F.floor(F.col("i") / 8).cast("int"), (F.col("i") % 8).cast("int")
    m, other = F.get(F.array(*[lit64(w) for w in OVERLAP_4]), y), F.element_at("s", (F.lit(7) - y) * 8 + x + 1)
    blended = round_shift(F.col("v") * m + other * (F.lit(64) - m), 6)
    return each.select("vec_id", F.col("i").cast(INT).alias("i"), F.when(y < 4, blended).otherwise(F.col("v")).cast(INT).alias("v"))
