"""Queries on sequence and frame headers: each order is a stream, each of its line items a frame.

The first line is a key frame, the others are inter frames that refer to the frame before (first reference) and to the key frame, and
inherit from them as their columns say.  The headers are written bit by bit; the SQL says from the same columns what has to be
read, with its own rules for what is inherited.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplane.functions.integers import let
from strataplane.operators import conformance
from strataplane.plans import header_writer
from strataplane.plans.base import query, table
from strataplane.sources import headers

#: Fields of a frame by the columns k (order), n (number of the line in its order), q (quantity), p (part) and s (supplier); read by both dialects.
FIELDS = {
    "ov": "p % 2", "mode": "s % 3", "w": "257 + p % 256", "ht": "257 + s % 256", "sr": "q % 2", "den": "q % 8", "same": "CASE WHEN s % 4 = 0 THEN 1 ELSE 0 END",
    "tc": "(q + n) % 2", "tr": "s % 2", "base": "1 + (p * 7 + q) % 255", "yd": "CASE WHEN p % 3 = 0 THEN q % 64 - 32 ELSE 0 END", "ud": "CASE WHEN s % 4 = 0 THEN q % 50 - 25 ELSE 0 END", "qm": "CASE WHEN q % 5 = 0 THEN 1 ELSE 0 END",
    "pr": "CASE WHEN n > 1 AND p % 4 <> 0 THEN 1 ELSE 0 END", "se": "CASE WHEN s % 5 < 3 THEN 1 ELSE 0 END", "um": "CASE WHEN q % 3 = 0 THEN 1 ELSE 0 END", "sd": "CASE WHEN p % 4 <> 0 AND n > 1 AND q % 4 <> 0 THEN 0 ELSE 1 END",
    "l0": "q % 64", "l1": "p % 64", "de": "CASE WHEN s % 3 <> 0 THEN 1 ELSE 0 END", "du": "CASE WHEN s % 3 <> 0 AND p % 3 = 1 THEN 1 ELSE 0 END", "cb": "s % 2",
    "ry": "p % 4", "ru": "q % 4", "ra": "q % 2", "rb": "s % 2", "rc": "p % 2", "tx": "q % 2", "cp": "CASE WHEN n > 1 AND q % 3 <> 0 THEN 1 ELSE 0 END", "hint": "4 * n + CASE WHEN n % 2 = 0 THEN 8 ELSE 0 END",
    "g": "CASE WHEN n > 1 THEN p % 3 ELSE 0 END", "hp": "s % 2", "ga": "CASE WHEN p % 5 <> 0 THEN 1 ELSE 0 END", "gu": "CASE WHEN n > 1 AND q % 2 = 1 THEN 0 ELSE 1 END", "seed": "(p * 31 + s * 7 + q) % 65536",
}
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
_LINES = f"SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS n, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p, l_suppkey AS s FROM lineitem"
SQL = f"WITH f0 AS ({_LINES}), f AS MATERIALIZED (SELECT k, n, q, p, s, {', '.join(f'CAST({v} AS BIGINT) AS {c}' for c, v in FIELDS.items())} FROM f0)"


def bits(*parts: tuple[str, int] | str | Column) -> Column:
    """A string of 0 and 1: (expression, width) pairs, literal strings and columns, one after another."""
    one = lambda x: F.lit(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lpad(F.bin(F.expr(x[0]).cast("bigint")), x[1], "0")
    return F.concat(*map(one, parts))


def where(condition: str, *parts) -> Column:
    return F.when(F.expr(condition), bits(*parts)).otherwise("")


def packed(text: Column) -> Column:
    """Bytes of a string of bits, closed by a one and zeros."""
    byte = lambda t: lambda i: F.lpad(F.hex(F.conv(F.rpad(F.substring(t, i, 8), 8, "0"), 2, 10).cast("bigint")), 2, "0")
    return let(F.concat(text, F.lit("1")), lambda t: F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.length(t), F.lit(8)), byte(t)), "")))


def signed(e: str, n: int) -> tuple[str, int]:
    return f"(({e}) + {1 << n}) % {1 << n}", n


#: 511 x 299, order hints of 8 bits, super-resolution, constrained directional filter, restoration, warped motion and grain; 4:2:0 of 8 bits.
SEQUENCE = "000" + "00" + "0" + "0" + "00000" + "0" * 12 + "00101" + "1011" * 2 + f"{510:012b}{298:012b}" + "0" + "000" + "0010" + "1" + "00" + "00" + "111" + "111" + "0" + "0" + "0" + "0" + "00" + "0" + "1"


def records(spark, d, cut: str = "false") -> DataFrame:
    """Record rows of all streams; where ``cut`` holds, only three bytes of a header are there."""
    lines = F.expr(f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER})").cast("bigint")
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), lines.alias("n"), F.expr("CAST(l_quantity AS BIGINT)").alias("q"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return own.mapInArrow(header_writer.records(FIELDS, SEQUENCE, cut), header_writer.RECORDS)


#: Hashed orders that are counted together.
BUCKETS = 1 << 16


def most_lines(spark, d) -> int:
    """A number of lines that no order exceeds: those of the fullest of BUCKETS buckets of orders."""
    each = table(spark, d, "lineitem").groupBy(F.pmod(F.hash("l_orderkey"), F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def read_headers(spark, d, fields: tuple[str, ...], cut: str = "false", active: bool = False) -> DataFrame:
    # a stream has its lines and a sequence header
    return headers.headers(records(spark, d, cut), fields, active, most_lines(spark, d) + 1).where("type = 3")


def frames(spark, d, *columns: str, cut: str = "false") -> DataFrame:
    named = tuple(dict.fromkeys(f for c in columns for f in re.findall(r"header\.(\w+)", c))) or ("refresh",)
    return read_headers(spark, d, named, cut).select(F.col("stream_id").cast("bigint").alias("k"), F.col("obu_index").alias("n"), *map(F.expr, columns))


_I = lambda e: f"CAST({e} AS INTEGER)"
#: the last value that is not inherited, at or before the row
_LAST = lambda c: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY k ORDER BY n)"


@query(
    "header_size",
    f"{SQL}, own AS (SELECT *, CASE WHEN n = 1 OR ov = 0 OR mode = 0 THEN struct_pack(w := CASE WHEN ov = 1 THEN w ELSE 511 END, h := CASE WHEN ov = 1 THEN ht ELSE 299 END) END AS v FROM f),"
    f" keyed AS (SELECT *, first_value(v) OVER (PARTITION BY k ORDER BY n) AS first FROM own), held AS (SELECT *, CASE WHEN v IS NULL AND mode = 2 AND same = 0 THEN first ELSE v END AS u FROM keyed),"
    f" sized AS (SELECT *, {_LAST('u')} AS z, CASE WHEN sr = 1 THEN 9 + den ELSE 8 END AS d FROM held)"
    f" SELECT k, n, {_I('(z.w * 8 + d // 2) // d')} AS width, {_I('z.w')} AS upscaled_width, {_I('z.h')} AS height, {_I('d')} AS denominator FROM sized",
)
def header_size(spark, d):
    """Sizes from the sequence, the frame, the frame before or the key frame."""
    return frames(spark, d, "header.size.width", "header.size.upscaled_width", "header.size.height", "header.size.denominator")


@query(
    "header_tiling",
    f"{SQL}, own AS (SELECT *, CASE WHEN n = 1 OR ov = 0 OR mode = 0 THEN struct_pack(w := CASE WHEN ov = 1 THEN w ELSE 511 END, h := CASE WHEN ov = 1 THEN ht ELSE 299 END) END AS v FROM f),"
    f" keyed AS (SELECT *, first_value(v) OVER (PARTITION BY k ORDER BY n) AS first FROM own), held AS (SELECT *, CASE WHEN v IS NULL AND mode = 2 AND same = 0 THEN first ELSE v END AS u FROM keyed),"
    f" sized AS (SELECT *, {_LAST('u')} AS z, CASE WHEN sr = 1 THEN 9 + den ELSE 8 END AS d FROM held),"
    " b AS (SELECT *, CAST(ceil((z.w * 8 + d // 2) // d / 64) AS BIGINT) AS c, CAST(ceil(z.h / 64) AS BIGINT) AS r FROM sized)"
    f" SELECT k, n, {_I('1 + tc')} AS columns, {_I('1 + tr')} AS rows, {_I('CASE WHEN tc = 1 THEN (c + 1) // 2 ELSE c END')} AS second_column, {_I('CASE WHEN tr = 1 THEN (r + 1) // 2 ELSE r END')} AS second_row,"
    f" {_I('CASE WHEN tc + tr = 2 THEN 1 ELSE 0 END')} AS context_tile, {_I('CASE WHEN tc + tr > 0 THEN q % 4 + 1 ELSE 0 END')} AS size_bytes FROM b",
)
def header_tiling(spark, d):
    t = "header.tiling."
    return frames(spark, d, t + "columns", t + "rows", f"{t}column_starts[1] AS second_column", f"{t}row_starts[1] AS second_row", t + "context_tile", t + "size_bytes")


@query("header_quantiser", f"{SQL} SELECT k, n, {_I('base')} AS base, {_I('yd')} AS y_dc, {_I('ud')} AS u_dc, {_I('ud')} AS v_dc, {_I('0')} AS u_ac, {_I('CASE WHEN qm = 1 THEN p % 16 END')} AS level_y, {_I('CASE WHEN qm = 1 THEN s % 16 END')} AS level_v FROM f")
def header_quantiser(spark, d):
    return frames(spark, d, *[f"header.quantiser.{c}" for c in ("base", "y_dc", "u_dc", "v_dc", "u_ac", "level_y", "level_v")])


@query(
    "header_segmentation",
    f"{SQL}, own AS (SELECT *, CASE WHEN se = 0 THEN struct_pack(q := NULL, r := NULL, skip := NULL) WHEN sd = 1 THEN struct_pack(q := q - 25, r := p % 8, skip := (q + 1) % 2) END AS v FROM f), held AS (SELECT *, {_LAST('v')} AS z FROM own)"
    f" SELECT k, n, se = 1 AS enabled, se = 1 AND (pr = 0 OR um = 1) AS update_map, {_I('z.q')} AS delta, {_I('z.r')} AS reference, z.r IS NOT NULL AS preskip, {_I('CASE WHEN z.r IS NULL THEN 0 ELSE 2 END')} AS last,"
    f" {_I('greatest(0, least(255, base + coalesce(z.q, 0)))')} AS index, coalesce(z.skip, 0) = 1 AS skip FROM held",
)
def header_segmentation(spark, d):
    """Features of the third segment, from the frame or inherited from the frame before."""
    s = "header.segmentation."
    return frames(spark, d, s + "enabled", s + "update_map", f"{s}features[2][0] AS delta", f"{s}features[2][5] AS reference", s + "preskip", s + "last", f"{s}index[2] AS index", f"{s}features[2][6] IS NOT NULL AS skip")


@query(
    "header_filters",
    f"{SQL}, own AS (SELECT *, CASE WHEN du = 1 THEN q - 20 WHEN pr = 0 THEN 0 END AS r, CASE WHEN du = 1 AND s % 2 = 0 THEN p % 10 - 5 WHEN pr = 0 THEN 0 END AS m FROM f)"
    f" SELECT k, n, {_I('l0')} AS level, {_I('CASE WHEN l0 + l1 > 0 THEN s % 64 ELSE 0 END')} AS u, {_I('p % 8')} AS sharpness, {_I(_LAST('r'))} AS last_delta, {_I(_LAST('m'))} AS mode_delta, {_I('-1')} AS altref_delta,"
    f" {_I('q % 4 + 3')} AS damping, {_I('1 + cb')} AS strengths, {_I('(p + cb) % 16')} AS y_primary, {_I('CASE WHEN (p + cb) % 4 = 3 THEN 4 ELSE (p + cb) % 4 END')} AS uv_secondary,"
    " CASE ry WHEN 0 THEN 'none' WHEN 1 THEN 'switchable' WHEN 2 THEN 'wiener' ELSE 'self_guided' END AS luma_kind,"
    f" {_I('CASE WHEN ry + ru > 0 THEN 6 + ra + ra * rb - CASE WHEN ru > 0 THEN rc ELSE 0 END END')} AS chroma_bits FROM own",
)
def header_filters(spark, d):
    """Edge, directional and restoration filters; deltas of the edge filter come from the frame before where it is the primary reference."""
    f, c = "header.filter.", "header.cdef."
    return frames(
        spark, d, f"{f}levels[0] AS level", f + "u", f + "sharpness", f"{f}ref_deltas[1] AS last_delta", f"{f}mode_deltas[0] AS mode_delta", f"{f}ref_deltas[7] AS altref_delta",
        c + "damping", f"cast(size({c}y_primary) AS int) AS strengths", f"element_at({c}y_primary, -1) AS y_primary", f"element_at({c}uv_secondary, -1) AS uv_secondary", "header.restoration.kinds[0] AS luma_kind", "header.restoration.chroma_bits",
    )


# a symbol v moves a value up by v/2 or down by (v+1)/2, the other way round above 0
_STEP = lambda r, v: f"CASE WHEN {r} > 0 THEN {r} - CASE WHEN {v} % 2 = 0 THEN {v} // 2 ELSE -({v} + 1) // 2 END ELSE {r} + CASE WHEN {v} % 2 = 0 THEN {v} // 2 ELSE -({v} + 1) // 2 END END"


@query(
    "header_motion",
    SQL.replace("WITH", "WITH RECURSIVE", 1)
    + ", m AS (SELECT k, n, CAST(0 AS BIGINT) AS kind, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(65536 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM f WHERE n = 1 UNION ALL"
    " SELECT k, n, g, CASE g WHEN 0 THEN 0 WHEN 1 THEN (" + _STEP("(px >> t)", "(s % 8)") + ") * (1 << t) ELSE (" + _STEP("(px >> 10)", "(s % 8)") + ") * 1024 END,"
    " CASE g WHEN 0 THEN 0 WHEN 1 THEN (" + _STEP("(py >> t)", "((q + p) % 8)") + ") * (1 << t) ELSE (" + _STEP("(py >> 10)", "((q + p) % 8)") + ") * 1024 END,"
    " CASE WHEN g = 2 THEN (" + _STEP("((pa >> 1) - 32768)", "(q % 8)") + ") * 2 + 65536 ELSE 65536 END, CASE WHEN g = 2 THEN (" + _STEP("(pb >> 1)", "(p % 8)") + ") * 2 ELSE 0 END"
    " FROM (SELECT f.*, 14 - hp AS t, CASE WHEN pr = 1 THEN m.x ELSE 0 END AS px, CASE WHEN pr = 1 THEN m.y ELSE 0 END AS py, CASE WHEN pr = 1 THEN m.a ELSE 65536 END AS pa, CASE WHEN pr = 1 THEN m.b ELSE 0 END AS pb FROM f JOIN m ON f.k = m.k AND f.n = m.n + 1))"
    f" SELECT k, n, {_I('kind')} AS kind, {_I('x')} AS x, {_I('y')} AS y, {_I('a')} AS a, {_I('b')} AS b, {_I('CASE WHEN kind = 2 THEN -b ELSE 0 END')} AS c, {_I('0')} AS other FROM m",
)
def header_motion(spark, d):
    """Motion of the first reference, coded by its distance from that of the primary reference."""
    m = "header.motion[0]."
    return frames(spark, d, f"{m}kind AS kind", f"{m}params[0] AS x", f"{m}params[1] AS y", f"{m}params[2] AS a", f"{m}params[3] AS b", f"{m}params[4] AS c", "header.motion[3].kind AS other")


@query(
    "header_grain",
    f"{SQL}, own AS (SELECT *, CASE WHEN ga = 0 THEN struct_pack(on_ := 0, q := NULL, p := NULL, s := NULL) WHEN gu = 1 THEN struct_pack(on_ := 1, q := q, p := p, s := s) END AS v FROM f), held AS (SELECT *, {_LAST('v')} AS z FROM own)"
    f" SELECT k, n, z.on_ = 1 AS apply, {_I('CASE WHEN ga = 1 THEN seed ELSE 0 END')} AS seed, {_I('CASE WHEN ga = 1 AND gu = 0 THEN 1 + (n - 1) % 7 END')} AS reference, {_I('CASE WHEN z.on_ = 1 THEN 1 + z.q % 2 ELSE 0 END')} AS luma_points, {_I('z.p % 256')} AS first_scaling,"
    f" {_I('z.s % 200')} AS cr_scaling, {_I('z.q % 4 + 8')} AS scaling_shift, {_I('z.p % 256 - 128')} AS ar_cb, {_I('z.q * 3 - 128')} AS cb_mult, {_I('z.p % 512 - 256')} AS cr_offset, z.s % 2 = 1 AS clip FROM held",
)
def header_grain(spark, d):
    """Grain of the frame or of the frame before, always with a seed of its own."""
    g = "header.grain."
    first = lambda a: f"get({g}{a}, 0)"
    return frames(spark, d, g + "apply", g + "seed", g + "reference", f"cast(size({g}y) AS int) AS luma_points", f"{first('y')}.scaling AS first_scaling", f"{first('cr')}.scaling AS cr_scaling", g + "scaling_shift", f"{first('ar_cb')} AS ar_cb", g + "cb_mult", g + "cr_offset", g + "clip")


@query(
    "header_references",
    f"{SQL} SELECT k, n, {_I('CASE WHEN n = 1 THEN 0 ELSE 1 END')} AS frame_type, {_I('hint')} AS order_hint, {_I('CASE WHEN n = 1 THEN 255 ELSE 1 << (1 + n % 7) END')} AS refresh, {_I('CASE WHEN pr = 1 THEN 0 ELSE 7 END')} AS primary_ref, {_I('CASE WHEN n > 1 THEN 1 + (n - 1) % 7 END')} AS first_ref,"
    f" cp = 1 AS compound, cp = 1 AND same = 0 AND n > 2 AS skip_allowed, cp = 1 AND same = 0 AND n > 2 AND p % 2 = 1 AS skip_mode, {_I('CASE WHEN cp = 1 AND same = 0 AND n > 2 THEN 1 END')} AS second_skip_ref,"
    " CASE tx WHEN 1 THEN 'select' ELSE 'largest' END AS transform_mode, n > 1 AND s % 2 = 1 AS warped FROM f",
)
def header_references(spark, d):
    """References, order hints and the skip mode that follows from them."""
    return frames(spark, d, *[f"header.{c}" for c in ("frame_type", "order_hint", "refresh", "primary_ref")], "get(header.refs, 0) AS first_ref", "header.compound", "header.skip_allowed", "header.skip_mode", "header.skip_refs[1] AS second_skip_ref", "header.transform_mode", "header.warped")


@query(
    "header_errors",
    f"{SQL}, bad AS (SELECT k, n, min(CASE WHEN q % 7 = 3 THEN n END) OVER (PARTITION BY k) AS first FROM f) SELECT k, n, coalesce(n < first, true) AS has_header, CASE WHEN n = first THEN 'a header ends early' WHEN n > first THEN 'an earlier header of the segment is broken' END AS error FROM bad",
)
def header_errors(spark, d):
    """Some headers are cut off: an error for these, and for those that would inherit from them."""
    return frames(spark, d, "header IS NOT NULL AS has_header", "error", cut="q % 7 = 3")


_PART = "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s FROM part"


@query(
    "sequence_header_fields",
    f"WITH f AS ({_PART}) SELECT k, {_I('k % 3')} AS profile, {_I('CASE WHEN k % 2 = 1 THEN s + 1 END')} AS timing_scale, {_I('1 + k % 4')} AS points, {_I('(k % 4) * 3 % 12')} AS last_level, {_I('s * 40')} AS max_width, {_I('s * 30')} AS max_height, k % 5 = 0 AS frame_ids, {_I('CASE WHEN k % 5 = 0 THEN 2 + k % 16 + 1 + s % 8 ELSE 0 END')} AS id_bits,"
    f" {_I('CASE WHEN s % 3 = 0 THEN 0 ELSE 1 + k % 8 END')} AS order_bits, {_I('CASE WHEN s % 4 = 0 THEN 2 ELSE s % 2 END')} AS screen_content, {_I('CASE WHEN k % 3 = 2 AND s % 2 = 1 AND k % 4 = 1 THEN 12 WHEN s % 2 = 1 THEN 10 ELSE 8 END')} AS depth,"
    f" k % 3 <> 1 AND k % 7 = 0 AS monochrome, {_I('CASE WHEN s % 5 = 0 THEN 9 ELSE 2 END')} AS primaries, {_I('CASE WHEN k % 3 <> 1 AND k % 7 = 0 THEN 1 WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 0 WHEN s % 2 = 1 AND k % 4 = 1 THEN k % 2 ELSE 1 END')} AS sub_x,"
    f" {_I('CASE WHEN k % 3 <> 1 AND k % 7 = 0 THEN 1 WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 0 WHEN s % 2 = 1 AND k % 4 = 1 AND k % 2 = 1 THEN s % 2 ELSE 0 END')} AS sub_y, s % 2 = 0 AS grain FROM f",
)
def sequence_header_fields(spark, d):
    """Full sequence headers of all profiles, with timing, several operating points, frame ids and colours."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"))
    timing = bits(("k % 2", 1), where("k % 2 = 1", ("k", 32), ("s + 1", 32), "0", "0"))
    points = F.concat(*[where(f"k % 4 >= {i}", ("0", 12), (f"{i * 3 % 12}", 5), "0" if i * 3 % 12 > 7 else "") for i in range(4)])
    size = bits("1011", "1010", ("s * 40 - 1", 12), ("s * 30 - 1", 11))
    ids = bits(("if(k % 5 = 0, 1, 0)", 1), where("k % 5 = 0", ("k % 16", 4), ("s % 8", 3)))
    tools = bits("000", "0000", where("s % 3 = 0", "0"), where("s % 3 <> 0", "1", "00"), where("s % 4 = 0", "1"), where("s % 4 <> 0", "0", ("s % 2", 1)), where("s % 4 = 0 or s % 2 = 1", "1"), where("s % 3 <> 0", ("k % 8", 3)), "000")
    deep = "k % 3 = 2 and s % 2 = 1 and k % 4 = 1"
    mono = "k % 3 <> 1 and k % 7 = 0"
    # profile 2 of 10 bits is 4:2:2, of 12 bits any
    depth = bits(("s % 2", 1), where("k % 3 = 2 and s % 2 = 1", ("if(k % 4 = 1, 1, 0)", 1)), where("k % 3 <> 1", ("if(k % 7 = 0, 1, 0)", 1)))
    described = bits(("if(s % 5 = 0, 1, 0)", 1), where("s % 5 = 0", ("9", 8), ("16", 8), ("9", 8)))
    sampling = where(f"not ({mono})", where(deep, ("k % 2", 1), where("k % 2 = 1", ("s % 2", 1))), where(f"k % 3 = 0 or ({deep} and k % 2 = 1 and s % 2 = 1)", "00"), "0")
    text = bits(("k % 3", 3), "00", timing, "0", ("k % 4", 5), points, size, ids, tools, depth, described, "0", sampling, ("(s + 1) % 2", 1))
    rows = parts.select(F.col("k").cast("string").alias("stream_id"), F.lit(0).cast("long").alias("obu_index"), F.lit(0).cast("long").alias("unit"), F.lit(1).alias("type"), F.lit(0).alias("temporal_id"), F.lit(0).alias("spatial_id"), packed(text).alias("payload"))
    got = headers.headers(rows).withColumn("x", F.col("sequence"))
    plain = ["profile", "timing_scale", "max_width", "max_height", "frame_ids", "id_bits", "order_bits", "screen_content", "depth", "monochrome", "primaries", "sub_x", "sub_y", "grain"]
    return got.select(F.col("stream_id").cast("bigint").alias("k"), *[(F.col("x.timing_scale").cast("int") if c == "timing_scale" else F.col(f"x.{c}")).alias(c) for c in plain], F.size("x.points").alias("points"), F.element_at("x.points", -1)["level"].alias("last_level"))


_SIZED = (
    f"{SQL}, own AS (SELECT *, CASE WHEN n = 1 OR ov = 0 OR mode = 0 THEN struct_pack(w := CASE WHEN ov = 1 THEN w ELSE 511 END, h := CASE WHEN ov = 1 THEN ht ELSE 299 END) END AS v FROM f),"
    f" keyed AS (SELECT *, first_value(v) OVER (PARTITION BY k ORDER BY n) AS first FROM own), held AS (SELECT *, CASE WHEN v IS NULL AND mode = 2 AND same = 0 THEN first ELSE v END AS u FROM keyed),"
    f" sized AS (SELECT *, {_LAST('u')} AS z, CASE WHEN sr = 1 THEN 9 + den ELSE 8 END AS d FROM held),"
    " w AS (SELECT *, (z.w * 8 + d // 2) // d AS cw, lag(z) OVER (PARTITION BY k ORDER BY n) AS before FROM sized),"
    " b AS (SELECT *, (cw + 63) // 64 AS c, (z.h + 63) // 64 AS r FROM w)"
)


@query(
    "header_violations",
    f"{_SIZED}, x AS (SELECT k, n, unnest(list_filter([CASE WHEN z.w > 511 THEN 'width within the sequence' END, CASE WHEN z.h > 299 THEN 'height within the sequence' END,"
    " CASE WHEN cw - 64 * CASE WHEN tc = 1 THEN (c + 1) // 2 ELSE 0 END < 8 THEN 'tiles of eight columns' END, CASE WHEN z.h - 64 * CASE WHEN tr = 1 THEN (r + 1) // 2 ELSE 0 END < 8 THEN 'tiles of eight rows' END,"
    " CASE WHEN n > 1 AND (before.w > 2 * cw OR before.h > 2 * z.h OR (same = 0 AND (first.w > 2 * cw OR first.h > 2 * z.h))) THEN 'references up to twice the frame' END], lambda y: y IS NOT NULL)) AS rule FROM b) SELECT k, n, rule FROM x",
)
def header_violations(spark, d):
    """Rules that the frames of all streams break."""
    h = read_headers(spark, d, conformance.FIELDS, active=True)
    return conformance.violations(h, conformance.rules()).select(F.col("stream_id").cast("bigint").alias("k"), F.col("obu_index").alias("n"), "rule")
