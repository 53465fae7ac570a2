"""Queries on samples: colour, alpha, gain maps, geometry, per-sample programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataplane.functions import colour, postfix
from strataplane.operators import geometry
from strataplane.plans.base import PX, blocks, px, query, table


def _b(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


@query("px_explode_quantize", f"WITH {PX} SELECT vec_id, y, x, v FROM px")
def px_explode_quantize(spark, d):
    return px(spark, d)


# ---- colour conversion: luma from the block, chroma point-sampled from its own corner

YUV = f"WITH {PX}, j AS (SELECT a.vec_id, a.y, a.x, a.v AS l, u.v AS u, w.v AS w FROM px a JOIN px u ON u.vec_id = a.vec_id AND u.y = a.y >> 1 AND u.x = a.x >> 1 JOIN px w ON w.vec_id = a.vec_id AND w.y = 4 + (a.y >> 1) AND w.x = 4 + (a.x >> 1))"


def planes_420(spark, d):
    """(vec_id, y, x, l, u, w): U is the block's top-left 4x4, V its bottom-right one; luma meets chroma at (y >> 1, x >> 1).

    All three planes are in one row, so the subsampled join is an array lookup and nothing is shuffled.
    """
    each = blocks(spark, d).select("vec_id", "s", F.posexplode("s").alias("i", "l"))
    y, x = F.floor(F.col("i") / 8).cast("int"), (F.col("i") % 8).cast("int")
    cy, cx = F.shiftright(y, 1), F.shiftright(x, 1)
    return each.select("vec_id", y.cast("bigint").alias("y"), x.cast("bigint").alias("x"), "l", F.element_at("s", cy * 8 + cx + 1).alias("u"), F.element_at("s", (cy + 4) * 8 + cx + 4 + 1).alias("w"))


def rgb_query(matrix: int, full: bool):
    def run(spark, d):
        r, g, b = colour.yuv_to_rgb(F.col("l"), F.col("u"), F.col("w"), matrix, full)
        return planes_420(spark, d).select("vec_id", "y", "x", r.cast("bigint").alias("r"), g.cast("bigint").alias("g"), b.cast("bigint").alias("b"))

    return run


def rgb_sql(matrix: int, full: bool) -> str:
    yo = 0 if full else 16
    if matrix == 0:
        out = ("w", "l", "u")
    elif matrix == 8:
        s, c = (65536, 65536) if full else (76309, 74606)
        lum, cg, co = f"greatest(0, l - {yo}) * {s}", f"(u - 128) * {c}", f"(w - 128) * {c}"
        out = tuple(f"greatest(0, least(255, ({e} + 32768) >> 16))" for e in (f"{lum} - {cg} + {co}", f"{lum} + {cg}", f"{lum} - {cg} - {co}"))
    else:
        k = colour.coefficients(matrix, full)
        lum = f"greatest(0, l - {yo}) * {k['y']}"
        out = tuple(f"greatest(0, least(255, ({lum} + {e} + 32768) >> 16))" for e in (f"(w - 128) * {k['rv']}", f"(u - 128) * {k['gu']} + (w - 128) * {k['gv']}", f"(u - 128) * {k['bu']}"))
    return f"{YUV} SELECT vec_id, y, x, {_b(out[0])} AS r, {_b(out[1])} AS g, {_b(out[2])} AS b FROM j"


for _name, _code in {"bt601": 6, "bt709": 1, "fcc": 4, "smpte240": 7, "bt2020": 9, "ycgco": 8, "identity": 0}.items():
    query(f"yuv420_to_rgb_{_name}", rgb_sql(_code, True))(rgb_query(_code, True))
    if _code:
        query(f"yuv420_to_rgb_{_name}_limited", rgb_sql(_code, False))(rgb_query(_code, False))


@query("yuv444_to_rgb", f"WITH {PX}, j AS (SELECT a.vec_id, a.y, a.x, a.v AS l, u.v AS u, w.v AS w FROM px a JOIN px u ON u.vec_id = a.vec_id AND u.y = a.x AND u.x = a.y JOIN px w ON w.vec_id = a.vec_id AND w.y = 7 - a.y AND w.x = a.x)" + rgb_sql(1, True)[len(YUV) :])
def yuv444_to_rgb(spark, d):
    each = blocks(spark, d).select("vec_id", "s", F.posexplode("s").alias("i", "l"))
    y, x = F.floor(F.col("i") / 8).cast("int"), (F.col("i") % 8).cast("int")
    rows = each.select("vec_id", y.cast("bigint").alias("y"), x.cast("bigint").alias("x"), "l", F.element_at("s", x * 8 + y + 1).alias("u"), F.element_at("s", (7 - y) * 8 + x + 1).alias("w"))
    r, g, b = colour.yuv_to_rgb(F.col("l"), F.col("u"), F.col("w"), 1, True)
    return rows.select("vec_id", "y", "x", r.cast("bigint").alias("r"), g.cast("bigint").alias("g"), b.cast("bigint").alias("b"))


@query("grey_expand", f"WITH {PX} SELECT vec_id, y, x, v AS r, v AS g, v AS b, CAST(v * 257 AS BIGINT) AS v16 FROM px")
def grey_expand(spark, d):
    return px(spark, d).select("vec_id", "y", "x", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"), colour.scale_sample(F.col("v"), 255, 65535).alias("v16"))


@query("pixel_pack_argb", f"WITH {PX} SELECT vec_id, y, x, CAST(4278190080 + v * 65536 + v * 256 + v AS BIGINT) AS argb, CAST((v * 1023 + 127) // 255 AS BIGINT) AS v10 FROM px")
def pixel_pack_argb(spark, d):
    v = F.col("v")
    packed = F.lit(0xFF000000).cast("bigint").bitwiseOR(F.shiftleft(v, 16)).bitwiseOR(F.shiftleft(v, 8)).bitwiseOR(v)
    return px(spark, d).select("vec_id", "y", "x", packed.alias("argb"), colour.scale_sample(v, 255, 1023).alias("v10"))


@query(
    "matrix_lookup",
    "SELECT n_nationkey, n_name, CASE n_nationkey WHEN 1 THEN 0.2126::DOUBLE WHEN 2 THEN 0.299::DOUBLE WHEN 4 THEN 0.3::DOUBLE WHEN 5 THEN 0.299::DOUBLE WHEN 6 THEN 0.299::DOUBLE WHEN 7 THEN 0.212::DOUBLE WHEN 9 THEN 0.2627::DOUBLE END AS kr FROM nation WHERE n_nationkey IN (1, 2, 4, 5, 6, 7, 9)",
)
def matrix_lookup(spark, d):
    codes = spark.createDataFrame([(c, colour.weights_of(c)[0]) for c in (1, 2, 4, 5, 6, 7, 9)], "n_nationkey int, kr double")
    return table(spark, d, "nation").join(F.broadcast(codes), "n_nationkey").select("n_nationkey", "n_name", "kr")  # a table of seven rows


ALPHA = f"WITH {PX}, j AS (SELECT a.vec_id, a.y, a.x, a.v AS c, b.v AS a FROM px a LEFT JOIN px b ON b.vec_id = a.vec_id + 1 AND b.y = a.y AND b.x = a.x)"


def _alpha(spark, d):
    """Each block's samples c with those of the next block as alpha a (null without one): one join of whole planes."""
    own = blocks(spark, d)
    other = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"))
    both = own.join(other, "vec_id", "left").select("vec_id", F.posexplode(F.arrays_zip(F.col("s").alias("c"), F.coalesce("t", F.array_repeat(F.lit(None).cast("bigint"), 64)).alias("a"))).alias("i", "p"))
    return both.select("vec_id", F.floor(F.col("i") / 8).cast("bigint").alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), F.col("p")["c"].alias("c"), F.col("p")["a"].alias("a"))


@query("alpha_join", f"{ALPHA} SELECT vec_id, y, x, c, coalesce(a, 255) AS a FROM j")
def alpha_join(spark, d):
    return _alpha(spark, d).withColumn("a", F.coalesce("a", F.lit(255).cast("bigint")))


@query("alpha_limited_to_full", f"WITH {PX} SELECT vec_id, y, x, {_b('greatest(0, least(255, ((v - 16) * 255 + 109) // 219))')} AS a FROM px")
def alpha_limited_to_full(spark, d):
    return px(spark, d).select("vec_id", "y", "x", colour.alpha_full(F.col("v"), 8).cast("bigint").alias("a"))


@query("unpremultiply", f"{ALPHA} SELECT vec_id, y, x, {_b('CASE WHEN a = 0 THEN 0 WHEN a = 255 THEN c ELSE least(255, (c * 255 + a // 2) // a) END')} AS c FROM j WHERE a IS NOT NULL")
def unpremultiply(spark, d):
    return _alpha(spark, d).where("a is not null").select("vec_id", "y", "x", colour.unpremultiply(F.col("c"), F.col("a")).cast("bigint").alias("c"))


@query(
    "gain_map_apply",
    f"WITH {PX} SELECT a.vec_id, a.y, a.x, {_b('floor(least(greatest(round((power(a.v / 255.0::DOUBLE, 2.2::DOUBLE) + 0.015625) * power(2::DOUBLE, 2.0::DOUBLE * power(g.v / 255.0::DOUBLE, 1::DOUBLE / 1.5) * 0.75) - 0.015625, 9), 0), 1) * 255 + 0.5)')} AS v FROM px a JOIN px g ON g.vec_id = a.vec_id AND g.y = (a.y * 4 // 8) * 2 AND g.x = (a.x * 4 // 8) * 2",
)
def gain_map_apply(spark, d):
    """Base samples under a 4x4 map (the block's even samples), headroom 1.5 of base 0 and alternate 2."""
    each = blocks(spark, d).select("vec_id", "s", F.posexplode("s").alias("i", "v"))
    y, x = F.floor(F.col("i") / 8).cast("int"), (F.col("i") % 8).cast("int")
    near = F.element_at("s", F.shiftright(y, 1) * 16 + F.shiftright(x, 1) * 2 + 1)
    linear, w = colour.to_linear(F.col("v") / 255.0, 4), colour.gain_weight(F.lit(1.5), 0.0, 2.0)
    out = colour.gain_apply(linear, near / 255.0, w, 0.0, 2.0, 1.5, 0.015625, 0.015625)
    return each.select("vec_id", y.cast("bigint").alias("y"), x.cast("bigint").alias("x"), colour.to_integer(F.round(out, 9), 255).alias("v"))


@query("gain_map_weight", "SELECT l_orderkey, l_linenumber, round(least(greatest((l_quantity / 10.0::DOUBLE - 1) / 3, 0), 1), 9) AS up, round(-least(greatest((l_quantity / 10.0::DOUBLE - 4) / -3, 0), 1), 9) + 0 AS down FROM lineitem")
def gain_map_weight(spark, d):
    h = F.col("l_quantity") / 10.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(colour.gain_weight(h, 1.0, 4.0), 9).alias("up"), (F.round(colour.gain_weight(h, 4.0, 1.0), 9) + 0).alias("down"))


# ---- transfer curves on l_discount * 10 (0..1)

CURVES = {"srgb": 13, "bt709": 1, "smpte240": 7, "log100": 9, "log316": 10, "pq": 16, "hlg": 18, "smpte428": 17, "gamma22": 4, "gamma28": 5, "linear": 8}
_X = "least(greatest(l_discount * 10, 0), 1)"
_D = "::DOUBLE"
EOTF_SQL = {
    "srgb": "CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE power((x + 0.055) / 1.055, 2.4) END",
    "bt709": "CASE WHEN x < 0.0812428582986315 THEN x / 4.5 ELSE power((x + 0.099296826809442) / 1.099296826809442, 1 / 0.45::DOUBLE) END",
    "smpte240": "CASE WHEN x < 0.09128634211778 THEN x / 4 ELSE power((x + 0.111572195921731) / 1.111572195921731, 1 / 0.45::DOUBLE) END",
    "log100": "CASE WHEN x <= 0 THEN 0 ELSE power(10::DOUBLE, (x - 1) * 2) END",
    "log316": "CASE WHEN x <= 0 THEN 0 ELSE power(10::DOUBLE, (x - 1) * 2.5) END",
    "pq": "power(greatest(power(x, 32 / 2523::DOUBLE) - 0.8359375, 0) / (18.8515625 - power(x, 32 / 2523::DOUBLE) * 18.6875), 16384 / 2610::DOUBLE)",
    "hlg": "CASE WHEN x <= 0.5 THEN x * x / 3 ELSE (exp((x - 0.55991073) / 0.17883277) + 0.28466892) / 12 END",
    "smpte428": "power(x, 2.6) * (52.37 / 48::DOUBLE)",
    "gamma22": "power(x, 2.2)",
    "gamma28": "power(x, 2.8)",
    "linear": "x",
}
OETF_SQL = {
    "srgb": "CASE WHEN x <= 0.0031308 THEN x * 12.92 ELSE power(x, 1 / 2.4::DOUBLE) * 1.055 - 0.055 END",
    "bt709": "CASE WHEN x < 0.018053968510807 THEN x * 4.5 ELSE power(x, 0.45) * 1.099296826809442 - 0.099296826809442 END",
    "smpte240": "CASE WHEN x < 0.022821585529445 THEN x * 4 ELSE power(x, 0.45) * 1.111572195921731 - 0.111572195921731 END",
    "log100": "CASE WHEN x < 0.01 THEN 0 ELSE log10(greatest(x, 0.01)) / 2 + 1 END",
    "log316": "CASE WHEN x < sqrt(10::DOUBLE) / 1000 THEN 0 ELSE log10(greatest(x, sqrt(10::DOUBLE) / 1000)) / 2.5 + 1 END",
    "pq": "power((power(x, 2610 / 16384::DOUBLE) * 18.8515625 + 0.8359375) / (power(x, 2610 / 16384::DOUBLE) * 18.6875 + 1), 2523 / 32::DOUBLE)",
    "hlg": "CASE WHEN x <= 1 / 12::DOUBLE THEN sqrt(x * 3) ELSE ln(greatest(x * 12 - 0.28466892, 1e-9)) * 0.17883277 + 0.55991073 END",
    "smpte428": "power(x * (48 / 52.37::DOUBLE), 1 / 2.6::DOUBLE)",
    "gamma22": "power(x, 1 / 2.2::DOUBLE)",
    "gamma28": "power(x, 1 / 2.8::DOUBLE)",
    "linear": "x",
}


def transfer_query(code: int, decode: bool):
    def run(spark, d):
        curve = (colour.to_linear if decode else colour.from_linear)(F.col("l_discount") * 10, code)
        return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(curve.cast("double"), 9).alias("v"))

    return run


for _name, _code in CURVES.items():
    for _kind, _sql, _decode in (("eotf", EOTF_SQL[_name], True), ("oetf", OETF_SQL[_name], False)):
        query(f"transfer_{_name}_{_kind}", f"SELECT l_orderkey, l_linenumber, round(CAST({_sql} AS DOUBLE), 9) AS v FROM (SELECT l_orderkey, l_linenumber, {_X} AS x FROM lineitem)")(transfer_query(_code, _decode))


def gamut_query(source: int, target: int):
    def run(spark, d):
        rgb = (F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 50)
        r, g, b = colour.gamut(rgb, source, target)
        return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(r, 9).alias("r"), F.round(g, 9).alias("g"), F.round(b, 9).alias("b"))

    return run


def gamut_sql(source: int, target: int) -> str:
    """The matrix as literals; tests hold it against published values."""
    rows = colour.gamut_matrix(source, target)
    parts = [f"round((l_discount * 10) * {a!r}::DOUBLE + (l_tax * 12.5) * {b!r}::DOUBLE + (l_quantity / 50) * {c!r}::DOUBLE, 9) AS {n}" for n, (a, b, c) in zip("rgb", rows.tolist(), strict=True)]
    return f"SELECT l_orderkey, l_linenumber, {', '.join(parts)} FROM lineitem"


for _s, _t in ((9, 1), (1, 9), (12, 9)):
    query(f"gamut_convert_{_s}_{_t}", gamut_sql(_s, _t))(gamut_query(_s, _t))


@query("colour_equality", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 1 ELSE l_linenumber END = CASE WHEN l_suppkey % 4 = 2 THEN 1 ELSE l_suppkey % 4 END AS same FROM lineitem")
def colour_equality(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", colour.same_colour(F.col("l_linenumber").cast("bigint"), F.col("l_suppkey") % 4, 1).alias("same"))


# ---- geometry

_REMAP = {"rotate_90": ("7 - x", "y"), "rotate_180": ("7 - y", "7 - x"), "rotate_270": ("x", "7 - y"), "mirror_0": ("7 - y", "x"), "mirror_1": ("y", "7 - x")}
for _name, (_y, _x) in _REMAP.items():
    _k, _n = _name.split("_")
    _f = (lambda n: lambda spark, d: geometry.rotate(px(spark, d), 8, 8, n // 90))(int(_n)) if _k == "rotate" else (lambda n: lambda spark, d: geometry.mirror(px(spark, d), 8, 8, n))(int(_n))
    query(_name, f"WITH {PX} SELECT vec_id, {_b(_y)} AS y, {_b(_x)} AS x, v FROM px")(_f)


@query("crop", f"WITH {PX} SELECT vec_id, y - 1 AS y, x - 2 AS x, v FROM px WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def crop(spark, d):
    return geometry.crop(px(spark, d), 2, 1, 5, 4)


@query("crop_rotate_mirror", f"WITH {PX} SELECT vec_id, 4 - (4 - (x - 2)) AS y, y - 1 AS x, v FROM px WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def crop_rotate_mirror(spark, d):
    return geometry.transformed(px(spark, d), 8, 8, (2, 1, 5, 4), 1, 0)


@query("display_size", "SELECT p_partkey, CASE WHEN p_size % 4 IN (1, 3) THEN p_size ELSE p_partkey END AS w, CASE WHEN p_size % 4 IN (1, 3) THEN p_partkey ELSE p_size END AS h FROM part")
def display_size(spark, d):
    w, h = geometry.display_size(F.col("p_partkey"), F.col("p_size").cast("bigint"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("grid_compose", f"WITH {PX}, g AS (SELECT vec_id // 4 AS grid, (vec_id % 4 // 2) * 8 + y AS y, (vec_id % 2) * 8 + x AS x, v FROM px) SELECT * FROM g WHERE x < 13 AND y < 14")
def grid_compose(spark, d):
    cells = px(spark, d).select(F.expr("vec_id div 4").alias("grid"), (F.col("vec_id") % 4).alias("cell"), "y", "x", "v")
    return geometry.compose_grid(cells, 2, 8, 8, 13, 14)


@query(
    "tile_list_assembly",
    f"WITH {PX}, n AS (SELECT count(*) AS n FROM embeddings), o AS (SELECT o_orderkey AS frame, o_custkey % n AS tile, o_custkey % 2 AS ty, o_custkey % 3 AS tx FROM orders, n)"
    " SELECT frame, CAST(sum(v * (((ty * 8 + y) * 24 + tx * 8 + x) % 1009 + 1)) AS BIGINT) AS digest, CAST(min(ty * 8 + y) AS BIGINT) AS top, CAST(max(tx * 8 + x) AS BIGINT) AS \"right\", count(*) AS samples FROM o JOIN px ON vec_id = tile GROUP BY frame",
)
def tile_list_assembly(spark, d):
    """A tile for each order, placed in its frame; digests of the frames' samples and places."""
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))  # one row
    placed = table(spark, d, "orders").join(F.broadcast(n)).select(F.col("o_orderkey").alias("frame"), F.expr("o_custkey % n").alias("tile"), F.expr("o_custkey % 2").alias("ty"), F.expr("o_custkey % 3").alias("tx"))
    merged = geometry.merge_tiles(px(spark, d).withColumnRenamed("vec_id", "tile"), placed, 8, 8)
    return merged.groupBy("frame").agg(F.sum(F.expr("v * ((y * 24 + x) % 1009 + 1)")).cast("bigint").alias("digest"), F.min("y").cast("bigint").alias("top"), F.max("x").cast("bigint").alias("right"), F.count(F.lit(1)).alias("samples"))


@query(
    "clap_origin",
    """WITH r AS (SELECT p_partkey, 200 + p_size AS sw, 100 + p_partkey % 50 AS sh, 3 * p_size + 100 AS wn, 2 AS wd, p_partkey % 60 + 20 AS hn, 1 AS hd, p_size - 25 AS xn, 3 AS xd, p_partkey % 7 - 3 AS yn, 2 AS yd FROM part),
q AS (SELECT p_partkey, sw, sh, (wn + wd - 1) // wd AS w, (hn + hd - 1) // hd AS h,
  CAST(floor((sw * wd * xd + 2 * xn * wd - wn * xd) / (2.0 * wd * xd)) AS BIGINT) AS x, CAST(floor((sh * hd * yd + 2 * yn * hd - hn * yd) / (2.0 * hd * yd)) AS BIGINT) AS y FROM r)
SELECT p_partkey, CAST(greatest(0, least(x, sw)) AS BIGINT) AS cx, CAST(greatest(0, least(y, sh)) AS BIGINT) AS cy,
  CAST(greatest(0, least(x + w, sw) - greatest(0, least(x, sw))) AS BIGINT) AS cw, CAST(greatest(0, least(y + h, sh) - greatest(0, least(y, sh))) AS BIGINT) AS ch FROM q""",
)
def clap_origin(spark, d):
    size, key = F.col("p_size").cast("bigint"), F.col("p_partkey")
    one = lambda n: F.lit(n).cast("bigint")
    r = geometry.clean_aperture(size + 200, key % 50 + 100, (size * 3 + 100, one(2)), (key % 60 + 20, one(1)), (size - 25, one(3)), (key % 7 - 3, one(2)))
    return table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in r.items()])


# ---- per-sample programs on lineitem integers

_A, _B = "CAST(l_extendedprice AS BIGINT)", "(CAST(l_quantity AS BIGINT) - 25)"


def _sat(e: str, bits: int) -> str:
    return f"greatest(least(CAST({e} AS HUGEINT), {(1 << bits - 1) - 1}), {-(1 << bits - 1)})"


PROGRAMS = {
    "neg": (16, [("in", 1), "neg"], lambda a, b: _sat(f"-{b}", 16)),
    "abs": (16, [("in", 1), "abs"], lambda a, b: _sat(f"abs({b})", 16)),
    "not": (32, [("in", 0), "not"], lambda a, b: f"-({a}) - 1"),
    "bsr": (32, [("in", 0), "bsr"], lambda a, b: f"CASE WHEN {a} <= 0 THEN 0 ELSE length(bin({a})) - 1 END"),
    "sum": (32, [("in", 0), ("in", 1), "sum"], lambda a, b: _sat(f"{a} + {b}", 32)),
    "diff": (32, [("in", 0), ("in", 1), "diff"], lambda a, b: _sat(f"{a} - {b}", 32)),
    "prod": (32, [("in", 0), ("in", 0), "prod"], lambda a, b: _sat(f"{a} * {a}", 32)),
    "quot": (32, [("in", 0), ("in", 1), "quot"], lambda a, b: f"CASE WHEN {b} = 0 THEN {a} ELSE {a} // {b} END"),
    "and": (32, [("in", 0), ("in", 1), "and"], lambda a, b: f"{a} & {b}"),
    "or": (32, [("in", 0), ("in", 1), "or"], lambda a, b: f"{a} | {b}"),
    "xor": (32, [("in", 0), ("in", 1), "xor"], lambda a, b: f"xor({a}, {b})"),
    "pow": (16, [("in", 1), ("const", 2), "pow"], lambda a, b: _sat(f"{b} * {b}", 16)),
    "min": (32, [("in", 0), ("in", 1), "min"], lambda a, b: f"least({a}, {b})"),
    "max": (32, [("in", 0), ("in", 1), "max"], lambda a, b: f"greatest({a}, {b})"),
    "compound_8": (8, [("in", 1), ("in", 1), "prod", ("const", 100), "diff", ("const", 3), "quot"], lambda a, b: f"{_sat(_sat(f'{b} * {b}', 8) + ' - 100', 8)} // 3"),
    "compound_32": (32, [("in", 0), ("in", 1), "prod", ("in", 0), "sum", ("const", 7), "xor"], lambda a, b: f"xor({_sat(_sat(f'{a} * {b}', 32) + f' + {a}', 32)}, 7)"),
    "compound_64": (64, [("in", 0), ("in", 0), "prod", ("in", 0), "prod", ("in", 0), "prod", ("in", 1), "sum"], lambda a, b: _sat(_sat(f"CAST({_sat(f'CAST({a} AS HUGEINT) * {a} * {a}', 64)} AS HUGEINT) * {a}", 64) + f" + {b}", 64)),
}


def program_query(bits: int, program: list):
    def run(spark, d):
        a, b = F.col("l_extendedprice").cast("bigint"), F.col("l_quantity").cast("bigint") - 25
        out = postfix.compile_program(program, [F.col("a"), F.col("b")], bits, -(1 << bits - 1), (1 << bits - 1) - 1)
        rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
        if bits == 16:
            rows = rows.where("b between -32768 and 32767")
        return rows.select("l_orderkey", "l_linenumber", out.cast("bigint").alias("v"))

    return run


for _name, (_bits, _program, _sql) in PROGRAMS.items():
    # double to bigint truncates in Spark and rounds in DuckDB
    query(f"sato_{_name}", f"SELECT l_orderkey, l_linenumber, CAST({_sql('a', 'b')} AS BIGINT) AS v FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS a, CAST(trunc(l_quantity) AS BIGINT) - 25 AS b FROM lineitem)")(program_query(_bits, _program))

