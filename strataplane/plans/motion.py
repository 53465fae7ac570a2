"""Queries on motion: blocks predicted from blocks, and affine models of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataplane.operators import masks, motion
from strataplane.plans.base import PX, blocks, query, table

# Taps in 1/128 by kind and fraction: regular, smooth, sharp, bilinear.
_TAPS = """t(kind, f, taps) AS (VALUES
(0,0,[0,0,0,128,0,0,0,0]),(0,1,[0,2,-6,126,8,-2,0,0]),(0,2,[0,2,-10,122,18,-4,0,0]),(0,3,[0,2,-12,116,28,-8,2,0]),(0,4,[0,2,-14,110,38,-10,2,0]),(0,5,[0,2,-14,102,48,-12,2,0]),(0,6,[0,2,-16,94,58,-12,2,0]),(0,7,[0,2,-14,84,66,-12,2,0]),(0,8,[0,2,-14,76,76,-14,2,0]),
(0,9,[0,2,-12,66,84,-14,2,0]),(0,10,[0,2,-12,58,94,-16,2,0]),(0,11,[0,2,-12,48,102,-14,2,0]),(0,12,[0,2,-10,38,110,-14,2,0]),(0,13,[0,2,-8,28,116,-12,2,0]),(0,14,[0,0,-4,18,122,-10,2,0]),(0,15,[0,0,-2,8,126,-6,2,0]),
(1,0,[0,0,0,128,0,0,0,0]),(1,1,[0,2,28,62,34,2,0,0]),(1,2,[0,0,26,62,36,4,0,0]),(1,3,[0,0,22,62,40,4,0,0]),(1,4,[0,0,20,60,42,6,0,0]),(1,5,[0,0,18,58,44,8,0,0]),(1,6,[0,0,16,56,46,10,0,0]),(1,7,[0,-2,16,54,48,12,0,0]),(1,8,[0,-2,14,52,52,14,-2,0]),
(1,9,[0,0,12,48,54,16,-2,0]),(1,10,[0,0,10,46,56,16,0,0]),(1,11,[0,0,8,44,58,18,0,0]),(1,12,[0,0,6,42,60,20,0,0]),(1,13,[0,0,4,40,62,22,0,0]),(1,14,[0,0,4,36,62,26,0,0]),(1,15,[0,0,2,34,62,28,2,0]))"""
# a block of 8 at (0, 0) with vector v (eighths) and scale f: position of sample i in 1/1024
_STEP = lambda f: f"(({f} + 8) >> 4)"
_START = lambda v, f: f"(CASE WHEN ({v} * 2 + 8) * {f} - 131072 < 0 THEN -((131072 - ({v} * 2 + 8) * {f} + 128) >> 8) ELSE (({v} * 2 + 8) * {f} - 131072 + 128) >> 8 END + 32)"


def _sql(fraction_y: str, fraction_x: str, scale_y: str, scale_x: str, kind_y: str, kind_x: str) -> str:
    return (
        f"WITH {PX}, {_TAPS}, b AS (SELECT DISTINCT vec_id, CAST({fraction_y} AS BIGINT) AS my, CAST({fraction_x} AS BIGINT) AS mx, CAST({scale_y} AS BIGINT) AS fy, CAST({scale_x} AS BIGINT) AS fx, {kind_y} AS ky, {kind_x} AS kx FROM embeddings),"
        f" p AS (SELECT *, {_START('my', 'fy')} AS y0, {_START('mx', 'fx')} AS x0, {_STEP('fy')} AS dy, {_STEP('fx')} AS dx FROM b),"
        " c AS (SELECT *, i, x0 + dx * i AS px FROM p, range(0, 8) r(i)),"
        " m AS (SELECT c.vec_id, ky, y0, dy, i, r, (sum(px.v * taps[k + 1]) + 4) >> 3 AS v FROM c, range(0, 32) q(r), range(0, 8) s(k), t, px"
        "  WHERE r < (7 * dy + 1023) // 1024 + 8 AND t.kind = kx AND t.f = (c.px >> 6) & 15 AND px.vec_id = c.vec_id AND px.x = greatest(0, least(7, (c.px >> 10) + k - 3)) AND px.y = greatest(0, least(7, (y0 >> 10) + r - 3)) GROUP BY ALL),"
        " o AS (SELECT vec_id, ky, i, j, k, ((y0 & 1023) + dy * j) AS py FROM (SELECT DISTINCT vec_id, ky, i, y0, dy FROM m), range(0, 8) r(j), range(0, 8) s(k))"
        " SELECT o.vec_id, j * 8 + o.i AS i, CAST(greatest(0, least(255, (sum(m.v * taps[k + 1]) + 1024) >> 11)) AS BIGINT) AS v FROM o JOIN m ON m.vec_id = o.vec_id AND m.i = o.i AND m.r = (py >> 10) + k JOIN t ON t.kind = o.ky AND t.f = (py >> 6) & 15 GROUP BY o.vec_id, j, o.i"
    )


def _predicted(spark, d, vector, current, kinds):
    lit = F.lit(0)
    got = motion.predict_blocks(blocks(spark, d), "vec_id", F.col("s"), (8, 8), (8, 8), (lit, lit), tuple(map(F.expr, vector)), tuple(map(F.expr, current)), tuple(map(F.expr, kinds)))
    return got.select("vec_id", F.posexplode("s").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), "v")


@query("eight_tap_mc", _sql("vec_id % 41 - 20", "vec_id % 37 - 18", "16384", "16384", "vec_id % 2", "vec_id // 2 % 2"))
def eight_tap_mc(spark, d):
    """Blocks moved by vectors of eighths of a sample, with regular and smooth taps in either direction."""
    return _predicted(spark, d, ("vec_id % 41 - 20", "vec_id % 37 - 18"), ("8", "8"), ("vec_id % 2", "vec_id div 2 % 2"))


@query("scaled_mc", _sql("vec_id % 41 - 20", "vec_id % 37 - 18", "(131072 + (4 + vec_id % 13) // 2) // (4 + vec_id % 13)", "(131072 + (5 + vec_id % 11) // 2) // (5 + vec_id % 11)", "vec_id % 2", "vec_id // 2 % 2"))
def scaled_mc(spark, d):
    """The same from references that are half to four times as large as the frame."""
    return _predicted(spark, d, ("vec_id % 41 - 20", "vec_id % 37 - 18"), ("4 + vec_id % 13", "5 + vec_id % 11"), ("vec_id % 2", "vec_id div 2 % 2"))


_ROUND = lambda v, s: f"CASE WHEN {v} < 0 THEN -((-({v}) + ((CAST(1 AS HUGEINT) << {s}) >> 1)) >> {s}) ELSE (({v}) + ((CAST(1 AS HUGEINT) << {s}) >> 1)) >> {s} END"
_INVERSE = lambda d: f"(length(bin(abs({d}))) - 1)"


def _divided(cte: str, source: str, d: str) -> str:
    """A table with n (place of d's highest bit) and q, the reciprocal of d's nine highest bits."""
    return (
        f"{cte}0 AS (SELECT *, CAST(length(bin(CAST(abs({d}) AS BIGINT))) - 1 AS INTEGER) AS n FROM {source}), {cte}1 AS (SELECT *, CAST(abs({d}) - (CAST(1 AS BIGINT) << n) AS BIGINT) AS e FROM {cte}0),"
        f" {cte}2 AS (SELECT *, CASE WHEN n > 8 THEN (e + (CAST(1 AS BIGINT) << (n - 9))) >> (n - 8) ELSE e << (8 - n) END AS j FROM {cte}1), {cte} AS (SELECT *, CAST(CASE WHEN {d} < 0 THEN -1 ELSE 1 END * ((4194304 + (256 + j) // 2) // (256 + j)) AS HUGEINT) AS q FROM {cte}2)"
    )


_MODEL = "SELECT p_partkey AS k, [CAST(p_partkey % 1000 - 500 AS BIGINT), p_size * 10, CASE WHEN p_partkey % 50 = 7 THEN -p_partkey ELSE 65536 + (p_partkey * 37) % 16000 - 8000 END, (p_partkey * 53) % 16000 - 8000, (CAST(p_size AS BIGINT) * 997 + p_partkey) % 16000 - 8000, 65536 + (CAST(p_size AS BIGINT) * 331) % 16000 - 8000] AS m FROM part"
_EVEN = lambda v: f"CASE WHEN {v} < 0 THEN -(((-({v}) + 32) >> 6) * 64) ELSE ((({v}) + 32) >> 6) * 64 END"


@query(
    "warp_shear",
    f"WITH p AS ({_MODEL}), {_divided('r', '(SELECT * FROM p WHERE m[3] > 0)', 'm[3]')},"
    f" s AS (SELECT k, greatest(-32768, least(32767, m[3] - 65536)) AS a, greatest(-32768, least(32767, m[4])) AS b, CAST(greatest(-32768, least(32767, {_ROUND('CAST(m[5] AS HUGEINT) * 65536 * q', '(n + 14)')})) AS BIGINT) AS c, CAST(greatest(-32768, least(32767, m[6] - ({_ROUND('CAST(m[4] AS HUGEINT) * m[5] * q', '(n + 14)')}) - 65536)) AS BIGINT) AS d FROM r),"
    f" e AS (SELECT k, CAST({_EVEN('a')} AS BIGINT) AS alpha, CAST({_EVEN('b')} AS BIGINT) AS beta, CAST({_EVEN('c')} AS BIGINT) AS gamma, CAST({_EVEN('d')} AS BIGINT) AS delta FROM s)"
    " SELECT k, alpha, beta, gamma, delta, 4 * abs(alpha) + 7 * abs(beta) < 65536 AND 4 * abs(gamma) + 4 * abs(delta) < 65536 AS valid FROM e UNION ALL SELECT k, NULL, NULL, NULL, NULL, false FROM p WHERE m[3] <= 0",
)
def warp_shear(spark, d):
    """Shear values of affine models, and whether they can be applied."""
    m = F.expr("array(bigint(p_partkey % 1000 - 500), bigint(p_size * 10), if(p_partkey % 50 = 7, -p_partkey, 65536 + (p_partkey * 37) % 16000 - 8000), (p_partkey * 53) % 16000 - 8000, (bigint(p_size) * 997 + p_partkey) % 16000 - 8000, 65536 + (bigint(p_size) * 331) % 16000 - 8000)")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), motion.shear(m).alias("v")).select("k", "v.*")


_SUMS = {"a00": "k % 9 * 300 + s * 40", "a01": "k % 7 * 90 - 250", "a11": "k % 11 * 250 + s * 35", "bx0": "k % 9 * 300 + s * 41 - 20", "bx1": "k % 7 * 90 - 260", "by0": "k % 7 * 95 - 255", "by1": "k % 11 * 250 + s * 34 + 17"}
_CLIP = lambda v, at: f"CAST(greatest({at} - 8191, least({at} + 8191, {v})) AS BIGINT)"
_SHIFTED = lambda v: _ROUND(f"(({v}) * q * (CAST(1 AS HUGEINT) << CAST(greatest(2 - n, 0) AS INTEGER)))", "CAST(greatest(n - 2, 0) AS INTEGER)")


@query(
    "warp_solve",
    "WITH p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s FROM part), u AS (SELECT k, s, " + ", ".join(f"CAST({e} AS HUGEINT) AS {c}" for c, e in _SUMS.items()) + " FROM p), v AS (SELECT *, a00 * a11 - a01 * a01 AS det FROM u),"
    f" {_divided('r', '(SELECT * FROM v WHERE det <> 0)', 'det')},"
    f" w AS (SELECT k, s, {_CLIP(_SHIFTED('a11 * bx0 - a01 * bx1'), 65536)} AS a, {_CLIP(_SHIFTED('a00 * bx1 - a01 * bx0'), 0)} AS b, {_CLIP(_SHIFTED('a11 * by0 - a01 * by1'), 0)} AS c, {_CLIP(_SHIFTED('a00 * by1 - a01 * by0'), 65536)} AS d FROM r)"
    " SELECT k, CAST(greatest(-8388608, least(8388607, (k % 64 - 32) * 8192 - (k % 500 * (a - 65536) + s * 8 * b))) AS BIGINT) AS x, CAST(greatest(-8388608, least(8388607, (s - 25) * 8192 - (k % 500 * c + s * 8 * (d - 65536)))) AS BIGINT) AS y, a, b, c, d FROM w"
    " UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL FROM v WHERE det = 0",
)
def warp_solve(spark, d):
    """Affine models from the sums of their samples, by an integer reciprocal."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"))
    sums = {c: F.expr(f"bigint({e})") for c, e in _SUMS.items()}
    m = motion.solve(sums, (F.expr("s * 8"), F.expr("k % 500")), (F.expr("s - 25"), F.expr("k % 64 - 32")))
    return parts.select("k", m.alias("m")).select("k", *[F.get("m", F.lit(i)).alias(c) for i, c in enumerate("xyabcd")])


_RAMP = lambda p, t: f"CASE WHEN {t} < 28 THEN 0 WHEN {t} > 35 THEN 64 ELSE CASE {p} WHEN 0 THEN [1,4,11,27,46,58,62,63] WHEN 1 THEN [1,2,6,18,37,53,60,63] ELSE [0,2,7,21,43,57,62,64] END[{t} - 27] END"
_M63 = lambda i, j: _RAMP(f"({i}) % 2", f"(greatest(0, least(63, ({j}) - 16 + (({i}) + 1) // 2)))")
_BOOK = "(VALUES (0,2,4,4),(1,3,4,4),(2,4,4,4),(3,5,4,4),(4,0,4,2),(5,0,4,6),(6,1,2,4),(7,1,6,4),(8,2,4,2),(9,2,4,6),(10,5,4,2),(11,5,4,6),(12,3,2,4),(13,3,6,4),(14,4,2,4),(15,4,6,4)) b(number, dir, bx, by_)"


@query(
    "wedge_blend",
    f"WITH {PX}, g AS (SELECT number, dir, y, x, 32 - by_ + y AS i, 32 - bx + x AS j FROM {_BOOK}, range(0, 8) r(y), range(0, 8) s(x)),"
    f" m AS (SELECT number, y, x, CAST(CASE dir WHEN 0 THEN {_RAMP('2', 'i')} WHEN 1 THEN {_RAMP('2', 'j')} WHEN 2 THEN {_M63('j', 'i')} WHEN 3 THEN {_M63('i', 'j')} WHEN 4 THEN 64 - {_M63('i', '63 - j')} ELSE 64 - {_M63('j', '63 - i')} END AS BIGINT) AS v FROM g),"
    " f AS (SELECT number, (sum(v) + 7) // 15 < 32 AS flip FROM m WHERE y = 0 OR x = 0 GROUP BY number)"
    " SELECT a.vec_id, a.y * 8 + a.x AS i, (a.v * w + b.v * (64 - w) + 32) >> 6 AS v FROM (SELECT px.*, CASE WHEN (px.vec_id // 16 % 2 = 1) = flip THEN m.v ELSE 64 - m.v END AS w FROM px JOIN m ON m.number = px.vec_id % 16 AND m.y = px.y AND m.x = px.x JOIN f ON f.number = px.vec_id % 16) a"
    " JOIN px b ON b.vec_id = a.vec_id AND b.y = 7 - a.y AND b.x = 7 - a.x",
)
def wedge_blend(spark, d):
    """Each block and its reverse, blended by one of the 32 wedges of its size."""
    got = masks.blend_wedges(blocks(spark, d), F.col("s"), F.reverse("s"), (F.lit(8), F.lit(8)), F.expr("vec_id div 16 % 2"), F.expr("vec_id % 16"), "r")
    return got.select("vec_id", F.posexplode("r").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), "v")
