"""Queries on block kernels and stencils, bound to the 8x8 sample blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataplane.functions.integers import let, lit64
from strataplane.operators import blocks as K
from strataplane.operators import filters as S
from strataplane.operators import transforms as T
from strataplane.plans.base import BLOCKS, PX, blocks, px, query, table

INT = "bigint"


def _rows(array, n: int):
    """(vec_id, i, v) of an array column ``r``."""
    return array.select("vec_id", F.posexplode("r").alias("i", "v")).select("vec_id", F.col("i").cast(INT).alias("i"), F.col("v").cast(INT).alias("v"))


def _each(spark, d, f):
    return _rows(blocks(spark, d).select("vec_id", f(F.col("s")).alias("r")), 64)


def _signed(s):
    """Samples as coefficients around 0."""
    return F.transform(s, lambda v: v - 128)


# ---- one-dimensional transforms over the first samples of each row

_Q = f"WITH {PX}, q AS (SELECT vec_id, y, " + ", ".join(f"max(CASE WHEN x = {i} THEN v - 128 END) AS c{i}" for i in range(8)) + " FROM px GROUP BY vec_id, y)"


def _rs(e: str, n: int) -> str:
    return f"(({e} + {1 << n - 1}) >> {n})"


#: the same by lines of four samples: half h of row y
_Q4 = f"WITH {PX}, q AS (SELECT vec_id, y, x // 4 AS h, " + ", ".join(f"max(CASE WHEN x % 4 = {i} THEN v - 128 END) AS c{i}" for i in range(4)) + " FROM px GROUP BY vec_id, y, x // 4)"


def _lines_sql(values: list[str]) -> str:
    out = ", ".join(f"CAST({v} AS BIGINT) AS v{i}" for i, v in enumerate(values))
    return f"{_Q} SELECT vec_id, y, {out} FROM q" if len(values) == 8 else f"{_Q4} SELECT vec_id, y, CAST(h AS BIGINT) AS h, {out} FROM q"


def _line_query(f, n: int):
    def run(spark, d):
        each = blocks(spark, d).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(64 // n - 1)), lambda y: F.slice(_signed(F.col("s")), y * n + 1, n))).alias("l", "a"))
        out = f([F.element_at("a", i + 1) for i in range(n)])
        place = [F.col("l").cast(INT).alias("y")] if n == 8 else [F.shiftright("l", 1).cast(INT).alias("y"), (F.col("l") % 2).cast(INT).alias("h")]
        return each.select("vec_id", *place, *[v.cast(INT).alias(f"v{i}") for i, v in enumerate(out)])

    return run


def _wht_sql() -> list[str]:
    t4 = "((c0 + c1 - (c2 - c3)) >> 1)"
    t3, t1 = f"({t4} - c3)", f"({t4} - c1)"
    return [f"c0 + c1 - {t3}", t3, t1, f"c2 - c3 + {t1}"]


def _dct4_sql(c=("c0", "c1", "c2", "c3")) -> list[str]:
    e, f = _rs(f"{c[0]} * 2896 + {c[2]} * 2896", 12), _rs(f"{c[0]} * 2896 - {c[2]} * 2896", 12)
    g, h = _rs(f"{c[1]} * 1567 - {c[3]} * 3784", 12), _rs(f"{c[1]} * 3784 + {c[3]} * 1567", 12)
    return [f"{e} + {h}", f"{f} + {g}", f"{f} - {g}", f"{e} - {h}"]


def _dct8_sql() -> list[str]:
    even = _dct4_sql(("c0", "c2", "c4", "c6"))
    a, z = _rs("c1 * 799 - c7 * 4017", 12), _rs("c1 * 4017 + c7 * 799", 12)
    b, c = _rs("c5 * 3406 - c3 * 2276", 12), _rs("c5 * 2276 + c3 * 3406", 12)
    s0, s1, s2, s3 = f"({a} + {b})", f"({a} - {b})", f"({z} - {c})", f"({z} + {c})"
    m, n = _rs(f"{s2} * 2896 - {s1} * 2896", 12), _rs(f"{s2} * 2896 + {s1} * 2896", 12)
    odd = [s3, n, m, s0]
    return [f"{x} + {y}" for x, y in zip(even, odd, strict=True)] + [f"{x} - {y}" for x, y in zip(even[::-1], odd[::-1], strict=True)]


def _adst4_sql() -> list[str]:
    s0, s1, s3 = "(c0 * 1321 + c2 * 3803 + c3 * 2482)", "(c0 * 2482 - c2 * 1321 - c3 * 3803)", "(c1 * 3344)"
    return [_rs(f"{s0} + {s3}", 12), _rs(f"{s1} + {s3}", 12), _rs("(c0 - c2 + c3) * 3344", 12), _rs(f"{s0} + {s1} - {s3}", 12)]


LINES = {
    "wht4": (K.wht4, 4, _wht_sql()),
    "dct4": (K.dct4, 4, _dct4_sql()),
    "dct8": (K.dct8, 8, _dct8_sql()),
    "adst4": (K.adst4, 4, _adst4_sql()),
    "flip_adst4": (K.flip(K.adst4), 4, _adst4_sql()[::-1]),
    "identity_tx4": (K.identity, 4, [f"c{i} + {_rs(f'c{i} * 1697', 12)}" for i in range(4)]),
    "identity_tx8": (K.identity, 8, [f"c{i} * 2" for i in range(8)]),
}
for _name, (_f, _n, _sql) in LINES.items():
    query(_name, _lines_sql(_sql))(_line_query(_f, _n))


def _two_pass(first: list[str], second: list[str], n: int, shift: int) -> str:
    """Rows, shift and clip, then columns and the last shift, over each n x n part of a block; i counts the samples of the 8 x 8 block."""
    row = ", ".join(f"greatest(-32768, least(32767, {_rs(v, shift) if shift else '(' + v + ')'})) AS r{i}" for i, v in enumerate(first[:n]))
    turned = ", ".join(f"max(CASE WHEN y % {n} = {y} THEN CASE x {' '.join(f'WHEN {x} THEN r{x}' for x in range(n))} END END) AS c{y}" for y in range(n))
    out = " UNION ALL ".join(f"SELECT vec_id, CAST((py * {n} + {y}) * 8 + part * {n} + x AS BIGINT) AS i, CAST({_rs(f'({second[y]})', 4)} AS BIGINT) AS v FROM t" for y in range(n))
    lines, half = (_Q, "0") if n == 8 else (_Q4, "h")
    return f"{lines}, p AS (SELECT vec_id, y, {half} AS part, {row} FROM q), t AS (SELECT vec_id, y // {n} AS py, part, x, {turned} FROM p, range(0, {n}) g(x) GROUP BY vec_id, y // {n}, part, x) {out}"


def _residuals(spark, d, n: int, rows, columns, shift: int):
    """Residuals of the n x n parts of each block, taken as coefficients around 0, at their places in the block."""
    m = 8 // n

    def kernel(x):
        parts = (x - 128).reshape(-1, m, n, m, n).transpose(0, 1, 3, 2, 4).reshape(-1, n * n)
        done = T.separable(parts, n, n, rows, columns, shift)
        return done.reshape(-1, m, m, n, n).transpose(0, 1, 3, 2, 4).reshape(-1, 64)

    return _rows(T.on_blocks(blocks(spark, d).withColumnRenamed("s", "r"), "r", 64, kernel), 64)


# ---- longer lines: stages as tables, each value from those of the stage before; r(..) is rounded by 12 bits

_DCT16 = """0=c0 1=c8 2=c4 3=c12 4=c2 5=c10 6=c6 7=c14 8=c1 9=c9 10=c5 11=c13 12=c3 13=c11 14=c7 15=c15
8=401*c8-4076*c15 9=3166*c9-2598*c14 10=1931*c10-3612*c13 11=3920*c11-1189*c12 12=1189*c11+3920*c12 13=3612*c10+1931*c13 14=2598*c9+3166*c14 15=4076*c8+401*c15
4=799*c4-4017*c7 5=3406*c5-2276*c6 6=2276*c5+3406*c6 7=4017*c4+799*c7 8=c8+c9 9=c8-c9 10=c11-c10 11=c10+c11 12=c12+c13 13=c12-c13 14=c15-c14 15=c14+c15
0=2896*c0+2896*c1 1=2896*c0-2896*c1 2=1567*c2-3784*c3 3=3784*c2+1567*c3 4=c4+c5 5=c4-c5 6=c7-c6 7=c6+c7 9=1567*c14-3784*c9 10=-1567*c10-3784*c13 13=1567*c13-3784*c10 14=1567*c9+3784*c14
0=c0+c3 1=c1+c2 2=c1-c2 3=c0-c3 5=2896*c6-2896*c5 6=2896*c5+2896*c6 8=c8+c11 9=c9+c10 10=c9-c10 11=c8-c11 12=c15-c12 13=c14-c13 14=c13+c14 15=c12+c15
0=c0+c7 1=c1+c6 2=c2+c5 3=c3+c4 4=c3-c4 5=c2-c5 6=c1-c6 7=c0-c7 10=2896*c13-2896*c10 11=2896*c12-2896*c11 12=2896*c11+2896*c12 13=2896*c10+2896*c13
0=c0+c15 1=c1+c14 2=c2+c13 3=c3+c12 4=c4+c11 5=c5+c10 6=c6+c9 7=c7+c8 8=c7-c8 9=c6-c9 10=c5-c10 11=c4-c11 12=c3-c12 13=c2-c13 14=c1-c14 15=c0-c15"""
_ADST8 = """0=c7 1=c0 2=c5 3=c2 4=c3 5=c4 6=c1 7=c6
0=4076*c0+401*c1 1=401*c0-4076*c1 2=3612*c2+1931*c3 3=1931*c2-3612*c3 4=2598*c4+3166*c5 5=3166*c4-2598*c5 6=1189*c6+3920*c7 7=3920*c6-1189*c7
0=c0+c4 1=c1+c5 2=c2+c6 3=c3+c7 4=c0-c4 5=c1-c5 6=c2-c6 7=c3-c7
4=3784*c4+1567*c5 5=1567*c4-3784*c5 6=3784*c7-1567*c6 7=3784*c6+1567*c7
0=c0+c2 1=c1+c3 2=c0-c2 3=c1-c3 4=c4+c6 5=c5+c7 6=c4-c6 7=c5-c7
2=2896*c2+2896*c3 3=2896*c2-2896*c3 6=2896*c6+2896*c7 7=2896*c6-2896*c7
1=0-c4 2=c6 3=0-c2 4=c3 5=0-c7 6=c5 7=0-c1"""


def _staged(stages: str, n: int) -> str:
    tables = []
    for i, line in enumerate(stages.splitlines()):
        own = dict(cell.split("=") for cell in line.split())
        cells = [f"{_rs('(' + own[str(j)] + ')', 12) if '*' in own.get(str(j), '') else own.get(str(j), f'c{j}')} AS c{j}" for j in range(n)]
        tables.append(f"s{i + 1} AS (SELECT vec_id, l, {', '.join(cells)} FROM s{i})")
    first = ", ".join(f"max(CASE WHEN (y * 8 + x) % {n} = {j} THEN v - 128 END) AS c{j}" for j in range(n))
    out = ", ".join(f"CAST(c{j} AS BIGINT) AS v{j}" for j in range(n))
    return f"WITH {PX}, s0 AS (SELECT vec_id, (y * 8 + x) // {n} AS l, {first} FROM px GROUP BY vec_id, (y * 8 + x) // {n}), {', '.join(tables)} SELECT vec_id, l, {out} FROM s{len(tables)}"


def _long_lines(spark, d, n: int, f):
    """A transform of each line of ``n`` samples, by rows of the block."""
    kernel = lambda x: np.stack(f([(x - 128).reshape(-1, n)[:, i] for i in range(n)]), axis=1).reshape(-1, 64)
    got = T.on_blocks(blocks(spark, d).withColumnRenamed("s", "r"), "r", 64, kernel)
    lines = got.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(64 // n - 1)), lambda i: F.slice("r", i * n + 1, n))).alias("l", "a"))
    return lines.select("vec_id", F.col("l").cast(INT).alias("l"), *[F.element_at("a", i + 1).alias(f"v{i}") for i in range(n)])


@query("dct16", _staged(_DCT16, 16))
def dct16(spark, d):
    return _long_lines(spark, d, 16, T.dct)


@query("adst8", _staged(_ADST8, 8))
def adst8(spark, d):
    return _long_lines(spark, d, 8, T.adst)


@query("separable_dct4x4", _two_pass(_dct4_sql(), _dct4_sql(), 4, 0))
def separable_dct4x4(spark, d):
    return _residuals(spark, d, 4, T.dct, T.dct, 0)


@query("separable_adst_dct4x4", _two_pass(_adst4_sql(), _dct4_sql(), 4, 0))
def separable_adst_dct4x4(spark, d):
    return _residuals(spark, d, 4, T.adst, T.dct, 0)


@query("separable_dct8x8", _two_pass(_dct8_sql(), _dct8_sql(), 8, 1))
def separable_dct8x8(spark, d):
    return _residuals(spark, d, 8, T.dct, T.dct, 1)


@query("dc_only", f"WITH {PX} SELECT vec_id, CAST(i AS BIGINT) AS i, CAST({_rs(_rs(_rs(_rs('(v - 128) * 2896', 12), 1) + ' * 2896', 12), 4)} AS BIGINT) AS v FROM px, range(0, 64) t(i) WHERE y = 0 AND x = 0")
def dc_only(spark, d):
    return _each(spark, d, lambda s: K.dc_only(F.element_at(s, 1) - 128, 8, 1))


@query("residual_add", f"WITH {PX} SELECT a.vec_id, a.y * 8 + a.x AS i, CAST(greatest(0, least(255, a.v + b.v - 128)) AS BIGINT) AS v FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.y = 7 - b.y AND a.x = 7 - b.x")
def residual_add(spark, d):
    return _each(spark, d, lambda s: K.add_residual(s, F.reverse(_signed(s))))


@query(
    "dequant",
    f"WITH {PX}, q AS (SELECT vec_id, y * 8 + x AS i, v - 128 AS v, ((CASE WHEN y + x = 0 THEN 40 ELSE 55 END) * (32 + (y * 8 + x) % 9) + 16) >> 5 AS q FROM px) SELECT vec_id, i, CAST(CASE WHEN v < 0 THEN -least((abs(v) * q & 16777215) >> 1, 32768) ELSE least((abs(v) * q & 16777215) >> 1, 32767) END AS BIGINT) AS v FROM q",
)
def dequant(spark, d):
    matrix = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 9 + 32).cast(INT))
    return _each(spark, d, lambda s: K.dequantise(_signed(s), 40, 55, matrix, 1))


# ---- prediction: row 0 is the top edge, column 0 the left one, sample (0, 0) the corner


def _edged(spark, d, f):
    """f(top, left, corner) of each block; the edges are computed once a row."""
    left = lambda s: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.element_at(s, y * 8 + 1))
    edges = lambda s: F.struct(F.slice(s, 1, 8).alias("top"), left(s).alias("left"), F.element_at(s, 1).alias("corner"))
    return _each(spark, d, lambda s: let(edges(s), lambda e: f(e["top"], e["left"], e["corner"])))


_E = f"WITH {PX}, e AS (SELECT p.vec_id, p.y * 8 + p.x AS i, p.y, p.x, t.v AS t, l.v AS l, c.v AS c, b.v AS b, r.v AS r FROM px p JOIN px t ON t.vec_id = p.vec_id AND t.y = 0 AND t.x = p.x JOIN px l ON l.vec_id = p.vec_id AND l.x = 0 AND l.y = p.y JOIN px c ON c.vec_id = p.vec_id AND c.y = 0 AND c.x = 0 JOIN px b ON b.vec_id = p.vec_id AND b.y = 7 AND b.x = 0 JOIN px r ON r.vec_id = p.vec_id AND r.y = 0 AND r.x = 7)"
_SUMS = f"WITH {PX}, e AS (SELECT vec_id, sum(CASE WHEN y = 0 THEN v END) AS ts, sum(CASE WHEN x = 0 THEN v END) AS ls FROM px GROUP BY vec_id)"
for _side, _dc in {"both": "(ts + ls + 8) // 16", "top": "(ts + 4) // 8", "left": "(ls + 4) // 8", "none": "128"}.items():
    query(f"intra_dc_{_side}", f"{_SUMS} SELECT vec_id, CAST(i AS BIGINT) AS i, CAST({_dc} AS BIGINT) AS v FROM e, range(0, 64) t(i)")((lambda side: lambda spark, d: _edged(spark, d, lambda top, left, corner: K.predict_dc(top, left, 8, side)))(_side))


@query("intra_v", f"{_E} SELECT vec_id, i, t AS v FROM e")
def intra_v(spark, d):
    return _edged(spark, d, lambda top, left, corner: K.predict_v(top, 8))


@query("intra_h", f"{_E} SELECT vec_id, i, l AS v FROM e")
def intra_h(spark, d):
    return _edged(spark, d, lambda top, left, corner: K.predict_h(left, 8))


@query("intra_paeth", f"{_E} SELECT vec_id, i, CASE WHEN abs(t - c) <= abs(l - c) AND abs(t - c) <= abs(l + t - 2 * c) THEN l WHEN abs(l - c) <= abs(l + t - 2 * c) THEN t ELSE c END AS v FROM e")
def intra_paeth(spark, d):
    return _edged(spark, d, lambda top, left, corner: K.predict_paeth(top, left, corner, 8))


_W = "[255, 197, 146, 105, 73, 50, 37, 32]"
_DOWN, _ACROSS = f"({_W}[y + 1] * t + (256 - {_W}[y + 1]) * b)", f"({_W}[x + 1] * l + (256 - {_W}[x + 1]) * r)"
for _kind, _sql in {"both": _rs(f"{_DOWN} + {_ACROSS}", 9), "v": _rs(_DOWN, 8), "h": _rs(_ACROSS, 8)}.items():
    query(f"intra_smooth_{_kind}", f"{_E} SELECT vec_id, i, CAST({_sql} AS BIGINT) AS v FROM e")((lambda kind: lambda spark, d: _edged(spark, d, lambda top, left, corner: K.predict_smooth(top, left, 8, kind)))(_kind))


@query(
    "intra_directional",
    f"WITH {PX}, e AS (SELECT vec_id, list(v ORDER BY y, x) AS g FROM px WHERE y < 2 GROUP BY vec_id), p AS (SELECT vec_id, i, g, ((i // 8 + 1) * 23 >> 6) + i % 8 AS b, (((i // 8 + 1) * 23) & 63) >> 1 AS f FROM e, range(0, 64) t(i)) SELECT vec_id, CAST(i AS BIGINT) AS i, CAST((g[least(b, 15) + 1] * (32 - f) + g[least(b + 1, 15) + 1] * f + 16) >> 5 AS BIGINT) AS v FROM p",
)
def intra_directional(spark, d):
    return _each(spark, d, lambda s: let(F.slice(s, 1, 16), lambda edge: K.predict_directional(edge, 8, 23)))


@query(
    "cfl",
    f"WITH {PX}, s AS (SELECT vec_id, y // 2 AS cy, x // 2 AS cx, 2 * sum(v) AS l FROM px GROUP BY ALL), m AS (SELECT vec_id, (sum(l) + 8) >> 4 AS m FROM s GROUP BY vec_id), c AS (SELECT vec_id, v AS dc, v % 17 - 8 AS a FROM px WHERE y = 0 AND x = 0) SELECT s.vec_id, CAST(cy * 4 + cx AS BIGINT) AS i, CAST(greatest(0, least(255, dc + (CASE WHEN a * (l - m) < 0 THEN -1 ELSE 1 END) * ((abs(a * (l - m)) + 32) >> 6))) AS BIGINT) AS v FROM s JOIN m USING (vec_id) JOIN c USING (vec_id)",
)
def cfl(spark, d):
    return _each(spark, d, lambda s: let(s, lambda b: K.chroma_from_luma(b, F.element_at(b, 1), F.element_at(b, 1) % 17 - 8, 8)))


@query("palette_lookup", f"WITH {PX} SELECT a.vec_id, a.y * 8 + a.x AS i, p.v FROM px a JOIN px p ON p.vec_id = a.vec_id AND p.y = 0 AND p.x = a.v % 8")
def palette_lookup(spark, d):
    return _each(spark, d, lambda s: let(F.slice(s, 1, 8), lambda p: K.palette_lookup(p, F.transform(s, lambda v: v % 8))))


@query("palette_merge", f"WITH {PX}, u AS (SELECT DISTINCT vec_id, v FROM px WHERE y IN (0, 3)) SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY v) - 1 AS i, v FROM u")
def palette_merge(spark, d):
    return _each(spark, d, lambda s: K.palette_merge(F.slice(s, 1, 8), F.slice(s, 25, 8)))


_PAIR = f"WITH {PX}, p AS (SELECT a.vec_id, a.y * 8 + a.x AS i, a.v AS a, b.v AS b FROM px a JOIN px b ON b.vec_id = a.vec_id AND b.y = a.x AND b.x = a.y)"


def _turned(s):
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.element_at(s, i % 8 * 8 + F.floor(i / 8).cast("int") + 1))


@query("interintra_blend", f"{_PAIR} SELECT vec_id, i, CAST(((i % 65) * a + (64 - i % 65) * b + 32) >> 6 AS BIGINT) AS v FROM p")
def interintra_blend(spark, d):
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 65).cast(INT))
    return _each(spark, d, lambda s: K.blend(s, _turned(s), mask))


@query("compound_average", f"{_PAIR} SELECT vec_id, i, CAST((a + b + 1) >> 1 AS BIGINT) AS v FROM p")
def compound_average(spark, d):
    return _each(spark, d, lambda s: K.average(s, _turned(s)))


@query("compound_distance", f"{_PAIR} SELECT vec_id, i, CAST((a * 9 + b * 7 + 8) >> 4 AS BIGINT) AS v FROM p")
def compound_distance(spark, d):
    return _each(spark, d, lambda s: K.distance_weighted(s, _turned(s), 9, 7))


_AT = "list_extract(s, CAST(greatest(0, least(7, {y})) * 8 + greatest(0, least(7, {x})) + 1 AS INTEGER))"


def _mc_sql(dy: int, dx: int) -> str:
    iy, fy, ix, fx = dy >> 3, dy & 7, dx >> 3, dx & 7
    p = lambda a, b: _AT.format(y=f"i // 8 + {iy + a}", x=f"i % 8 + {ix + b}")
    return f"WITH {BLOCKS} SELECT vec_id, CAST(i AS BIGINT) AS i, CAST((({p(0, 0)} * {8 - fx} + {p(0, 1)} * {fx}) * {8 - fy} + ({p(1, 0)} * {8 - fx} + {p(1, 1)} * {fx}) * {fy} + 32) >> 6 AS BIGINT) AS v FROM blk, range(0, 64) t(i)"


@query("bilinear_mc", _mc_sql(11, -13))
def bilinear_mc(spark, d):
    return _each(spark, d, lambda s: let(s, lambda b: K.motion_bilinear(b, 8, 11, -13)))


@query("intra_block_copy", _mc_sql(-16, 8))
def intra_block_copy(spark, d):
    return _each(spark, d, lambda s: let(s, lambda b: K.motion_bilinear(b, 8, -16, 8)))


@query("warp_lsq_sums", f"WITH {PX} SELECT vec_id, CAST(sum(x * x // 4 + 2 * x + 8) AS BIGINT) AS a00, CAST(sum(x * y // 4 + x + y + 4) AS BIGINT) AS a01, CAST(sum(y * y // 4 + 2 * y + 8) AS BIGINT) AS a11, CAST(sum(x * v // 4 + x + v + 4) AS BIGINT) AS b0 FROM px WHERE abs(x * 8 - v) < 256 GROUP BY vec_id")
def warp_lsq_sums(spark, d):
    add = lambda e: F.sum(F.expr(e)).cast(INT)
    return px(spark, d).where("abs(x * 8 - v) < 256").groupBy("vec_id").agg(add("x * x div 4 + 2 * x + 8").alias("a00"), add("x * y div 4 + x + y + 4").alias("a01"), add("y * y div 4 + 2 * y + 8").alias("a11"), add("x * v div 4 + x + v + 4").alias("b0"))


# ---- stencils

_LINE = {0: "y + x", 1: "y // 2 + x", 2: "x", 3: "x - y // 2", 4: "x - y", 5: "y - x // 2", 6: "y", 7: "y + x // 2"}
_ORDER = (0, 7, 6, 5, 4, 3, 2, 1)
_CDEF = f"WITH {PX}, l AS (" + " UNION ALL ".join(f"SELECT vec_id, {k} AS d, {_LINE[m]} AS line, sum(v - 128) AS s, count(*) AS n FROM px GROUP BY ALL" for k, m in enumerate(_ORDER)) + "), c AS (SELECT vec_id, d, CAST(sum(s * s * (840 // n)) AS BIGINT) AS cost FROM l GROUP BY ALL), b AS (SELECT vec_id, d, cost FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cost DESC, d) = 1)"


@query("cdef_direction", f"{_CDEF} SELECT b.vec_id, CAST(b.d AS BIGINT) AS direction, CAST((b.cost - o.cost) >> 10 AS BIGINT) AS variance FROM b JOIN c o ON o.vec_id = b.vec_id AND o.d = xor(b.d, 4)")
def cdef_direction(spark, d):
    way, var = S.cdef_direction(F.col("s"))
    return blocks(spark, d).select("vec_id", way.alias("direction"), var.alias("variance"))


@query("cdef_strength", f"{_CDEF}, v AS (SELECT b.vec_id, CAST((b.cost - o.cost) >> 10 AS BIGINT) AS var FROM b JOIN c o ON o.vec_id = b.vec_id AND o.d = xor(b.d, 4)) SELECT vec_id, CAST(CASE WHEN var = 0 THEN 0 ELSE (9 * (4 + least(CASE WHEN var < 64 THEN 0 ELSE length(bin(var >> 6)) - 1 END, 12)) + 8) >> 4 END AS BIGINT) AS strength FROM v")
def cdef_strength(spark, d):
    return blocks(spark, d).select("vec_id", S.cdef_direction(F.col("s"))[1].alias("var")).select("vec_id", S.cdef_strength(9, F.col("var")).cast(INT).alias("strength"))


_TAP = "CASE WHEN {d} < 0 THEN -1 ELSE 1 END * least(abs({d}), greatest(0, 20 - (abs({d}) >> 3)))"


def _cdef_row_sql() -> str:
    parts = [f"({_TAP.format(d=f'(coalesce({f}(v, {k}) OVER w, v) - v)')}) * {m}" for k, m in ((1, 4), (2, 2)) for f in ("lag", "lead")]
    return f"WITH {PX}, t AS (SELECT vec_id, y, x, v, {' + '.join(parts)} AS s FROM px WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)) SELECT vec_id, y, x, CAST(v + ((s - (CASE WHEN s < 0 THEN 1 ELSE 0 END) + 8) >> 4) AS BIGINT) AS v FROM t"


@query("cdef_primary_rows", _cdef_row_sql())
def cdef_primary_rows(spark, d):
    return S.constrain_rows(px(spark, d), ["vec_id"], 20, 3)


@query("box_sum3", f"WITH {PX}, r AS (SELECT vec_id, y, x, v, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM px WINDOW w AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT vec_id, y, x, v, CAST(sum(s) OVER w AS BIGINT) AS s, CAST(sum(q) OVER w AS BIGINT) AS q FROM r WINDOW w AS (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def box_sum3(spark, d):
    return S.box_sum(px(spark, d), ["vec_id"], 1)


@query(
    "self_guided_sums",
    f"WITH {PX}, r AS (SELECT vec_id, y, x, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM px WINDOW w AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), b AS (SELECT vec_id, y, x, sum(s) OVER w AS s, sum(q) OVER w AS q FROM r WINDOW w AS (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), z AS (SELECT vec_id, y, x, CAST(s AS BIGINT) AS s, CAST(least(255, (CAST(greatest(q * 9 - s * s, 0) * 140 + 524288 AS BIGINT)) >> 20) AS BIGINT) AS z FROM b), g AS (SELECT *, CASE WHEN z >= 255 THEN 256 WHEN z = 0 THEN 1 ELSE (z * 256 + z // 2) // (z + 1) END AS b FROM z) SELECT vec_id, y, x, CAST(((256 - b) * s * 455 + 2048) >> 12 AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM g",
)
def self_guided_sums(spark, d):
    boxed = S.box_sum(px(spark, d), ["vec_id"], 1)
    a, b = S.self_guided(F.col("s"), F.col("q"), 9, 140)
    return boxed.select("vec_id", "y", "x", a.cast(INT).alias("a"), b.cast(INT).alias("b"))


_HT, _VT = (3, -9, 21, 98, 21, -9, 3), (5, -23, 46, 72, 46, -23, 5)


def _wiener_sql() -> str:
    def taps(t, line, along):
        parts = [f"{w} * coalesce({'lag' if k < 3 else 'lead'}(v, {abs(k - 3)}) OVER (PARTITION BY vec_id, {line} ORDER BY {along}), {'first' if k < 3 else 'last'}_value(v) OVER (PARTITION BY vec_id, {line} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" if k != 3 else f"{w} * v" for k, w in enumerate(t)]
        return " + ".join(parts)

    return f"WITH {PX}, h AS (SELECT vec_id, y, x, greatest(0, least(8191, ({taps(_HT, 'y', 'x')} + 16384 + 4) >> 3)) AS v FROM px) SELECT vec_id, y, x, CAST(greatest(0, least(255, ({taps(_VT, 'x', 'y')} - 262144 + 1024) >> 11)) AS BIGINT) AS v FROM h"


@query("wiener7", _wiener_sql())
def wiener7(spark, d):
    return S.wiener(px(spark, d), ["vec_id"], _HT, _VT).withColumn("v", F.col("v").cast(INT))


def _deblock_sql() -> str:
    c4 = lambda e: f"greatest(-128, least(127, {e}))"
    return f"""WITH {PX}, q AS (SELECT vec_id, y, max(CASE WHEN x = 2 THEN v END) - 128 AS a, max(CASE WHEN x = 3 THEN v END) - 128 AS b, max(CASE WHEN x = 4 THEN v END) - 128 AS c, max(CASE WHEN x = 5 THEN v END) - 128 AS e FROM px GROUP BY vec_id, y),
m AS (SELECT *, abs(a - b) <= 40 AND abs(e - c) <= 40 AND abs(b - c) * 2 + abs(a - e) // 2 <= 120 AS mask, abs(a - b) > 12 OR abs(e - c) > 12 AS hev FROM q),
f AS (SELECT *, {c4(f"CASE WHEN hev THEN {c4('a - e')} ELSE 0 END + 3 * (c - b)")} AS f FROM m),
g AS (SELECT *, {c4('f + 4')} >> 3 AS f1, {c4('f + 3')} >> 3 AS f2 FROM f), o AS (SELECT *, CASE WHEN hev THEN 0 ELSE (f1 + 1) >> 1 END AS u FROM g)
SELECT vec_id, y, CAST(128 + CASE WHEN mask THEN {c4('a + u')} ELSE a END AS BIGINT) AS p1, CAST(128 + CASE WHEN mask THEN {c4('b + f2')} ELSE b END AS BIGINT) AS p0, CAST(128 + CASE WHEN mask THEN {c4('c - f1')} ELSE c END AS BIGINT) AS q0, CAST(128 + CASE WHEN mask THEN {c4('e - u')} ELSE e END AS BIGINT) AS q1 FROM o"""


@query("deblock_narrow", _deblock_sql())
def deblock_narrow(spark, d):
    """The vertical edge in the middle of each block, rows side by side in the block's array."""
    each = blocks(spark, d).select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.struct(y.alias("y"), F.slice("s", y * 8 + 3, 4).alias("e")))).alias("r"))
    out = S.deblock_narrow(*[F.element_at("r.e", k) for k in (1, 2, 3, 4)], 40, 120, 12)
    return each.select("vec_id", F.col("r.y").cast(INT).alias("y"), *[v.cast(INT).alias(n) for n, v in zip(("p1", "p0", "q0", "q1"), out, strict=True)])


POINTS = [(16, 20), (80, 60), (160, 44), (235, 96)]


@query("grain_scaling", f"WITH {PX} SELECT vec_id, y, x, CAST(CASE WHEN v < 16 THEN 20 WHEN v < 80 THEN 20 + (((v - 16) * 40 * 1024 + 32768) >> 16) WHEN v < 160 THEN 60 + (((v - 80) * -16 * 819 + 32768) >> 16) WHEN v < 235 THEN 44 + (((v - 160) * 52 * 874 + 32768) >> 16) ELSE 96 END AS BIGINT) AS scale FROM px")
def grain_scaling(spark, d):
    return px(spark, d).select("vec_id", "y", "x", S.grain_scale(F.col("v"), POINTS).cast(INT).alias("scale"))


@query("grain_apply", f"WITH {PX} SELECT vec_id, y, x, CAST(greatest(16, least(235, v + (((CASE WHEN v < 128 THEN 40 ELSE 24 END) * ((x * 5 + y * 3) % 17 - 8) + 64) >> 7))) AS BIGINT) AS v FROM px")
def grain_apply(spark, d):
    scale, grain = F.when(F.col("v") < 128, lit64(40)).otherwise(lit64(24)), (F.col("x") * 5 + F.col("y") * 3) % 17 - 8
    return px(spark, d).withColumn("v", S.add_grain(F.col("v"), grain, scale, 7, 16, 235).cast(INT))


@query(
    "noise_register",
    "WITH RECURSIVE r AS (SELECT p_partkey, 0 AS i, CAST((p_partkey * 977 + 1) % 65536 AS BIGINT) AS v FROM part UNION ALL SELECT p_partkey, i + 1, (v >> 1) | ((xor(xor(v, v >> 1), xor(v >> 3, v >> 12)) & 1) << 15) FROM r WHERE i < 8) SELECT p_partkey, CAST(i - 1 AS BIGINT) AS i, v, CAST(v >> 5 AS BIGINT) AS top FROM r WHERE i > 0",
)
def noise_register(spark, d):
    states = S.noise_register((F.col("p_partkey") * 977 + 1) % 65536, 8)
    each = table(spark, d, "part").select("p_partkey", F.posexplode(states).alias("i", "v"))
    return each.select("p_partkey", F.col("i").cast(INT).alias("i"), "v", F.shiftright("v", 5).alias("top"))


# ---- motion vectors and segments


@query(
    "mv_candidates_topk",
    "WITH c AS (SELECT l_orderkey, l_partkey % 16 AS mv, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) SELECT l_orderkey, mv, weight FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, first, mv) <= 2",
)
def mv_candidates_topk(spark, d):
    """Equal vectors add their weights; the two heaviest of each group, the earlier on ties."""
    each = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 16).alias("mv")).agg(F.sum(F.col("l_quantity").cast(INT)).alias("weight"), F.min("l_linenumber").alias("first"))
    w = W.partitionBy("l_orderkey").orderBy(F.desc("weight"), "first", "mv")
    return each.withColumn("r", F.row_number().over(w)).where("r <= 2").select("l_orderkey", "mv", "weight")


@query("neg_deinterleave", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN r = 0 THEN d WHEN 2 * r < 8 THEN CASE WHEN d <= 2 * r THEN CASE WHEN d % 2 = 1 THEN r + (d + 1) // 2 ELSE r - (d + 1) // 2 END ELSE d END WHEN d <= 2 * (8 - r - 1) THEN CASE WHEN d % 2 = 1 THEN r + (d + 1) // 2 ELSE r - (d + 1) // 2 END ELSE 8 - (d + 1) END AS BIGINT) AS id FROM (SELECT l_orderkey, l_linenumber, l_partkey % 8 AS r, l_suppkey % 8 AS d FROM lineitem)")
def neg_deinterleave(spark, d):
    """A segment id from its coded difference to a reference id, of eight ids."""
    ref, diff = F.col("r"), F.col("d")
    near = F.when(diff % 2 == 1, ref + F.expr("(d + 1) div 2")).otherwise(ref - F.expr("(d + 1) div 2"))
    out = F.when(ref == 0, diff).when(ref * 2 < 8, F.when(diff <= ref * 2, near).otherwise(diff)).when(diff <= (F.lit(7) - ref) * 2, near).otherwise(F.lit(7) - diff)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 8).alias("r"), (F.col("l_suppkey") % 8).alias("d"))
    return rows.select("l_orderkey", "l_linenumber", out.cast(INT).alias("id"))


@query("segment_min", f"WITH {PX} SELECT vec_id, y // 4 AS by, x // 4 AS bx, min(v % 8) AS segment FROM px GROUP BY ALL")
def segment_min(spark, d):
    return px(spark, d).groupBy("vec_id", F.expr("y div 4").alias("by"), F.expr("x div 4").alias("bx")).agg(F.min(F.col("v") % 8).alias("segment"))


@query("cdf_adapt", f"WITH {PX} SELECT vec_id, y, x, CAST(CASE WHEN x < v % 8 THEN c + ((32768 - c) >> 5) ELSE c - (c >> 5) END AS BIGINT) AS cdf FROM (SELECT *, (x + 1) * 4096 AS c FROM px)")
def cdf_adapt(spark, d):
    """One adaptation step of an eight-symbol table at count 0: up before the symbol, down from it on."""
    c = (F.col("x") + 1) * 4096
    return px(spark, d).select("vec_id", "y", "x", F.when(F.col("x") < F.col("v") % 8, c + F.shiftright(lit64(32768) - c, 5)).otherwise(c - F.shiftright(c, 5)).alias("cdf"))


@query("scan_order", "SELECT CAST(i AS BIGINT) AS i, CAST(row_number() OVER (ORDER BY i // 8 + i % 8, i % 8) - 1 AS BIGINT) AS place FROM range(0, 64) t(i)")
def scan_order(spark, d):
    """Up-right diagonal scan of an 8x8 block; 64 rows at any scale."""
    i = spark.range(64).select(F.col("id").alias("i"))
    w = W.orderBy(F.expr("i div 8 + i % 8"), F.col("i") % 8)
    return i.withColumn("place", (F.row_number().over(w) - 1).cast(INT))


