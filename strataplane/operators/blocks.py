"""Block kernels as array columns: transforms, dequantisation, prediction.

A block is an array of bigint, row-major.  Each kernel is a composition of
element expressions, so a block is transformed inside its row: no shuffle, no
Python.
"""

from __future__ import annotations

from math import cos, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataplane.functions.integers import clip, div, let, lit64, round_shift, total


def at(block: Column, i: int) -> Column:
    return F.element_at(block, i + 1)


# ---- one-dimensional transforms on lists of columns


def wht4(v: list[Column]) -> list[Column]:
    """Inverse Walsh-Hadamard of four values; exact."""
    a, b, c, d = v
    t0, t2 = a + b, c - d
    t4 = F.shiftright(t0 - t2, 1)
    t3, t1 = t4 - d, t4 - b
    return [t0 - t3, t3, t1, t2 + t1]


def cos12(k: int, n: int = 128) -> int:
    """round(cos(k pi / n) * 4096)."""
    return int(cos(k * pi / n) * 4096 + (0.5 if cos(k * pi / n) >= 0 else -0.5))


def _turn(x0: Column, w0: int, x1: Column, w1: int) -> Column:
    return round_shift(x0 * w0 + x1 * w1, 12)


def dct4(v: list[Column]) -> list[Column]:
    """Inverse DCT of four coefficients, 12-bit cosines."""
    e, f = _turn(v[0], cos12(32), v[2], cos12(32)), _turn(v[0], cos12(32), v[2], -cos12(32))
    g, h = _turn(v[1], cos12(48), v[3], -cos12(16)), _turn(v[1], cos12(16), v[3], cos12(48))
    return [e + h, f + g, f - g, e - h]


def dct8(v: list[Column]) -> list[Column]:
    """Inverse DCT of eight coefficients: the even half is dct4, the odd half three butterfly stages."""
    even = dct4(v[0::2])
    a, d = _turn(v[1], cos12(56), v[7], -cos12(8)), _turn(v[1], cos12(8), v[7], cos12(56))
    b, c = _turn(v[5], cos12(24), v[3], -cos12(40)), _turn(v[5], cos12(40), v[3], cos12(24))
    s0, s1, s2, s3 = a + b, a - b, d - c, d + c
    m, n = _turn(s2, cos12(32), s1, -cos12(32)), _turn(s2, cos12(32), s1, cos12(32))
    odd = [s3, n, m, s0]
    return [x + y for x, y in zip(even, odd, strict=True)] + [x - y for x, y in zip(reversed(even), reversed(odd), strict=True)]


def adst4(v: list[Column]) -> list[Column]:
    """Inverse asymmetric sine transform of four coefficients."""
    k1, k2, k3, k4 = 1321, 2482, 3344, 3803  # fixed values of the format
    s0, s1 = v[0] * k1 + v[2] * k4 + v[3] * k2, v[0] * k2 - v[2] * k1 - v[3] * k4
    s3, s2 = v[1] * k3, (v[0] - v[2] + v[3]) * k3
    return [round_shift(x, 12) for x in (s0 + s3, s1 + s3, s2, s0 + s1 - s3)]


def identity(v: list[Column]) -> list[Column]:
    """Scaling for lengths 4, 8, 16 and 32."""
    n = len(v)
    if n == 4:
        return [x + round_shift(x * 1697, 12) for x in v]
    if n == 8:
        return [x * 2 for x in v]
    return [x * 2 + round_shift(x * 1697, 11) for x in v] if n == 16 else [x * 4 for x in v]


TRANSFORMS = {"dct4": dct4, "dct8": dct8, "adst4": adst4, "identity": identity, "wht4": wht4}


def flip(f):
    """A one-dimensional transform with its output reversed."""
    return lambda v: f(v)[::-1]


def dc_only(dc: Column, n: int, row_shift: int) -> Column:
    """The residual of a block whose only coefficient is the first."""
    once = round_shift(_turn(dc, cos12(32), lit64(0), 0), row_shift)
    return F.array_repeat(round_shift(_turn(once, cos12(32), lit64(0), 0), 4), n * n)


def add_residual(prediction: Column, residual: Column, depth: int = 8) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: clip(p + r, 0, (1 << depth) - 1))


def dequantise(levels: Column, q_dc: int, q_ac: int, matrix: Column | None, shift: int, depth: int = 8) -> Column:
    """Levels to coefficients: weighted quantiser, 24-bit product, size shift, cap, sign last."""
    cap = 1 << 7 + depth

    def one(v: Column, i: Column) -> Column:
        q = F.when(i == 0, lit64(q_dc)).otherwise(lit64(q_ac))
        if matrix is not None:
            q = F.shiftright(q * F.element_at(matrix, i + 1) + 16, 5)
        size = F.shiftright((F.abs(v) * q).bitwiseAND(0xFFFFFF), shift)
        return F.when(v < 0, -F.least(size, lit64(cap))).otherwise(F.least(size, lit64(cap - 1)))

    return F.transform(levels, one)


# ---- prediction from edges: top and left are arrays of n samples, corner a sample


def predict_dc(top: Column, left: Column, n: int, sides: str = "both", depth: int = 8) -> Column:
    zero = lit64(0)
    add = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    if sides == "none":
        value = lit64(1 << depth - 1)
    elif sides == "both":
        value = div(add(top) + add(left) + n, lit64(2 * n))
    else:
        value = div(add(top if sides == "top" else left) + n // 2, lit64(n))
    return F.array_repeat(value, n * n)


def _each(n: int, f) -> Column:
    """f(y, x) over an n x n block, y and x zero-based int columns."""
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: f(F.shiftright(i, n.bit_length() - 1), i % n))


def predict_v(top: Column, n: int) -> Column:
    return _each(n, lambda y, x: F.element_at(top, x + 1))


def predict_h(left: Column, n: int) -> Column:
    return _each(n, lambda y, x: F.element_at(left, y + 1))


def predict_paeth(top: Column, left: Column, corner: Column, n: int) -> Column:
    """The nearest of left, top and corner to left + top - corner, in this order on ties."""

    def one(y: Column, x: Column) -> Column:
        t, a = F.element_at(top, x + 1), F.element_at(left, y + 1)
        da, dt, dc = F.abs(t - corner), F.abs(a - corner), F.abs(a + t - corner * 2)
        return F.when((da <= dt) & (da <= dc), a).when(dt <= dc, t).otherwise(corner)

    return _each(n, one)


# Weights of smooth prediction over eight samples.
SMOOTH8 = (255, 197, 146, 105, 73, 50, 37, 32)


def predict_smooth(top: Column, left: Column, n: int, kind: str = "both") -> Column:
    w = F.array(*[lit64(v) for v in SMOOTH8])
    below, right = at(left, n - 1), at(top, n - 1)

    def one(y: Column, x: Column) -> Column:
        wy, wx = F.element_at(w, y + 1), F.element_at(w, x + 1)
        down = wy * F.element_at(top, x + 1) + (lit64(256) - wy) * below
        across = wx * F.element_at(left, y + 1) + (lit64(256) - wx) * right
        return round_shift(down + across, 9) if kind == "both" else round_shift(down if kind == "v" else across, 8)

    return _each(n, one)


def predict_directional(edge: Column, n: int, step: int) -> Column:
    """Along one edge of 2n samples at ``step`` / 64 samples a line, interpolated; past the end the last sample repeats."""
    last = 2 * n - 1

    def one(y: Column, x: Column) -> Column:
        place = (y + 1) * step
        base, part = F.shiftright(place, 6) + x, F.shiftright(place.bitwiseAND(63), 1)
        a = F.element_at(edge, F.least(base, F.lit(last)) + 1)
        b = F.element_at(edge, F.least(base + 1, F.lit(last)) + 1)
        return round_shift(a * (F.lit(32) - part) + b * part, 5)

    return _each(n, one)


def chroma_from_luma(luma: Column, dc: Column, alpha: Column, n: int, depth: int = 8) -> Column:
    """4:2:0 chroma of n/2 x n/2: the luma's zero-mean part times alpha / 8, on dc."""
    half = n // 2
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(half * half - 1)),
        lambda i: total([F.element_at(luma, (F.shiftright(i, half.bit_length() - 1) * 2 + dy) * n + (i % half) * 2 + dx + 1) for dy in (0, 1) for dx in (0, 1)]) * 2,
    )

    def scaled(s: Column) -> Column:
        mean = round_shift(F.aggregate(s, lit64(0), lambda a, x: a + x), 2 * half.bit_length() - 2)

        def one(v: Column) -> Column:
            product = alpha * (v - mean)
            part = round_shift(F.abs(product), 6)
            return clip(dc + F.when(product < 0, -part).otherwise(part), 0, (1 << depth) - 1)

        return F.transform(s, one)

    return let(sums, scaled)


def palette_lookup(palette: Column, index: Column) -> Column:
    return F.transform(index, lambda i: F.element_at(palette, (i + 1).cast("int")))


def palette_merge(cache: Column, new: Column) -> Column:
    """Sorted distinct colours of both."""
    return F.array_sort(F.array_union(cache, new))


def blend(a: Column, b: Column, mask: Column) -> Column:
    """(m a + (64 - m) b + 32) >> 6."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.zip_with(pairs, mask, lambda p, m: round_shift(m * p["x"] + (lit64(64) - m) * p["y"], 6))


def average(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: round_shift(x + y, 1))


def distance_weighted(a: Column, b: Column, wa: int, wb: int) -> Column:
    """Two predictions by weights that sum to 16."""
    return F.zip_with(a, b, lambda x, y: round_shift(x * wa + y * wb, 4))


def motion_bilinear(ref: Column, n: int, dy: int, dx: int) -> Column:
    """A block moved by (dy, dx) in 1/8 samples, bilinear, samples beyond the edges repeat."""
    iy, fy, ix, fx = dy >> 3, dy & 7, dx >> 3, dx & 7

    def sample(y: Column, x: Column) -> Column:
        return F.element_at(ref, F.greatest(F.least(y, F.lit(n - 1)), F.lit(0)) * n + F.greatest(F.least(x, F.lit(n - 1)), F.lit(0)) + 1)

    def one(y: Column, x: Column) -> Column:
        up = sample(y + iy, x + ix) * (8 - fx) + sample(y + iy, x + ix + 1) * fx
        down = sample(y + iy + 1, x + ix) * (8 - fx) + sample(y + iy + 1, x + ix + 1) * fx
        return round_shift(up * (8 - fy) + down * fy, 6)

    return _each(n, one)
