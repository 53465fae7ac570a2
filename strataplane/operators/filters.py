"""Stencil filters over sample rows and blocks: windows by row and by column, aggregates by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataplane.functions.integers import clip, div, lit64, round_shift, total


def across(keys: list[str], line: str = "y", along: str = "x") -> W:
    return W.partitionBy(*keys, line).orderBy(along)


def box_sum(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Adds s and q: sums of v and v*v over the (2 radius + 1)-square, clipped at the edges."""
    wx = across(keys).rowsBetween(-radius, radius)
    wy = across(keys, "x", "y").rowsBetween(-radius, radius)
    once = rows.withColumns({"s": F.sum("v").over(wx), "q": F.sum(F.col("v") * F.col("v")).over(wx)})
    return once.withColumns({"s": F.sum("s").over(wy), "q": F.sum("q").over(wy)})


def self_guided(s: Column, q: Column, n: int, strength: int) -> tuple[Column, Column]:
    """(a, b) of the self-guided filter from box sums over n samples (9 or 25)."""
    one_by_n = 455 if n == 9 else 164
    spread = F.greatest(q * n - s * s, lit64(0))
    z = F.least(F.shiftright(spread * strength + (1 << 19), 20), lit64(255))
    b = F.when(z >= 255, lit64(256)).when(z == 0, lit64(1)).otherwise(div(z * 256 + div(z, lit64(2)), z + 1))
    a = F.shiftright((lit64(256) - b) * s * one_by_n + 2048, 12)
    return a, b


def wiener_pass(rows: DataFrame, keys: list[str], taps: tuple[int, ...], line: str, along: str, start: int, shift: int, low: int | None, high: int | None) -> DataFrame:
    """One direction of a seven-tap filter; the ends repeat."""
    w = across(keys, line, along)
    first = F.first("v").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last("v").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    parts = [(F.col("v") if k == 3 else F.coalesce(F.lag("v", 3 - k).over(w), first) if k < 3 else F.coalesce(F.lead("v", k - 3).over(w), last)) * t for k, t in enumerate(taps)]
    v = round_shift(total(parts) + start, shift)
    return rows.withColumn("v", v if low is None else clip(v, low, high))


def wiener(rows: DataFrame, keys: list[str], horizontal: tuple[int, ...], vertical: tuple[int, ...], depth: int = 8) -> DataFrame:
    """Seven taps across, then down; taps sum to 128."""
    first, second = (3, 11) if depth < 12 else (5, 9)
    once = wiener_pass(rows, keys, horizontal, "y", "x", 1 << depth + 6, first, 0, (1 << depth + 8 - first) - 1)
    out = wiener_pass(once, keys, vertical, "x", "y", -(1 << depth + second - 1), second, None, None)
    return out.withColumn("v", clip(F.col("v"), 0, (1 << depth) - 1))


def deblock_narrow(p1: Column, p0: Column, q0: Column, q1: Column, limit: int, edge: int, hev_at: int) -> tuple[Column, ...]:
    """The four samples across an edge after the narrow filter."""
    c4 = lambda v: clip(v, -128, 127)
    mask = (F.abs(p1 - p0) <= limit) & (F.abs(q1 - q0) <= limit) & (F.abs(p0 - q0) * 2 + div(F.abs(p1 - q1), lit64(2)) <= edge)
    hev = (F.abs(p1 - p0) > hev_at) | (F.abs(q1 - q0) > hev_at)
    s1, s0, t0, t1 = (v - 128 for v in (p1, p0, q0, q1))
    f = c4(F.when(hev, c4(s1 - t1)).otherwise(lit64(0)) + (t0 - s0) * 3)
    f1, f2 = F.shiftright(c4(f + 4), 3), F.shiftright(c4(f + 3), 3)
    outer = F.when(hev, lit64(0)).otherwise(round_shift(f1, 1))
    new = (c4(s1 + outer) + 128, c4(s0 + f2) + 128, c4(t0 - f1) + 128, c4(t1 - outer) + 128)
    return tuple(F.when(mask, n).otherwise(o) for n, o in zip(new, (p1, p0, q0, q1), strict=True))


def deblock_wide8(s: list[Column], limit: int, edge: int, hev_at: int, flat_at: int) -> list[Column]:
    """The eight samples across an edge (p3 to q3) after filtering: averaged where flat, else by the narrow filter; unchanged past the limits.

    The format's ``flat_at`` is 1 for 8-bit samples.
    """
    p3, p2, p1, p0, q0, q1, q2, q3 = s
    steps = [(p3, p2), (p2, p1), (p1, p0), (q1, q0), (q2, q1), (q3, q2)]
    mask = F.abs(p0 - q0) * 2 + div(F.abs(p1 - q1), lit64(2)) <= edge
    for a, b in steps:
        mask &= F.abs(a - b) <= limit
    flat = F.lit(True)
    for far, near in ((p1, p0), (p2, p0), (p3, p0), (q1, q0), (q2, q0), (q3, q0)):
        flat &= F.abs(far - near) <= flat_at
    narrow = [p2, *deblock_narrow(p1, p0, q0, q1, limit, edge, hev_at), q2]
    out = []
    for at in range(1, 7):
        # a sample averages its window of seven, itself twice, with the ends repeated
        window = [s[min(max(at + k, 0), 7)] for k in range(-3, 4)] + [s[at]]
        smooth = round_shift(sum(window[1:], window[0]), 3)
        out.append(F.when(mask & flat, smooth).when(mask, narrow[at - 1]).otherwise(s[at]))
    return [p3, *out, q3]


def direction_lines() -> list[list[list[tuple[int, int]]]]:
    """For each of eight directions, the lines of an 8x8 block as lists of (y, x)."""
    keys = (
        lambda y, x: y + x,
        lambda y, x: x + y // 2,
        lambda y, x: x,
        lambda y, x: 3 + x - y // 2,
        lambda y, x: 7 + x - y,
        lambda y, x: 3 - x // 2 + y,
        lambda y, x: y,
        lambda y, x: x // 2 + y,
    )
    # direction 0 is 45 degrees up-right; lines are grouped by their key
    order = (0, 7, 6, 5, 4, 3, 2, 1)
    out = []
    for d in order:
        lines: dict[int, list[tuple[int, int]]] = {}
        for y in range(8):
            for x in range(8):
                lines.setdefault(keys[d](y, x), []).append((y, x))
        out.append([lines[k] for k in sorted(lines)])
    return out


def cdef_direction(block: Column, depth: int = 8) -> tuple[Column, Column]:
    """(direction, variance) of an 8x8 block: the largest weighted sum of squared line sums, the lowest direction on ties.

    A line of n samples weighs 840 / n, so all directions compare.
    """
    s = F.transform(block, lambda v: F.shiftright(v, depth - 8) - 128)

    def costs(a: Column) -> Column:
        out = []
        for lines in direction_lines():
            squares = []
            for line in lines:
                v = total([F.element_at(a, y * 8 + x + 1) for y, x in line])
                squares.append(v * v * (840 // len(line)))
            out.append(total(squares))
        return F.array(*out)

    cost = F.element_at(F.transform(F.array(s), costs), 1)

    def best(c: Column) -> Column:
        top = F.array_max(c)
        d = (F.array_position(c, top) - 1).cast("bigint")
        return F.struct(d.alias("d"), F.shiftright(top - F.element_at(c, (d.bitwiseXOR(lit64(4)) + 1).cast("int")), 10).alias("var"))

    found = F.element_at(F.transform(F.array(cost), best), 1)
    return found["d"], found["var"]


def cdef_tap(difference: Column, strength: int, damping: int) -> Column:
    """sign(d) min(|d|, max(0, strength - (|d| >> damping)))."""
    size = F.least(F.abs(difference), F.greatest(lit64(0), lit64(strength) - F.shiftright(F.abs(difference), damping)))
    return F.when(difference < 0, -size).otherwise(size)


def cdef_strength(strength: int, variance: Column) -> Column:
    """Luma strength adjusted by variance; 0 where it is 0."""
    level = F.least(F.greatest(F.length(F.bin(F.greatest(F.shiftright(variance, 6), lit64(1)))) - 1, F.lit(0)), F.lit(12)).cast("bigint")
    return F.when(variance == 0, lit64(0)).otherwise(F.shiftright((level + 4) * strength + 8, 4))


def grain_scale(value: Column, points: list[tuple[int, int]]) -> Column:
    """Piecewise-linear scaling through (value, scale) points, flat beyond the ends, in 16-bit fixed point."""
    out = lit64(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        slope = (y1 - y0) * ((65536 + (x1 - x0) // 2) // (x1 - x0))
        out = F.when(value < x1, F.shiftright((value - x0) * slope + 32768, 16) + y0).otherwise(out)
    return F.when(value < points[0][0], lit64(points[0][1])).otherwise(out)


def noise_register(state: Column, steps: int) -> Column:
    """States of the 16-bit shift register after each step, first step first."""

    def one(x: Column) -> Column:
        bit = x.bitwiseXOR(F.shiftright(x, 1)).bitwiseXOR(F.shiftright(x, 3)).bitwiseXOR(F.shiftright(x, 12)).bitwiseAND(1)
        return F.shiftright(x, 1).bitwiseOR(F.shiftleft(bit, 15))

    start = F.struct(state.alias("x"), F.array().cast("array<bigint>").alias("out"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda a, _: F.struct(one(a["x"]).alias("x"), F.concat(a["out"], F.array(one(a["x"]))).alias("out")))
    return folded["out"]


def add_grain(v: Column, grain: Column, scale: Column, shift: int, low: int, high: int) -> Column:
    return clip(v + round_shift(scale * grain, shift), low, high)


def constrain_rows(rows: DataFrame, keys: list[str], strength: int, damping: int) -> DataFrame:
    """Primary constrained taps along rows at distances 1 and 2 (weights 4 and 2), edges left out."""
    w = across(keys)
    v = F.col("v")
    taps = [cdef_tap(F.coalesce(f("v", k).over(w), v) - v, strength, damping) * weight for k, weight in ((1, 4), (2, 2)) for f in (F.lag, F.lead)]
    s = total(taps)
    return rows.withColumn("v", v + F.shiftright(s - F.when(s < 0, lit64(1)).otherwise(lit64(0)) + 8, 4))
