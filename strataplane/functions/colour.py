"""Colour as columns: integer YUV to RGB, transfer curves, primaries, gain maps."""

from __future__ import annotations

from math import floor

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strataplane.functions.integers import clip, div

# Luma weights (red, blue) by matrix code.
LUMA = {1: (0.2126, 0.0722), 4: (0.30, 0.11), 5: (0.299, 0.114), 6: (0.299, 0.114), 7: (0.212, 0.087), 9: (0.2627, 0.0593)}
# Coefficients of the full-range BT.601 matrix.
BT601_FULL = {"y": 65536, "rv": 91881, "gu": -22554, "gv": -46802, "bu": 116130}
# Chromaticities (red, green, blue, white) by primaries code.
PRIMARIES = {
    1: ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), (0.3127, 0.3290)),
    4: ((0.67, 0.33), (0.21, 0.71), (0.14, 0.08), (0.310, 0.316)),
    5: ((0.64, 0.33), (0.29, 0.60), (0.15, 0.06), (0.3127, 0.3290)),
    6: ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), (0.3127, 0.3290)),
    7: ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), (0.3127, 0.3290)),
    8: ((0.681, 0.319), (0.243, 0.692), (0.145, 0.049), (0.310, 0.316)),
    9: ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), (0.3127, 0.3290)),
    11: ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.314, 0.351)),
    12: ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.3127, 0.3290)),
    22: ((0.630, 0.340), (0.295, 0.605), (0.155, 0.077), (0.3127, 0.3290)),
}
BT709_CODES = (1, 6, 11, 12, 14, 15)


def fixed(v: float) -> int:
    """16.16 fixed point, halves up."""
    return floor(v * 65536 + 0.5)


def weights_of(matrix: int, primaries: int = 1) -> tuple[float, float]:
    """(red, blue) luma weights; code 12 derives them from the primaries, code 2 means BT.601."""
    if matrix == 12:
        m = to_xyz(1 if primaries == 2 else primaries)
        return float(m[1, 0]), float(m[1, 2])
    if matrix == 2:
        return LUMA[6]
    if matrix not in LUMA:
        raise ValueError(f"unsupported matrix code {matrix}")
    return LUMA[matrix]


def coefficients(matrix: int, full: bool, primaries: int = 1) -> dict[str, int]:
    if matrix in (2, 5, 6) and full:
        return BT601_FULL
    kr, kb = weights_of(matrix, primaries)
    kg = 1 - kr - kb
    sy, sc = (1.0, 1.0) if full else (255 / 219, 255 / 224)
    return {"y": fixed(sy), "rv": fixed(2 * (1 - kr) * sc), "gu": fixed(-2 * kb * (1 - kb) / kg * sc), "gv": fixed(-2 * kr * (1 - kr) / kg * sc), "bu": fixed(2 * (1 - kb) * sc)}


def yuv_to_rgb(y: Column, u: Column, v: Column, matrix: int, full: bool, primaries: int = 1) -> tuple[Column, Column, Column]:
    """8-bit samples to 8-bit red, green, blue."""
    if matrix == 0:
        return v, y, u
    if matrix == 8:
        if not full:
            s = fixed(255 / 219), fixed(255 / 224)
        else:
            s = 65536, 65536
        luma, cg, co = F.greatest(F.lit(0), y - (0 if full else 16)) * s[0], (u - 128) * s[1], (v - 128) * s[1]
        return tuple(clip(F.shiftright(c + 32768, 16), 0, 255) for c in (luma - cg + co, luma + cg, luma - cg - co))
    k = coefficients(matrix, full, primaries)
    luma, cu, cv = F.greatest(F.lit(0), y - (0 if full else 16)) * k["y"], u - 128, v - 128
    rows = (luma + cv * k["rv"], luma + cu * k["gu"] + cv * k["gv"], luma + cu * k["bu"])
    return tuple(clip(F.shiftright(c + 32768, 16), 0, 255) for c in rows)


def scale_sample(s: Column, top: int, to: int) -> Column:
    """A sample of 0..top rescaled to 0..to, halves up."""
    return div(s * to + top // 2, F.lit(top).cast("bigint"))


def alpha_full(s: Column, depth: int) -> Column:
    """Limited-range alpha to full range."""
    k, top = 1 << depth - 8, (1 << depth) - 1
    return clip(div((s - 16 * k) * top + 219 * k // 2, F.lit(219 * k).cast("bigint")), 0, top)


def unpremultiply(c: Column, a: Column, top: int = 255) -> Column:
    """Colour over alpha; 0 where alpha is 0, unchanged where it is full."""
    safe = F.when(a == 0, F.lit(1).cast("bigint")).otherwise(a)
    return F.when(a == 0, F.lit(0).cast("bigint")).when(a == top, c).otherwise(F.least(F.lit(top).cast("bigint"), div(c * top + div(a, F.lit(2).cast("bigint")), safe)))


def unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def to_linear(v: Column, code: int) -> Column:
    """Transfer curve to linear light; input is clamped to 0..1."""
    x = unit(v)
    if code in BT709_CODES:
        return F.when(x < 4.5 * 0.018053968510807, x / 4.5).otherwise(F.pow((x + 0.099296826809442) / 1.099296826809442, F.lit(1 / 0.45)))
    if code in (4, 5):
        return F.pow(x, F.lit(2.2 if code == 4 else 2.8))
    if code == 7:
        return F.when(x < 4.0 * 0.022821585529445, x / 4.0).otherwise(F.pow((x + 0.111572195921731) / 1.111572195921731, F.lit(1 / 0.45)))
    if code == 8:
        return x
    if code in (9, 10):
        span = 2.0 if code == 9 else 2.5
        return F.when(x <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), (x - 1) * span))
    if code == 13:
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
    if code == 16:
        p = F.pow(x, F.lit(32 / 2523))
        return F.pow(F.greatest(p - 3424 / 4096, F.lit(0.0)) / (F.lit(2413 / 128) - p * (2392 / 128)), F.lit(16384 / 2610))
    if code == 17:
        return F.pow(x, F.lit(2.6)) * (52.37 / 48)
    if code == 18:
        a, b, c = 0.17883277, 0.28466892, 0.55991073
        return F.when(x <= 0.5, x * x / 3).otherwise((F.exp((x - c) / a) + b) / 12)
    raise ValueError(f"unsupported transfer code {code}")


def from_linear(v: Column, code: int) -> Column:
    """Linear light to the transfer curve; input is clamped to 0..1."""
    x = unit(v)
    if code in BT709_CODES:
        return F.when(x < 0.018053968510807, x * 4.5).otherwise(F.pow(x, F.lit(0.45)) * 1.099296826809442 - 0.099296826809442)
    if code in (4, 5):
        return F.pow(x, F.lit(1 / (2.2 if code == 4 else 2.8)))
    if code == 7:
        return F.when(x < 0.022821585529445, x * 4.0).otherwise(F.pow(x, F.lit(0.45)) * 1.111572195921731 - 0.111572195921731)
    if code == 8:
        return x
    if code in (9, 10):
        span, least = (2.0, 0.01) if code == 9 else (2.5, 10**0.5 / 1000)
        return F.when(x < least, F.lit(0.0)).otherwise(F.log10(F.greatest(x, F.lit(least))) / span + 1)
    if code == 13:
        return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)
    if code == 16:
        p = F.pow(x, F.lit(2610 / 16384))
        return F.pow((p * (2413 / 128) + 3424 / 4096) / (p * (2392 / 128) + 1), F.lit(2523 / 32))
    if code == 17:
        return F.pow(x * (48 / 52.37), F.lit(1 / 2.6))
    if code == 18:
        a, b, c = 0.17883277, 0.28466892, 0.55991073
        return F.when(x <= 1 / 12, F.sqrt(x * 3)).otherwise(F.ln(F.greatest(x * 12 - b, F.lit(1e-9))) * a + c)
    raise ValueError(f"unsupported transfer code {code}")


def to_xyz(primaries: int) -> np.ndarray:
    """RGB to XYZ of a primaries code, scaled so that white has luminance 1."""
    r, g, b, w = PRIMARIES[primaries]
    columns = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in (r, g, b)]).T
    white = np.array([w[0] / w[1], 1.0, (1 - w[0] - w[1]) / w[1]])
    return columns * np.linalg.solve(columns, white)


def gamut_matrix(source: int, target: int) -> np.ndarray:
    return np.eye(3) if source == target else np.linalg.inv(to_xyz(target)) @ to_xyz(source)


def gamut(rgb: tuple[Column, Column, Column], source: int, target: int) -> tuple[Column, ...]:
    m = gamut_matrix(source, target)
    return tuple(rgb[0] * float(row[0]) + rgb[1] * float(row[1]) + rgb[2] * float(row[2]) for row in m)


def gain_weight(headroom: Column, base: float, alternate: float) -> Column:
    """Ramp of the display's log2 headroom between base and alternate; negative when the alternate is lower, 0 when equal."""
    if base == alternate:
        return F.lit(0.0)
    w = unit((headroom - base) / (alternate - base))
    return -w if alternate < base else w


def gain_apply(value: Column, gain: Column, weight: Column, low: float, high: float, gamma: float, base_offset: float, alternate_offset: float) -> Column:
    """A linear value under a gain-map sample in 0..1."""
    g = F.pow(gain, F.lit(1 / gamma))
    return (value + base_offset) * F.pow(F.lit(2.0), (F.lit(low) + g * (high - low)) * weight) - alternate_offset


def to_integer(v: Column, top: int) -> Column:
    """Unit value to 0..top, halves up."""
    return F.floor(unit(v) * top + 0.5).cast("bigint")


def same_colour(a: Column, b: Column, unspecified: int) -> Column:
    """Equality of code points where 2 stands for ``unspecified``."""
    return F.coalesce(F.nullif(a, F.lit(2)), F.lit(unspecified)) == F.coalesce(F.nullif(b, F.lit(2)), F.lit(unspecified))


