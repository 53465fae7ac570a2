"""Motion from other frames: eight-tap prediction with scaled references, and affine models from their sums.

Prediction runs over batches of blocks as arrays: each sample's place in the reference advances by a fixed-point step, its fraction chooses a row of
taps, and rows and columns are filtered one after the other with an intermediate of higher precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplane.functions.integers import clip, let, lit64

# Fixed values of the format: taps in 1/128 for fractions 1 to 8 of 16; those of 9 to 15 are the same from behind.
REGULAR = (
    (0, 2, -6, 126, 8, -2, 0, 0), (0, 2, -10, 122, 18, -4, 0, 0), (0, 2, -12, 116, 28, -8, 2, 0), (0, 2, -14, 110, 38, -10, 2, 0),
    (0, 2, -14, 102, 48, -12, 2, 0), (0, 2, -16, 94, 58, -12, 2, 0), (0, 2, -14, 84, 66, -12, 2, 0), (0, 2, -14, 76, 76, -14, 2, 0),
)
SMOOTH = (
    (0, 2, 28, 62, 34, 2, 0, 0), (0, 0, 26, 62, 36, 4, 0, 0), (0, 0, 22, 62, 40, 4, 0, 0), (0, 0, 20, 60, 42, 6, 0, 0),
    (0, 0, 18, 58, 44, 8, 0, 0), (0, 0, 16, 56, 46, 10, 0, 0), (0, -2, 16, 54, 48, 12, 0, 0), (0, -2, 14, 52, 52, 14, -2, 0),
)
SHARP = (
    (-2, 2, -6, 126, 8, -2, 2, 0), (-2, 6, -12, 124, 16, -6, 4, -2), (-2, 8, -18, 120, 26, -10, 6, -2), (-4, 10, -22, 116, 38, -14, 6, -2),
    (-4, 10, -22, 108, 48, -18, 8, -2), (-4, 10, -24, 100, 60, -20, 8, -2), (-4, 10, -24, 90, 70, -22, 10, -2), (-4, 12, -24, 80, 80, -24, 12, -4),
)
#: Bits of a position's fraction, of a scale factor, of a motion vector's sixteenths.
POSITION, SCALE, SIXTEENTHS = 10, 14, 4
SMALL = 4


def taps(kind: int, side: int) -> np.ndarray:
    """16 rows of eight taps: kind 0 regular, 1 smooth, 2 sharp, 3 bilinear.  Sides of up to SMALL samples fold the outer taps into their neighbours, and use regular for sharp."""
    if kind == 3:
        return np.array([[0, 0, 0, 128 - 8 * i, 8 * i, 0, 0, 0] for i in range(16)])
    half = np.array((REGULAR, SMOOTH, REGULAR if side <= SMALL else SHARP)[kind])
    whole = np.array([128 * (i == 3) for i in range(8)])
    out = np.concatenate([[whole], half, half[6::-1, ::-1]])
    if side <= SMALL:
        out[:, 2] += out[:, 0] + out[:, 1]
        out[:, 5] += out[:, 6] + out[:, 7]
        out[:, [0, 1, 6, 7]] = 0
    return out


def scale_factor(reference: int, current: int) -> int:
    """How far the reference moves for a sample, in 1/2**SCALE."""
    return ((reference << SCALE) + current // 2) // current


def _signed_round(v: np.ndarray, n: int) -> np.ndarray:
    return np.where(v < 0, -((-v + (1 << n >> 1)) >> n), (v + (1 << n >> 1)) >> n)


def start(at: np.ndarray, vector: np.ndarray, factor: np.ndarray, subsampled: int = 0) -> np.ndarray:
    """Where a block at sample ``at`` starts in its reference, in 1/2**POSITION; ``vector`` is in eighths of a luma sample."""
    half = 1 << SIXTEENTHS - 1
    sixteenths = (at << SIXTEENTHS) + (2 * vector >> subsampled) + half
    moved = sixteenths * factor - (half << SCALE)
    return _signed_round(moved, SCALE + SIXTEENTHS - POSITION) + (1 << POSITION - SIXTEENTHS >> 1)


def predict(planes: np.ndarray, y: np.ndarray, x: np.ndarray, dy: np.ndarray, dx: np.ndarray, height: int, width: int, rows: np.ndarray, columns: np.ndarray, depth: int = 8, compound: bool = False) -> np.ndarray:
    """(n, height, width) predictions from reference ``planes`` (n, h, w).

    ``y``, ``x``: starts, ``dy``, ``dx``: steps in 1/2**POSITION; ``rows``, ``columns``: kinds of taps for the vertical and the horizontal pass, one a block.
    Samples beyond an edge repeat it.  With ``compound``, the result keeps four bits more, for blending.
    """
    n, h, w = planes.shape
    first = 5 if depth == 12 else 3
    second = 7 if compound else 9 if depth == 12 else 11
    table = lambda kinds, side: np.stack([taps(k, side) for k in range(4)])[kinds]
    across, down = table(columns, width), table(rows, height)
    # what the second pass needs at most: the rows of the block that moves fastest
    tall = int(((height - 1) * dy.max(initial=0) + (1 << POSITION) - 1 >> POSITION) + 8) if n else 8
    px = x[:, None] + dx[:, None] * np.arange(width)
    lines = np.clip((y >> POSITION)[:, None] + np.arange(tall) - 3, 0, h - 1)
    cells = np.clip((px >> POSITION)[:, :, None] + np.arange(8) - 3, 0, w - 1)
    block = np.arange(n)
    taken = planes[block[:, None, None, None], lines[:, :, None, None], cells[:, None, :, :]]
    weights = across[block[:, None], px >> POSITION - SIXTEENTHS & 15]
    middle = (np.einsum("nrct,nct->nrc", taken, weights) + (1 << first >> 1)) >> first
    py = (y & (1 << POSITION) - 1)[:, None] + dy[:, None] * np.arange(height)
    chosen = middle[block[:, None, None], (py >> POSITION)[:, :, None] + np.arange(8), :]
    weights = down[block[:, None], py >> POSITION - SIXTEENTHS & 15]
    out = (np.einsum("nrtc,nrt->nrc", chosen, weights) + (1 << second >> 1)) >> second
    return out if compound else np.clip(out, 0, (1 << depth) - 1)


def predict_blocks(frame: DataFrame, key: str, plane: Column, reference: tuple[int, int], block: tuple[int, int], at: tuple[Column, Column], vector: tuple[Column, Column], current: tuple[Column, Column], kinds: tuple[Column, Column], depth: int = 8) -> DataFrame:
    """(key, s array<bigint>): a predicted block (height, width) for each row.

    ``plane``: the reference's samples by rows, ``reference`` its (height, width); ``at`` and ``vector``: (row, column) of the block and its motion in eighths; ``current``: (height, width) of the
    current frame, which with the reference's gives the scale; ``kinds``: taps of the vertical and the horizontal pass.  A null plane gives a null block.
    """
    (h, w), (height, width) = reference, block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1)
            some = np.asarray(cells.is_valid())
            planes = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, h, w)
            row, col, mv_row, mv_col, now_h, now_w, down, across = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)[some] for i in range(2, 10))
            sy, sx = ((h << SCALE) + now_h // 2) // now_h, ((w << SCALE) + now_w // 2) // now_w
            step = lambda f: _signed_round(f, SCALE - POSITION)
            got = predict(planes, start(row, mv_row, sy), start(col, mv_col, sx), step(sy), step(sx), height, width, down, across, depth)
            ends = np.concatenate([[0], np.cumsum(np.where(some, height * width, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(got.reshape(-1)), mask=pa.array(~some))], names=[key, "s"])

    numbers = [c.cast("bigint") for pair in (at, vector, current, kinds) for c in pair]
    chosen = frame.select(F.col(key), plane.alias("_plane"), *[c.alias(f"_{i}") for i, c in enumerate(numbers)])
    return chosen.mapInArrow(run, f"`{key}` {dict(frame.dtypes)[key]}, s array<bigint>")


# ---- affine models

#: Limits of a model's entries, and of its shifts.
AFFINE_LIMIT, MOVE_LIMIT = 1 << 13, 1 << 23
_WIDE = "decimal(38,0)"


def divisor(d: Column) -> Column:
    """struct(shift, factor): 1 / d as factor >> shift, where the factor is the rounded reciprocal of d's nine highest bits; d is not 0."""

    def parts(size: Column) -> Column:
        n = (F.length(F.bin(size)) - 1).cast("int")
        rest = size - F.call_function("shiftleft", lit64(1), n)
        index = F.when(n > 8, F.call_function("shiftright", rest + F.call_function("shiftleft", lit64(1), F.greatest(n - 9, F.lit(0))), F.greatest(n - 8, F.lit(0)))).otherwise(F.call_function("shiftleft", rest, F.greatest(8 - n, F.lit(0))))
        inverse = F.call_function("div", lit64(1 << 22) + F.call_function("div", index + 256, lit64(2)), index + 256)
        return F.struct((n + 14).alias("shift"), F.when(d < 0, -inverse).otherwise(inverse).alias("factor"))

    return let(F.abs(d), parts)


def _shifted(v: Column, shift: Column) -> Column:
    """A wide value over 2**shift, rounded away from 0 at halves."""
    power = F.call_function("shiftleft", lit64(1), shift.cast("int")).cast(_WIDE)
    half = F.call_function("div", power, F.lit(2).cast(_WIDE)).cast(_WIDE)
    rounded = F.call_function("div", F.abs(v) + half, power).cast(_WIDE)
    return F.when(v < 0, -rounded).otherwise(rounded)


def _times(*v: Column) -> Column:
    out = v[0].cast(_WIDE)
    for x in v[1:]:
        out = (out * x.cast(_WIDE)).cast(_WIDE)
    return out


def shear(m: Column) -> Column:
    """struct(alpha, beta, gamma, delta, valid) of a model's six entries (array<bigint>); valid tells whether it can be applied in two passes."""
    a, b, c, d = (F.element_at(m, i + 1) for i in (2, 3, 4, 5))
    hold = lambda v: clip(v, lit64(-32768), lit64(32767))
    even = lambda v: F.when(v < 0, -(F.shiftright(-v + 32, 6) * 64)).otherwise(F.shiftright(v + 32, 6) * 64)

    def entries(by: Column) -> Column:
        gamma = hold(_shifted(_times(c * 65536, by["factor"]), by["shift"]).cast("bigint"))
        delta = hold(d - _shifted(_times(b, c, by["factor"]), by["shift"]).cast("bigint") - 65536)
        return F.struct(even(hold(a - 65536)).alias("alpha"), even(hold(b)).alias("beta"), even(gamma).alias("gamma"), even(delta).alias("delta"))

    def checked(s: Column) -> Column:
        fits = (4 * F.abs(s["alpha"]) + 7 * F.abs(s["beta"]) < 65536) & (4 * F.abs(s["gamma"]) + 4 * F.abs(s["delta"]) < 65536)
        return F.struct(s["alpha"].alias("alpha"), s["beta"].alias("beta"), s["gamma"].alias("gamma"), s["delta"].alias("delta"), fits.alias("valid"))

    none = F.struct(*[F.lit(None).cast("bigint").alias(k) for k in ("alpha", "beta", "gamma", "delta")], F.lit(False).alias("valid"))
    safe = F.when(a > 0, a).otherwise(lit64(1))
    return F.when(a > 0, let(let(divisor(safe), entries), checked)).otherwise(none)


def solve(sums: dict[str, Column], mid: tuple[Column, Column], vector: tuple[Column, Column]) -> Column:
    """Six entries (array<bigint>) of the model that fits the sums a00, a01, a11, bx0, bx1, by0, by1 best; null where they are singular.

    ``mid``: (row, column) of the block's middle, ``vector`` its motion (row, column) in eighths.
    """
    s = {k: v.cast(_WIDE) for k, v in sums.items()}
    det = _times(s["a00"], s["a11"]) - _times(s["a01"], s["a01"])
    diagonal = lambda v: clip(v, lit64(65536 - AFFINE_LIMIT + 1), lit64(65536 + AFFINE_LIMIT - 1))
    other = lambda v: clip(v, lit64(-AFFINE_LIMIT + 1), lit64(AFFINE_LIMIT - 1))

    def model(by: Column) -> Column:
        # the quotient is wanted in 1/65536; where that leaves no shift, the factor grows instead
        shift = by["shift"] - 16
        factor = (by["factor"].cast(_WIDE) * F.call_function("shiftleft", lit64(1), F.greatest(-shift, F.lit(0)).cast("int")).cast(_WIDE)).cast(_WIDE)
        quotient = lambda v: clip(_shifted(_times(v, factor), F.greatest(shift, F.lit(0))), F.lit(-(1 << 40)).cast(_WIDE), F.lit(1 << 40).cast(_WIDE)).cast("bigint")
        cross = lambda p, q, r, t: (_times(s[p], s[q]) - _times(s[r], s[t])).cast(_WIDE)
        return F.array(diagonal(quotient(cross("a11", "bx0", "a01", "bx1"))), other(quotient(cross("a00", "bx1", "a01", "bx0"))), other(quotient(cross("a11", "by0", "a01", "by1"))), diagonal(quotient(cross("a00", "by1", "a01", "by0"))))

    def moved(m: Column) -> Column:
        a, b, c, d = (F.element_at(m, i + 1) for i in range(4))
        hold = lambda v: clip(v, lit64(-MOVE_LIMIT), lit64(MOVE_LIMIT - 1))
        vx = vector[1] * 8192 - (mid[1] * (a - 65536) + mid[0] * b)
        vy = vector[0] * 8192 - (mid[1] * c + mid[0] * (d - 65536))
        return F.array(hold(vx), hold(vy), a, b, c, d)

    whole = det.cast("bigint")
    return F.when(whole != 0, let(let(divisor(F.when(whole != 0, whole).otherwise(lit64(1))), model), moved))
