"""Inverse block transforms as an Arrow kernel: a batch of blocks is one matrix, and every butterfly works on all its rows.

The networks are those of the published bitstream specification (lengths 4 to
64, 12-bit cosines), so results are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import cos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Lines = list[np.ndarray]  # one array a coefficient, each over all rows
Transform = Callable[[Lines], Lines]


def cos12(angle: int) -> int:
    """round(4096 cos(angle pi / 128)), halves away from 0."""
    v = cos(angle * pi / 128) * 4096
    return int(v + 0.5) if v >= 0 else -int(0.5 - v)


def rounded(v: np.ndarray, n: int) -> np.ndarray:
    return v + (1 << n - 1) >> n if n else v


def _turn(t: Lines, a: int, b: int, angle: int, swap: bool) -> None:
    """Rotates lines a and b by ``angle``; ``swap`` exchanges the results."""
    c, s = cos12(angle), cos12(angle - 64)
    x, y = rounded(t[a] * c - t[b] * s, 12), rounded(t[a] * s + t[b] * c, 12)
    t[a], t[b] = (y, x) if swap else (x, y)


def _meet(t: Lines, a: int, b: int, swap: bool = False) -> None:
    """Sum and difference of lines a and b; ``swap`` puts the sum into b."""
    if swap:
        a, b = b, a
    t[a], t[b] = t[a] + t[b], t[a] - t[b]


def _flip_bits(i: int, n: int) -> int:
    return int(f"{i:0{n}b}"[::-1], 2) if n else 0


def dct(v: Lines) -> Lines:
    """Inverse DCT of 4, 8, 16, 32 or 64 lines.

    Rotations (turn) and sums (meet) by level; a level is skipped where the
    length does not reach it.
    """
    n = len(v).bit_length() - 1
    t = [v[_flip_bits(i, n)] for i in range(len(v))]

    def turns(least: int, places) -> None:
        if n >= least:
            for a, b, angle, swap in places:
                _turn(t, a, b, angle, swap)

    def meets(least: int, places) -> None:
        if n >= least:
            for a, b, swap in places:
                _meet(t, a, b, swap)

    turns(6, [(32 + i, 63 - i, 63 - 4 * _flip_bits(i, 4), False) for i in range(16)])
    turns(5, [(16 + i, 31 - i, 6 + 8 * _flip_bits(7 - i, 3), False) for i in range(8)])
    meets(6, [(32 + 2 * i, 33 + 2 * i, i % 2 == 1) for i in range(16)])
    turns(4, [(8 + i, 15 - i, 12 + 16 * _flip_bits(3 - i, 2), False) for i in range(4)])
    meets(5, [(16 + 2 * i, 17 + 2 * i, i % 2 == 1) for i in range(8)])
    turns(6, [(62 - 4 * i - j, 33 + 4 * i + j, 60 - 16 * _flip_bits(i, 2) + 64 * j, True) for i in range(4) for j in range(2)])
    turns(3, [(4 + i, 7 - i, 56 - 32 * i, False) for i in range(2)])
    meets(4, [(8 + 2 * i, 9 + 2 * i, i % 2 == 1) for i in range(4)])
    turns(5, [(30 - 4 * i - j, 17 + 4 * i + j, 24 + 64 * j + 32 * (1 - i), True) for i in range(2) for j in range(2)])
    meets(6, [(32 + 4 * i + j, 35 + 4 * i - j, i % 2 == 1) for i in range(8) for j in range(2)])
    turns(2, [(2 * i, 2 * i + 1, 32 + 16 * i, i == 0) for i in range(2)])
    meets(3, [(4 + 2 * i, 5 + 2 * i, i == 1) for i in range(2)])
    turns(4, [(14 - i, 9 + i, 48 + 64 * i, True) for i in range(2)])
    meets(5, [(16 + 4 * i + j, 19 + 4 * i - j, i % 2 == 1) for i in range(4) for j in range(2)])
    turns(6, [(61 - 8 * i - j, 34 + 8 * i + j, 56 - 32 * i + 64 * (j // 2), True) for i in range(2) for j in range(4)])
    meets(2, [(i, 3 - i, False) for i in range(2)])
    turns(3, [(6, 5, 32, True)])
    meets(4, [(8 + 4 * i + j, 11 + 4 * i - j, i == 1) for i in range(2) for j in range(2)])
    turns(5, [(29 - i, 18 + i, 48 + 64 * (i // 2), True) for i in range(4)])
    meets(6, [(32 + 8 * i + j, 39 + 8 * i - j, i % 2 == 1) for i in range(4) for j in range(4)])
    meets(3, [(i, 7 - i, False) for i in range(4)])
    turns(4, [(13 - i, 10 + i, 32, True) for i in range(2)])
    meets(5, [(16 + 8 * i + j, 23 + 8 * i - j, i == 1) for i in range(2) for j in range(4)])
    turns(6, [(59 - i, 36 + i, 48 if i < 4 else 112, True) for i in range(8)])
    meets(4, [(i, 15 - i, False) for i in range(8)])
    turns(5, [(27 - i, 20 + i, 32, True) for i in range(4)])
    meets(6, [x for i in range(8) for x in ((32 + i, 47 - i, False), (48 + i, 63 - i, True))])
    meets(5, [(i, 31 - i, False) for i in range(16)])
    turns(6, [(55 - i, 40 + i, 32, True) for i in range(8)])
    meets(6, [(i, 63 - i, False) for i in range(32)])
    return t


# The sines of the four-point asymmetric transform.
SINES = (1321, 2482, 3344, 3803)


def adst4(v: Lines) -> Lines:
    k1, k2, k3, k4 = SINES
    s0, s1 = v[0] * k1 + v[2] * k4 + v[3] * k2, v[0] * k2 - v[2] * k1 - v[3] * k4
    s3, s2 = v[1] * k3, (v[0] - v[2] + v[3]) * k3
    return [rounded(x, 12) for x in (s0 + s3, s1 + s3, s2, s0 + s1 - s3)]


def adst(v: Lines) -> Lines:
    """Inverse asymmetric sine transform of 4, 8 or 16 lines."""
    size = len(v)
    if size == 4:
        return adst4(v)
    t = [v[i - 1] if i % 2 else v[size - 1 - i] for i in range(size)]
    for i in range(size // 2):
        _turn(t, 2 * i, 2 * i + 1, 64 - 32 // size - 128 // size * i, True)
    half = size // 2
    for i in range(half):
        _meet(t, i, half + i)
    if size == 16:
        for i in range(2):
            _turn(t, 8 + 2 * i, 9 + 2 * i, 56 - 32 * i, True)
            _turn(t, 13 + 2 * i, 12 + 2 * i, 8 + 32 * i, True)
        for j in range(2):
            for i in range(4):
                _meet(t, 8 * j + i, 4 + 8 * j + i)
    for j in range(size // 8):
        for i in range(2):
            _turn(t, 4 + 8 * j + 3 * i, 5 + 8 * j + i, 48 - 32 * i, True)
    for j in range(size // 4):
        for i in range(2):
            _meet(t, 4 * j + i, 2 + 4 * j + i)
    for i in range(size // 4):
        _turn(t, 2 + 4 * i, 3 + 4 * i, 32, True)
    n = size.bit_length() - 1
    # lines leave in Gray-code order of the reversed place, every second one negated
    out = [t[_flip_bits(i ^ i >> 1, n)] for i in range(size)]
    return [-x if i % 2 else x for i, x in enumerate(out)]


def identity(v: Lines) -> Lines:
    n = len(v)
    if n == 4:
        return [rounded(x * 5793, 12) for x in v]
    if n == 8:
        return [x * 2 for x in v]
    return [rounded(x * 11586, 12) for x in v] if n == 16 else [x * 4 for x in v]


def wht(v: Lines) -> Lines:
    """Inverse Walsh-Hadamard of four lines; exact."""
    a, b, c, d = v
    t0, t2 = a + b, c - d
    t4 = t0 - t2 >> 1
    t3, t1 = t4 - d, t4 - b
    return [t0 - t3, t3, t1, t2 + t1]


def flipped(f: Transform) -> Transform:
    """A transform with its output reversed."""
    return lambda v: f(v)[::-1]


TRANSFORMS: dict[str, Transform] = {"dct": dct, "adst": adst, "flipadst": flipped(adst), "identity": identity, "wht": wht}


def row_shift(width: int, height: int) -> int:
    """Bits that the row pass drops: by the shorter side of a square or 4:1 block, and by whether a 2:1 block has a side of 4."""
    short, long = sorted((width, height))
    if long == 2 * short:
        return 0 if short == 4 else 1
    return {4: 0, 8: 1}.get(short, 2) + (long > short and short < 16)


def separable(blocks: np.ndarray, width: int, height: int, rows: Transform, columns: Transform, shift: int | None = None, last: int = 4, depth: int = 8) -> np.ndarray:
    """Residuals of coefficient blocks (n, height * width): rows, a rounding shift and a clip, then columns and the last shift.

    A side of 2:1 scales the input by 1/sqrt(2) first; the row pass reads values
    of depth + 8 bits, the column pass of max(depth + 6, 16) bits.
    """
    shift = row_shift(width, height) if shift is None else shift
    x = blocks.reshape(len(blocks), height, width)
    if max(width, height) == 2 * min(width, height):
        x = rounded(x * 2896, 12)
    top = 1 << depth + 7
    x = np.clip(x, -top, top - 1)
    passed = np.stack(rows([x[:, :, i] for i in range(width)]), axis=2)
    top = 1 << max(depth + 6, 16) - 1
    passed = np.clip(rounded(passed, shift), -top, top - 1)
    out = np.stack(columns([passed[:, i, :] for i in range(height)]), axis=1)
    return rounded(out, last).reshape(len(blocks), width * height)


def on_blocks(frame: DataFrame, column: str, size: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``frame`` with the array column ``column`` (``size`` bigints a row) replaced by the kernel's rows.

    A null array stays null.  The kernel gets a matrix of a batch's arrays and
    gives one with as many rows; no row depends on another.
    """
    names = frame.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(at)
            flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            got = kernel(flat.reshape(len(flat) // size, size)).astype(np.int64)
            width = got.shape[1]
            some = np.asarray(cells.is_valid())
            ends = np.concatenate([[0], np.cumsum(np.where(some, width, 0))]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends), pa.array(got.reshape(-1)), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([out if i == at else batch.column(i) for i in range(len(names))], names=names)

    schema = ", ".join(f"`{f.name}` array<bigint>" if f.name == column else f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, schema)
