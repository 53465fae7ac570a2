"""Geometry on sample rows (.., y, x, v): key remaps, filters and unions, no kernel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplane.functions.integers import clip, div, round_shift


def rotate(rows: DataFrame, width: int, height: int, code: int) -> DataFrame:
    """Counter-clockwise by code x 90 degrees."""
    x, y = F.col("x"), F.col("y")
    new = {0: (y, x), 1: (width - 1 - x, y), 2: (height - 1 - y, width - 1 - x), 3: (x, height - 1 - y)}[code % 4]
    return rows.withColumns({"y": new[0], "x": new[1]})


def mirror(rows: DataFrame, width: int, height: int, axis: int) -> DataFrame:
    """Axis 0 flips top and bottom, 1 left and right."""
    return rows.withColumn("y", height - 1 - F.col("y")) if axis == 0 else rows.withColumn("x", width - 1 - F.col("x"))


def crop(rows: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    inside = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    return rows.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def display_size(width: Column, height: Column, code: Column) -> tuple[Column, Column]:
    """Width and height after a rotation code."""
    turned = code % 2 == 1
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def transformed(rows: DataFrame, width: int, height: int, rect: tuple[int, int, int, int] | None, code: int, axis: int | None) -> DataFrame:
    """Crop, then rotate, then mirror, in that order."""
    if rect:
        rows, (width, height) = crop(rows, *rect), rect[2:]
    rows = rotate(rows, width, height, code)
    if code % 2:
        width, height = height, width
    return rows if axis is None else mirror(rows, width, height, axis)


def compose_grid(cells: DataFrame, columns: int, cell_width: int, cell_height: int, width: int, height: int) -> DataFrame:
    """Cells (.., cell, y, x, v) in raster order on one canvas, clipped at the right and the bottom."""
    y = div(F.col("cell"), F.lit(columns).cast("bigint")) * cell_height + F.col("y")
    x = F.col("cell") % columns * cell_width + F.col("x")
    return cells.withColumns({"y": y, "x": x}).where((F.col("x") < width) & (F.col("y") < height)).drop("cell")


def neutral_chroma(depth: int) -> int:
    return 1 << depth - 1


def clean_aperture(width: Column, height: Column, w: tuple[Column, Column], h: tuple[Column, Column], dx: tuple[Column, Column], dy: tuple[Column, Column]) -> dict[str, Column]:
    """x, y, w, h of a centred rectangle given by rationals (numerator, denominator), exactly.

    The size rounds up and the origin down; both are clipped to the image, and
    a rectangle that lies outside has size 0.
    """
    wide = "decimal(38,0)"

    def axis(size: Column, extent: tuple[Column, Column], offset: tuple[Column, Column]) -> tuple[Column, Column]:
        n, d = extent[0].cast(wide), extent[1].cast(wide)
        on, od = offset[0].cast(wide), offset[1].cast(wide)
        length = F.ceil((n / d).cast("decimal(38,10)")).cast("bigint")
        # centre (size - 1) / 2 + offset, minus half of (extent - 1): a fraction over 2 d od
        top = (size.cast(wide) * d * od + on * d * 2 - n * od).cast(wide)
        start = F.floor((top / (d * od * 2)).cast("decimal(38,10)")).cast("bigint")
        first = clip(start, F.lit(0).cast("bigint"), size)
        return first, F.greatest(F.least(start + length, size) - first, F.lit(0).cast("bigint"))

    x, rw = axis(width, w, dx)
    y, rh = axis(height, h, dy)
    return {"cx": x, "cy": y, "cw": rw, "ch": rh}


def upscale_row(row: Column, width: int, out_width: int, taps: Column, depth: int = 8) -> Column:
    """One row resampled to ``out_width`` by eight taps at 64 phases, positions in 1/16384 of a sample.

    ``taps`` is an array of 64 arrays of eight integers that sum to 128;
    samples beyond the ends repeat.
    """
    step = ((width << 14) + out_width // 2) // out_width
    error = out_width * step - (width << 14)
    start = int((-((out_width - width) << 13) + out_width // 2) / out_width) + 128 - int(error / 2)

    def one(i: Column) -> Column:
        at = F.lit(start).cast("bigint") + i.cast("bigint") * step
        whole, phase = F.shiftright(at, 14), F.shiftright(at.bitwiseAND(0x3FFF), 8)
        parts = []
        for k in range(8):
            index = clip(whole + (k - 3), F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))
            parts.append(F.element_at(row, (index + 1).cast("int")) * F.element_at(F.element_at(taps, (phase + 1).cast("int")), k + 1))
        return clip(round_shift(reduce(lambda a, b: a + b, parts), 7), 0, (1 << depth) - 1)

    return F.transform(F.sequence(F.lit(0), F.lit(out_width - 1)), one)


def merge_tiles(tiles: DataFrame, placements: DataFrame, tile_width: int, tile_height: int) -> DataFrame:
    """Frames from decoded tiles (tile, y, x, v) and a list (frame, tile, ty, tx): a tile may be placed repeatedly."""
    both = placements.join(tiles, "tile")
    return both.select("frame", (F.col("ty") * tile_height + F.col("y")).alias("y"), (F.col("tx") * tile_width + F.col("x")).alias("x"), "v")
