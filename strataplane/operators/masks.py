"""Wedge masks: a bounded bank of blend masks by size, sign and number, and blocks blended by their key.

Each mask is a window of a 64 x 64 master in one of six directions; the window's place comes from a codebook, which differs by the block's shape.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: the ramps in the middle of odd and even rows of an oblique master and of a vertical one; codebooks of direction and place in eighths.
ODD, EVEN, VERTICAL = (1, 2, 6, 18, 37, 53, 60, 63), (1, 4, 11, 27, 46, 58, 62, 63), (0, 2, 7, 21, 43, 57, 62, 64)
DIRECTIONS = ("horizontal", "vertical", "oblique27", "oblique63", "oblique117", "oblique153")
_MIDDLE = (("oblique27", 4, 4), ("oblique63", 4, 4), ("oblique117", 4, 4), ("oblique153", 4, 4))
_OUTER = (("oblique27", 4, 2), ("oblique27", 4, 6), ("oblique153", 4, 2), ("oblique153", 4, 6), ("oblique63", 2, 4), ("oblique63", 6, 4), ("oblique117", 2, 4), ("oblique117", 6, 4))
CODEBOOKS = {
    "tall": (*_MIDDLE, ("horizontal", 4, 2), ("horizontal", 4, 4), ("horizontal", 4, 6), ("vertical", 4, 4), *_OUTER),
    "wide": (*_MIDDLE, ("vertical", 2, 4), ("vertical", 4, 4), ("vertical", 6, 4), ("horizontal", 4, 4), *_OUTER),
    "square": (*_MIDDLE, ("horizontal", 4, 2), ("horizontal", 4, 6), ("vertical", 2, 4), ("vertical", 6, 4), *_OUTER),
}
#: (height, width) of blocks that have wedges.
SIZES = ((8, 8), (16, 8), (8, 16), (16, 16), (32, 16), (16, 32), (32, 32), (32, 8), (8, 32))
SIDE = 64


@cache
def master(direction: str) -> np.ndarray:
    """The 64 x 64 master of a direction, 0 to 64."""
    ramp = lambda middle: np.array([0] * 28 + list(middle) + [64] * 28)
    if direction == "vertical":
        return np.tile(ramp(VERTICAL), (SIDE, 1))
    if direction == "horizontal":
        return master("vertical").T
    if direction == "oblique63":
        # each row is the ramp, half a sample further left than the one above
        at = lambda i: np.clip(np.arange(SIDE) - SIDE // 4 + (i + 1) // 2, 0, SIDE - 1)
        return np.stack([ramp(ODD if i % 2 else EVEN)[at(i)] for i in range(SIDE)])
    steep = master("oblique63")
    return {"oblique27": steep.T, "oblique117": 64 - steep[:, ::-1], "oblique153": (64 - steep).T[::-1]}[direction]


def wedge(height: int, width: int, number: int, sign: int) -> np.ndarray:
    """A mask; that of sign 0 and of sign 1 add up to 64, and the edge through top and left corner of the first is at least half."""
    shape = "tall" if height > width else "wide" if height < width else "square"
    direction, x, y = CODEBOOKS[shape][number]
    top, left = SIDE // 2 - (y * height >> 3), SIDE // 2 - (x * width >> 3)
    cut = master(direction)[top : top + height, left : left + width]
    border, n = int(cut[0].sum() + cut[1:, 0].sum()), height + width - 1
    flip = (border + n // 2) // n < 32
    return cut if sign == flip else 64 - cut


def bank(spark: SparkSession) -> DataFrame:
    """(height, width, sign, number, mask array<int>): 288 masks of at most 1024 values."""
    rows = [(h, w, sign, number, wedge(h, w, number, sign).reshape(-1).tolist()) for h, w in SIZES for sign in (0, 1) for number in range(16)]
    return spark.createDataFrame(rows, "height int, width int, sign int, number int, mask array<int>")


def blend_wedges(frame: DataFrame, first: Column, second: Column, size: tuple[Column, Column], sign: Column, number: Column, name: str = "s") -> DataFrame:
    """``frame`` with ``name``: the masked mean of two blocks (arrays by rows); null where the size or number has no wedge."""
    keyed = frame.withColumns({"_height": size[0].cast("int"), "_width": size[1].cast("int"), "_sign": sign.cast("int"), "_number": number.cast("int"), "_first": first, "_second": second})
    masks = bank(frame.sparkSession).select(*[F.col(c).alias(f"_{c}") for c in ("height", "width", "sign", "number")], F.col("mask").alias("_mask"))
    joined = keyed.join(F.broadcast(masks), ["_height", "_width", "_sign", "_number"], "left")  # 288 rows
    mixed = F.transform(F.arrays_zip("_first", "_second", "_mask"), lambda x: F.shiftright(x["_first"] * x["_mask"] + x["_second"] * (64 - x["_mask"]) + 32, 6).cast("bigint"))
    return joined.withColumn(name, F.when(F.col("_mask").isNotNull(), mixed)).select(*[F.col(f"`{c}`") for c in frame.columns if c != name], name)
