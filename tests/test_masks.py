"""Wedge masks."""

import numpy as np
from pyspark.sql import functions as F

from strataplane.operators import masks


def test_masters():
    steep = masks.master("oblique63")
    assert steep[0].tolist() == [0] * 44 + [1, 4, 11, 27, 46, 58, 62, 63] + [64] * 12 and steep[1].tolist() == [0] * 43 + [1, 2, 6, 18, 37, 53, 60, 63] + [64] * 13
    assert (masks.master("vertical")[5] == [0] * 28 + [0, 2, 7, 21, 43, 57, 62, 64] + [64] * 28).all() and (masks.master("horizontal") == masks.master("vertical").T).all()
    for i in (0, 7, 40):
        for j in (3, 20, 63):
            assert masks.master("oblique27")[j, i] == steep[i, j] and masks.master("oblique117")[i, 63 - j] == 64 - steep[i, j] and masks.master("oblique153")[63 - j, i] == 64 - steep[i, j]


def test_signs():
    for h, w in masks.SIZES:
        for n in range(16):
            a, b = masks.wedge(h, w, n, 0), masks.wedge(h, w, n, 1)
            assert a.shape == (h, w) and (a + b == 64).all() and a.min() >= 0
            border = np.concatenate([a[0], a[1:, 0]])
            assert (border.sum() + len(border) // 2) // len(border) >= 32


def test_blend(spark):
    rows = [(1, 8, 8, 0, 3), (2, 16, 8, 1, 5), (3, 4, 4, 0, 0), (4, 8, 8, 0, 16)]
    df = spark.createDataFrame([(k, h, w, s, n, list(range(h * w)), [100] * (h * w)) for k, h, w, s, n in rows], "k long, h int, w int, sign int, number int, a array<bigint>, b array<bigint>")
    got = {r.k: r.out for r in masks.blend_wedges(df, F.col("a"), F.col("b"), (F.col("h"), F.col("w")), F.col("sign"), F.col("number"), "out").collect()}
    for k, h, w, s, n in rows[:2]:
        m = masks.wedge(h, w, n, s).reshape(-1)
        assert got[k] == ((np.arange(h * w) * m + 100 * (64 - m) + 32) >> 6).tolist()
    assert got[3] is None and got[4] is None
    assert masks.bank(spark).count() == 288
