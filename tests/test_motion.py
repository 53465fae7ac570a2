"""Eight-tap prediction, affine models and conformance rules against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_headers import HINTS, S, data, inter, inter_sequence

from strataplane.operators import conformance, motion
from strataplane.sources import headers


def test_taps():
    for kind in range(4):
        for side in (4, 8):
            t = motion.taps(kind, side)
            assert t.shape == (16, 8) and (t.sum(axis=1) == 128).all() and (t[0] == [0, 0, 0, 128, 0, 0, 0, 0]).all()
            if kind < 3:
                assert all((t[i] == t[16 - i][::-1]).all() for i in range(1, 16))
    assert (motion.taps(0, 4)[1] == [0, 0, -4, 126, 8, -2, 0, 0]).all() and (motion.taps(2, 4) == motion.taps(0, 4)).all()
    assert (motion.taps(1, 4)[8] == [0, 0, 12, 52, 52, 12, 0, 0]).all()


@pytest.mark.parametrize("seed", range(8))
def test_prediction(seed):
    """Sample by sample, as the published process says."""
    rng = random.Random(seed)
    h, w, bh, bw, n = 12, 10, rng.choice([2, 4, 8]), rng.choice([2, 4, 8]), 5
    planes = np.array([[[rng.randrange(1024) for _ in range(w)] for _ in range(h)] for _ in range(n)])
    y, x = (np.array([rng.randint(-4000, 12000) for _ in range(n)]) for _ in "yx")
    dy, dx = (np.array([rng.choice([1024, 512, 2048, rng.randint(100, 2048)]) for _ in range(n)]) for _ in "yx")
    rows, columns = (np.array([rng.randrange(4) for _ in range(n)]) for _ in "rc")
    depth, compound = rng.choice([(8, False), (10, True), (12, False)])
    got = motion.predict(planes, y, x, dy, dx, bh, bw, rows, columns, depth, compound)
    first, second = (5 if depth == 12 else 3), (7 if compound else 9 if depth == 12 else 11)
    for b in range(n):
        middle = {}
        for r in range(40):
            for c in range(bw):
                p = x[b] + dx[b] * c
                t = motion.taps(columns[b], bw)[p >> 6 & 15]
                s = sum(t[k] * planes[b][min(max((y[b] >> 10) + r - 3, 0), h - 1)][min(max((p >> 10) + k - 3, 0), w - 1)] for k in range(8))
                middle[r, c] = (s + (1 << first >> 1)) >> first
        for r in range(bh):
            p = (y[b] & 1023) + dy[b] * r
            t = motion.taps(rows[b], bh)[p >> 6 & 15]
            for c in range(bw):
                v = (sum(t[k] * middle[(p >> 10) + k, c] for k in range(8)) + (1 << second >> 1)) >> second
                assert got[b, r, c] == (v if compound else min(max(v, 0), (1 << depth) - 1))


def test_starts():
    one = motion.scale_factor(64, 64)
    assert one == 1 << 14 and motion.scale_factor(128, 64) == 2 << 14
    at = lambda a, v, f=one, s=0: int(motion.start(np.array([a]), np.array([v]), np.array([f]), s)[0])
    assert at(8, 0) == 8 * 1024 + 32 and at(8, 8) == 9 * 1024 + 32 and at(0, -3) == -3 * 128 + 32 and at(0, 8, s=1) == 512 + 32
    assert at(4, 0, 2 << 14) == 8 * 1024 + 512 + 32


def test_null_planes(spark):
    df = spark.createDataFrame([(1, None), (2, list(range(16)))], "k long, p array<bigint>")
    zero, four = F.lit(0), F.lit(4)
    got = {r.k: r.s for r in motion.predict_blocks(df, "k", F.col("p"), (4, 4), (2, 2), (zero, zero), (zero, zero), (four, four), (zero, zero)).collect()}
    assert got == {1: None, 2: [0, 1, 4, 5]}


def plain_divisor(d):
    n = abs(d).bit_length() - 1
    e = abs(d) - (1 << n)
    f = (e + (1 << n - 9)) >> n - 8 if n > 8 else e << 8 - n
    return n + 14, ((1 << 22) + (256 + f) // 2) // (256 + f) * (1 if d > 0 else -1)


def away(v, n):
    return -((-v + (1 << n >> 1)) >> n) if v < 0 else (v + (1 << n >> 1)) >> n


def plain_shear(m):
    if m[2] <= 0:
        return (None,) * 4 + (False,)
    hold = lambda v: max(-32768, min(32767, v))
    shift, factor = plain_divisor(m[2])
    values = [hold(m[2] - 65536), hold(m[3]), hold(away(m[4] * 65536 * factor, shift)), hold(m[5] - away(m[3] * m[4] * factor, shift) - 65536)]
    a, b, c, d = (away(v, 6) * 64 for v in values)
    return a, b, c, d, 4 * abs(a) + 7 * abs(b) < 65536 and 4 * abs(c) + 4 * abs(d) < 65536


def plain_solve(s, mid, vector):
    det = s["a00"] * s["a11"] - s["a01"] ** 2
    if not det:
        return None
    shift, factor = plain_divisor(det)
    shift -= 16
    if shift < 0:
        factor, shift = factor << -shift, 0
    fit = lambda v, at: max(at - 8191, min(at + 8191, away(v * factor, shift)))
    a, b = fit(s["a11"] * s["bx0"] - s["a01"] * s["bx1"], 65536), fit(s["a00"] * s["bx1"] - s["a01"] * s["bx0"], 0)
    c, d = fit(s["a11"] * s["by0"] - s["a01"] * s["by1"], 0), fit(s["a00"] * s["by1"] - s["a01"] * s["by0"], 65536)
    hold = lambda v: max(-(1 << 23), min((1 << 23) - 1, v))
    return [hold(vector[1] * 8192 - (mid[1] * (a - 65536) + mid[0] * b)), hold(vector[0] * 8192 - (mid[1] * c + mid[0] * (d - 65536))), a, b, c, d]


def test_models(spark):
    rng = random.Random(3)
    models = [[0, 0, 65536, 0, 0, 65536], [0, 0, 0, 0, 0, 0], [0, 0, -5, 1, 1, 1], [0, 0, 1, 8191, -8191, 65536]]
    models += [[0, 0, rng.choice([rng.randint(1, 600), rng.randint(57000, 74000)]), rng.randint(-8191, 8191), rng.randint(-8191, 8191), rng.randint(57000, 74000)] for _ in range(300)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(models)], "i int, m array<bigint>")
    got = {r.i: tuple(r.v) for r in df.select("i", motion.shear(F.col("m")).alias("v")).collect()}
    assert all(got[i] == plain_shear(m) for i, m in enumerate(models)) and got[0] == (0, 0, 0, 0, True)
    names = ["a00", "a01", "a11", "bx0", "bx1", "by0", "by1"]
    rows = [tuple([i, *[rng.randint(-1 << rng.randint(2, 27), 1 << rng.randint(2, 27)) for _ in names], rng.randint(0, 4000), rng.randint(0, 4000), rng.randint(-999, 999), rng.randint(-999, 999)]) for i in range(300)] + [(300, 4, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, f"i int, {', '.join(f'{c} bigint' for c in names)}, my bigint, mx bigint, vy bigint, vx bigint")
    got = {r.i: r.m for r in df.select("i", motion.solve({c: F.col(c) for c in names}, (F.col("my"), F.col("mx")), (F.col("vy"), F.col("vx"))).alias("m")).collect()}
    for r in rows:
        assert got[r[0]] == plain_solve(dict(zip(names, r[1:8], strict=True)), r[8:10], r[10:12]), r


def test_rules(spark):
    """Frames with one fault each, and one without."""
    key = lambda w, h: data("0001", "1", "1", (3, 4), (w - 1, 6), (h - 1, 6), "0", "0", "1", (7, 8), "0", "0", "0", "0", "0", "0", "0" * 12, "000", "0", "0", "0", "0")
    rows = []
    for name, w, h in (("good", 64, 64), ("low", 64, 12), ("narrow", 9, 64)):
        rows += [(name, 0, 0, 1, 0, 0, inter_sequence()), (name, 1, 0, 3, 0, 0, key(w, h)), (name, 2, 1, 3, 0, 0, inter())]
    # references of 64 samples to a frame of 64: sized by its first one; short signalling with hints that are not earlier
    rows += [("ahead", 0, 0, 1, 0, 0, inter_sequence()), ("ahead", 1, 0, 3, 0, 0, data("0001", "1", "0", (12, 4), "0", "0", "1", (7, 8), "0", "0", "0", "0", "0", "0", "0" * 12, "000", "0", "0", "0", "0")), ("ahead", 2, 1, 3, 0, 0, inter(short=True))]
    frames = headers.headers(spark.createDataFrame(rows, S), conformance.FIELDS, active=True).where("type = 3")
    got = {(r.stream_id, r.obu_index, r.rule) for r in conformance.violations(frames, conformance.rules()).collect()}
    assert got == {("low", 1, "least height of levels"), ("low", 2, "least height of levels"), ("narrow", 1, "least width of levels"), ("narrow", 2, "least width of levels"), ("ahead", 2, "last reference is earlier"), ("ahead", 2, "golden reference is earlier")}
    assert {r.stream_id for r in conformance.conforms(frames, conformance.rules()).collect()} == {"good", "ahead"}
    tiled = {r.rule for r in conformance.violations(frames.where("stream_id = 'good' and obu_index = 2"), conformance.tile_mode_rules()).collect()}
    assert {"no order hints in the sequence", "no super-resolution in the sequence", "no refreshed slots", "no size of its own", "no motion of references", "no compound references"} == tiled
    assert len(HINTS) == 8
