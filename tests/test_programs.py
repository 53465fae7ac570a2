"""Sample programs as data, operator by operator, against plain integers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataplane.operators import programs

CODE = {n: c for c, n in (programs.UNARY | programs.BINARY).items()}


def payload(width, tokens):
    """Bytes of a program: ("c", value), input numbers from 1, and operator names."""
    out = bytes([(8, 16, 32, 64).index(width), len(tokens)])
    for t in tokens:
        if isinstance(t, tuple):
            out += b"\0" + t[1].to_bytes(width // 8, "big", signed=True)
        else:
            out += bytes([t if isinstance(t, int) else CODE[t]])
    return out


def value(width, tokens, inputs=(0,)):
    p = programs.parse(payload(width, tokens))
    assert p["error"] is None
    return min(max(int(programs.run(p, [np.array([v]) for v in inputs])[0]), 0), 65535)


def test_every_operator():
    c = lambda v: ("c", v)
    assert value(32, [c(5), "neg", c(10), "sum"]) == 5 and value(32, [c(-7), "abs"]) == 7 and value(32, [c(0), "not", c(2), "sum"]) == 1
    assert value(32, [c(16), "bsr"]) == 4 and value(32, [c(-1), "bsr"]) == 0
    for name, a, b, want in [("sum", 7, 5, 12), ("diff", 7, 5, 2), ("prod", 7, 5, 35), ("quot", 7, 2, 3), ("quot", 7, 0, 7), ("and", 6, 3, 2), ("or", 6, 3, 7), ("xor", 6, 3, 5), ("pow", 3, 4, 81), ("pow", 3, -1, 0), ("min", 6, 3, 3), ("max", 6, 3, 6)]:
        assert value(32, [c(a), c(b), name]) == want
    assert value(32, [1, 2, "sum"], (100, 200)) == 300
    assert value(8, [c(100), c(100), "sum"]) == 127 and value(16, [c(20_000), c(20_000), "sum"]) == 32_767
    big, low = (1 << 63) - 1, -(1 << 63)
    assert value(64, [c(big), c(1), "sum"]) == 65535 and value(64, [c(low), "abs"]) == 65535 and value(64, [c(2), c(big), "pow"]) == 65535 and value(64, [c(2), c(-1), "pow"]) == 0


def plain(width, name, a, b):
    top = (1 << width - 1) - 1
    hold = lambda v: max(min(v, top), -top - 1)
    if name == "quot":
        return a if b == 0 else hold(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
    if name == "pow":
        if a in (0, 1):
            return a
        if a == -1:
            return 1 if b % 2 == 0 else -1
        if b < 0:
            return 0
        return hold(a ** min(b, 64 + b % 2))
    return {"sum": hold(a + b), "diff": hold(a - b), "prod": hold(a * b), "and": a & b, "or": a | b, "xor": a ^ b, "min": min(a, b), "max": max(a, b), "neg": hold(-a), "abs": hold(abs(a)), "not": ~a, "bsr": max(a, 1).bit_length() - 1}[name]


@pytest.mark.parametrize("width", [8, 16, 32, 64])
def test_against_integers(width):
    rng = random.Random(width)
    top = (1 << width - 1) - 1
    for name in CODE:
        for _ in range(120):
            a, b = (rng.choice([0, 1, -1, 2, -2, 3, top, -top - 1, rng.randint(-top - 1, top), rng.randint(-9, 9)]) for _ in "ab")
            tokens = [("c", a), name] if CODE[name] < 128 else [("c", a), ("c", b), name]
            p = programs.parse(payload(width, tokens))
            assert int(programs.run(p, [])[0]) == plain(width, name, a, b), (name, a, b)


def test_errors():
    good = payload(16, [1, 2, "sum"])
    wrong = {
        b"": "early", b"\x01": "early", b"\x41" + good[1:]: "version", b"\x01\0": "without tokens", good + b"x": "after", good[:-1]: "early", payload(16, [("c", 5)])[:-1]: "early",
        b"\x01\x01\x3f": "reserved", b"\x01\x01\x8a": "reserved", payload(16, ["sum"]): "operands", payload(16, [1, 2]): "one value", payload(16, [1, "neg", "sum"]): "operands",
    }
    for data, text in wrong.items():
        assert text in programs.parse(data)["error"], data
    with pytest.raises(ValueError, match="not there"):
        programs.run(programs.parse(payload(16, [3])), [np.array([1]), np.array([1])])
    with pytest.raises(ValueError, match="beyond"):
        programs.run(programs.parse(payload(8, [1])), [np.array([200])])


def test_planes(spark):
    rows = [(1, payload(32, [1, 2, "sum"]), [[1, 2, 3], [10, 20, 3000]]), (2, None, [[1]]), (3, payload(8, [1]), [[500]]), (4, payload(32, [1, 2, "sum"]), [[1], [1, 2]]), (5, payload(32, [("c", -5)]), [[7, 7]]), (6, payload(32, [1]), None), (7, payload(64, [1, 1, "prod"]), [[]])]
    df = spark.createDataFrame(rows, "k long, payload binary, p array<array<long>>")
    got = {r.k: r for r in programs.transform_planes(df, "k", F.col("p"), F.lit(0), F.lit(1023)).collect()}
    assert got[1].plane == [11, 22, 1023] and got[5].plane == [0, 0] and got[7].plane == []
    assert "early" in got[2].error and "beyond" in got[3].error and "size" in got[4].error and "not there" in got[6].error
    assert programs.programs(spark.createDataFrame([], "k long, payload binary")).count() == 0
