import numpy as np
import pytest
from pyspark.sql import functions as F

from strataplane.functions import colour, integers, postfix, syntax
from strataplane.operators import blocks as K
from strataplane.operators import container
from strataplane.operators import transforms as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("bits", "program", "inputs", "want"),
    [
        (8, [("in", 0), "neg"], [-128], 127),
        (8, [("in", 0), "abs"], [-128], 127),
        (8, [("in", 0), ("in", 1), "sum"], [100, 100], 127),
        (64, [("in", 0), ("in", 1), "prod"], [2**62, -4], -(2**63)),
        (64, [("in", 0), ("in", 1), "sum"], [2**63 - 1, 1], 2**63 - 1),
        (64, [("in", 0), ("in", 1), "quot"], [-(2**63), -1], 2**63 - 1),
        (32, [("in", 0), ("in", 1), "quot"], [-7, 2], -3),
        (32, [("in", 0), ("in", 1), "quot"], [-7, 0], -7),
        (16, [("in", 0), ("in", 1), "pow"], [-2, 99], -32768),
        (16, [("in", 0), ("in", 1), "pow"], [-1, -3], -1),
        (16, [("in", 0), ("in", 1), "pow"], [5, -3], 0),
        (16, [("in", 0), ("in", 1), "pow"], [0, 0], 0),
        (32, [("in", 0), "bsr"], [1025], 10),
        (32, [("in", 0), "bsr"], [-4], 0),
        (32, [("in", 0), ("const", 6), "xor"], [5], 3),
    ],
)
def test_programs(spark, bits, program, inputs, want):
    columns = [F.lit(v).cast("bigint") for v in inputs]
    assert one(spark, postfix.compile_program(program, columns, bits, -(2**63), 2**63 - 1)) == want


@pytest.mark.parametrize("program", [["sum"], [("in", 0), ("in", 0)], [("in", 3)], [("const", 128)], [("in", 0), "huh"]])
def test_program_errors(program):
    with pytest.raises(ValueError):
        postfix.validate(program, 1, 8)


@pytest.mark.parametrize("code", [1, 4, 5, 7, 8, 9, 10, 13, 16, 17, 18])
def test_curves_invert(spark, code):
    x = [0.05, 0.2, 0.5, 0.9] if code == 17 else [0.05, 0.2, 0.5, 0.9, 1.0]  # code 17 is over 1 at white
    rows = spark.createDataFrame([(v,) for v in x], "x double")
    back = rows.select(colour.from_linear(colour.to_linear(F.col("x"), code), code).alias("y")).collect()
    assert np.allclose([r.y for r in back], x, atol=1e-6)


def test_published_matrix():
    want = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]
    assert np.allclose(colour.to_xyz(1), want, atol=2e-4)
    assert np.allclose(colour.gamut_matrix(9, 1), [[1.6605, -0.5876, -0.0728], [-0.1246, 1.1329, -0.0083], [-0.0182, -0.1006, 1.1187]], atol=2e-4)
    assert colour.coefficients(1, True) == {"y": 65536, "rv": 103206, "gu": -12276, "gv": -30679, "bu": 121609}
    with pytest.raises(ValueError):
        colour.weights_of(3)


def test_leb128(spark):
    assert one(spark, integers.leb128(F.array(F.lit(0xE5), F.lit(0x8E), F.lit(0x26), F.lit(9)))) == 624485


@pytest.mark.parametrize(("n", "f"), [(4, K.dct4), (8, K.dct8)])
def test_dct_is_orthogonal_transform(spark, n, f):
    rng = np.random.default_rng(n)
    basis = np.array([[np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * (1 if k else np.sqrt(0.5)) for k in range(n)] for x in range(n)])
    for _ in range(5):
        v = rng.integers(-2000, 2000, n)
        got = one(spark, F.array(*f([F.lit(int(c)).cast("bigint") for c in v])))
        assert np.abs(np.array(got) - basis @ v).max() <= 4


def _lines(f, v):
    return np.stack(f([v[:, i] for i in range(v.shape[1])]), axis=1)


@pytest.mark.parametrize("n", [4, 8, 16, 32, 64])
def test_dct_lines(n):
    v = np.random.default_rng(n).integers(-3000, 3000, (40, n))
    basis = np.array([[np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * (1 if k else np.sqrt(0.5)) for k in range(n)] for x in range(n)])
    assert np.abs(_lines(T.dct, v) - v @ basis.T).max() <= 10


@pytest.mark.parametrize("n", [8, 16])
def test_adst_lines(n):
    v = np.random.default_rng(n).integers(-3000, 3000, (40, n))
    basis = np.array([[np.sin(np.pi * (2 * x + 1) * (2 * k + 1) / (4 * n)) for k in range(n)] for x in range(n)])
    assert np.abs(_lines(T.adst, v) - v @ basis.T).max() <= 6
    assert (_lines(T.flipped(T.adst), v) == _lines(T.adst, v)[:, ::-1]).all()


@pytest.mark.parametrize(("width", "height"), [(4, 4), (8, 4), (16, 16), (8, 32), (64, 16), (32, 32)])
def test_separable_sizes(spark, width, height):
    """Whole blocks on Spark against the float transform; a null block stays null."""
    rng = np.random.default_rng(width)
    basis = lambda n: np.array([[np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * (1 if k else np.sqrt(0.5)) for k in range(n)] for x in range(n)])
    coded = np.zeros((3, height, width), dtype=np.int64)
    coded[:, :4, :4] = rng.integers(-400, 400, (3, 4, 4))
    rows = [(i, c.reshape(-1).tolist()) for i, c in enumerate(coded)] + [(9, None)]
    df = spark.createDataFrame(rows, "id long, r array<long>")
    got = {r.id: r.r for r in T.on_blocks(df, "r", width * height, lambda x: T.separable(x, width, height, T.dct, T.dct)).collect()}
    scale = (2**-0.5 if max(width, height) == 2 * min(width, height) else 1) / 2 ** (T.row_shift(width, height) + 4)
    for i, c in enumerate(coded):
        want = basis(height) @ c @ basis(width).T * scale
        assert np.abs(np.array(got[i]).reshape(height, width) - want).max() <= 2
    assert got[9] is None


@pytest.mark.parametrize(("code", "want"), [("1", 0), ("010", 1), ("011", 2), ("00100", 3), ("00111", 6), ("0001000", 7), ("00", None), ("0001", None)])
def test_uvlc(spark, code, want):
    assert one(spark, syntax.uvlc(F.lit(int(code.ljust(7 if want is not None else len(code), "0"), 2)).cast("bigint"), 7 if want is not None else len(code))) == want


@pytest.mark.parametrize(("side", "finer", "want"), [(64, 0, [0]), (65, 1, [0, 1]), (4096, 0, [0]), (4097, 0, [0, 33]), (640, 2, [0, 3, 6, 9]), (16384, 0, [0, 64, 128, 192])])
def test_tile_starts(spark, side, finer, want):
    assert one(spark, syntax.tile_starts(F.lit(side).cast("bigint"), F.lit(finer))) == want


@pytest.mark.parametrize(
    ("row", "col", "y4", "x4", "want"),
    [(-512, 0, 16, 96, True), (-512, 2560, 16, 96, False), (0, -2048, 0, 160, False), (0, -2560, 0, 160, True), (-509, 0, 16, 96, False), (-1024, 0, 16, 96, False), (512, 0, 16, 96, False)],
)
def test_copy_allowed(spark, row, col, y4, x4, want):
    """Blocks of 8 x 8: above; past the wavefront; four and five superblocks to the left; broken samples; outside; below."""
    got = syntax.copy_allowed(*[F.lit(v).cast("bigint") for v in (row, col, y4, x4, 8, 8)], (0, 0, 256, 256))
    assert one(spark, got) is want


@pytest.mark.parametrize("bits", [0, 1, 3, 16])
def test_sum_before(spark, bits):
    """Spans of 1, 2, 8 and all values, with gaps, null keys and values, and an empty table."""
    rows = [(None if i % 7 == 3 else "ab"[i % 3 == 0], i * 3 - 20, None if i % 11 == 5 else i - 9, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, o long, v long, other string")
    got = {r["o"]: r["t"] for r in container.sum_before(df, "k", "o", "v", "t", bits).collect()}
    assert got == {o: sum(v or 0 for k2, o2, v, _ in rows if k2 == k and o2 < o) for k, o, _, _ in rows}
    assert container.sum_before(df.limit(0), "k", "o", "v", "t", bits).collect() == []
