"""Whitening of embeddings by a randomised range finder.

Vectors become whole numbers, and each distinct one is fitted once.  A Gaussian sketch of a few columns more than components (oversampling) goes through power
passes over all centred rows: one pass gives V Q for the covariance V and the basis Q of the sketch.  Rayleigh-Ritz on
the basis gives eigenpairs and their residuals.  Where residuals don't fall below the bound, or fall too slowly to do so in the passes left,
the basis is expanded to the full dimension, and one more pass gives all eigenpairs.

A pass sends the basis (dimension x columns) to the tasks; each partition gives one partial product of that size, these are added up in REDUCERS tasks,
and the driver adds the last few.  No task or driver holds more rows than a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplane.llm.common import Scratch

SCALE = 256
COMPONENTS, OVERSAMPLING, PASSES = 4, 12, 6
#: Tasks that add up the partitions' partial products; the driver adds their results.
REDUCERS = 32
#: Sine of the angle between a component and its eigenvector, at most: residual over gap.
ANGLE = 1e-11


@dataclass(frozen=True)
class Model:
    """What ``fit`` found: n fitted vectors, their exact sums, components by rows and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    largest: int
    identity_error: float | None
    passes: int
    expanded: bool

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry, in 64 bits (values beyond are held at their ends)."""
    top = float(1 << 63)
    return F.transform(vector, lambda c: F.when(c.cast("double") * scale >= top, F.lit((1 << 63) - 1)).when(c.cast("double") * scale < -top, F.lit(-(1 << 63))).otherwise(F.floor(c.cast("double") * scale)).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all are finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def vectors(rows: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``rows`` with a usable vector, their whole numbers as _x.

    All rows must have one length: that of most usable rows (ties: the longer); a shorter or longer vector counts as one that lacks entries, and is dropped.
    """
    own = F.col(f"`{column}`")
    good = rows.where(usable(own))
    sizes = good.groupBy(F.size(own).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    d = sizes[0]["size"] if sizes else 0
    return good.where(F.size(own) == d).withColumn("_x", whole(own, scale))


def _matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray | None:
    """The sum over all rows of ``of(batch of vectors)``, an array of ``kind`` (long or double); None without rows."""
    arrow = pa.int64() if kind == "long" else pa.float64()

    def give(total):
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(arrow))], names=["part"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = of(_matrix(batch.column(0)))
                total = got if total is None else total + got
        yield from give(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(0):
                got = part.values.to_numpy()
                total = got if total is None else total + got
        yield from give(total)

    parts = rows.select("_x").mapInArrow(each, f"part array<{kind}>").repartition(REDUCERS).mapInArrow(add, f"part array<{kind}>").collect()  # REDUCERS rows at most
    got = [np.array(r["part"], object if kind == "long" else np.float64) for r in parts]
    return sum(got[1:], got[0]) if got else None


def _halves(x: np.ndarray) -> np.ndarray:
    """Count, and exact sums of high and low words: none of these leaves 64 bits."""
    return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])


def _product(mean: np.ndarray, basis: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    def of(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return np.concatenate([[np.square(centred).sum()], (centred.T @ (centred @ basis)).ravel()])

    return of


def _ritz(basis: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and vectors (by columns) of the basis, falling, and the angle bound of the first k."""
    small = basis.T @ product
    values, inner = np.linalg.eigh((small + small.T) / 2)
    values, inner = values[::-1], inner[:, ::-1]
    found = basis @ inner
    residual = np.linalg.norm(product @ inner - found * values, axis=0)
    gap = np.full(len(values), np.inf)
    if len(values) > 1:
        step = values[:-1] - values[1:]
        gap[:-1], gap[1:] = step, np.minimum(gap[1:], step)
        gap[0] = step[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.where(residual == 0, 0.0, residual / gap)
    return values, found, angle[:k]


def fit(held: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, angle: float = ANGLE, seed: int = 1) -> Model | None:
    """The leading eigenvectors of the covariance of ``held`` (_x), a saved table of distinct vectors; None if it is empty."""
    sums = _summed(held, _halves, "long")
    if sums is None:
        return None
    n, d = int(sums[0]), (len(sums) - 1) // 2
    total = [int(a) * (1 << 32) + int(b) for a, b in zip(sums[1 : d + 1], sums[d + 1 :], strict=True)]
    mean = np.array([float(Fraction(s, n)) for s in total])
    largest = held.agg(F.max(F.greatest(F.array_max("_x"), F.bitwise_not(F.array_min("_x"))))).first()[0] + 1
    k = min(components, d)
    width = min(k + oversampling, d)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    done, last, expanded = 0, np.inf, width == d
    while True:
        got = _summed(held, _product(mean, basis), "double") / n
        trace, product = got[0], got[1:].reshape(d, -1)
        done += 1
        values, found, bound = _ritz(basis, product, k)
        worst = bound.max()
        if worst <= angle or expanded:
            break
        rate = worst / last if last else 0.0
        last = worst
        if done >= passes or (done > 2 and not worst * rate ** (passes - done) <= angle):
            # the full dimension: the leading vectors so far, and what is orthogonal to them
            basis, expanded = np.linalg.qr(np.concatenate([found, np.eye(d)], axis=1))[0], True
        else:
            basis = np.linalg.qr(product)[0]
    values, vectors_ = values[:k], found[:, :k].T
    values = np.where(values > 1e-12 * max(trace, 0.0), values, 0.0)  # rounding of a covariance without further rank
    some = values > 0
    error = None
    if some.any():
        scaled = vectors_[some] / np.sqrt(values[some])[:, None]
        own = _summed(held, lambda x: (lambda w: np.concatenate([w.sum(axis=0), (w.T @ w).ravel()]))((x - mean) @ scaled.T), "double") / n
        m = own[: some.sum()]
        error = float(np.abs(own[some.sum() :].reshape(len(m), -1) - np.outer(m, m) - np.eye(len(m))).max())
    return Model(n, tuple(total), vectors_, values, float(trace), int(largest), error, done, expanded)


def _whitener(model: Model):
    n, sums, d = model.n, model.sums, len(model.sums)
    mean = model.mean
    scale = [np.sqrt(v) if v > 0 else None for v in model.values]
    explained = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]
    # whether (n*x - S)^2 summed over dimensions stays in 64 bits
    narrow = d * (n * model.largest + max(map(abs, sums))) ** 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(scale)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            if narrow:
                deviation = np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
            else:
                exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
                deviation = [v if v < 1 << 63 else None for v in exact]
            centred = x - mean
            white = np.stack([centred @ u / s if s else np.full(len(x), np.nan) for u, s in zip(model.components, scale, strict=True)], axis=1)
            rows = np.repeat(np.arange(len(x)), k)
            number = np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(number + 1, pa.int32()),
                    pa.array([n] * len(rows), pa.int64()),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel())),
                    pa.array([explained[i] for i in number], pa.float64()),
                    pa.array([model.identity_error] * len(rows), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, **parameters) -> DataFrame:
    """For each usable row of ``rows`` (vec_id, ``column``) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows without a usable vector are dropped (``usable``, ``vectors``); repeated rows stay, and count once in the fit; vec_id may be
    null.  Vectors of fewer dimensions than ``components`` give as many components as dimensions.  A component without variance (fewer
    distinct vectors than components) has a null whitened and explained 0; identity_error is over the others, null if there are none.  deviation is null where it
    leaves 64 bits.  An empty table gives an empty one; other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    x = vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("embedding")), "embedding").select("vec_id", "_x")
    held = scratch.save(x.select("_x").distinct())
    model = fit(held, components, **parameters)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return spark.createDataFrame([], out) if model is None else x.mapInArrow(_whitener(model), out)
