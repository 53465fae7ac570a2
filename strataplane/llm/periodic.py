"""Periodic runs of words by bit-parallel lags.

The words of a text get small numbers, and each bit of the numbers is a plane: one big integer with a bit for every place.  For a lag p, each plane
is XORed with itself shifted by p; the OR of these marks the places whose word differs from the one p further.  Stretches of t places
without a mark are isolated by AND with shifted copies, with shifts that double.  A stretch of m places is a run of m + p words with
period p.

Lags that no run can have are left out first.  The stretch of a run of period p has at least m = max(p, 6) places (a run has
12 words and 2p at least), so it holds a multiple kp, and reaches (m+1)/2 or more places from there on or back.  So
a window of any w <= (m+2)//2 words that begins at kp, or one that ends there, equals that at (k+1)p.  The windows' hashes
tell for all lags in O(n log n); equal hashes only let a lag be looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run.
LEAST = 12
#: Pairs of places that are compared at a time.
PAIRS = 1 << 20
_MIX, _HIGH, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(29), np.uint64(32)


def planes(ids: np.ndarray) -> list[int]:
    """Bit planes of numbers, lowest first: bit i of plane b is bit b of ids[i]."""
    top = int(ids.max(initial=0))
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(top.bit_length())]


def stretches(bits: int, least: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the maximal stretches of at least ``least`` set bits."""
    have = 1
    while bits and have < least:
        step = min(have, least - have)
        bits &= bits >> step
        have += step
    if not bits:
        return []
    # a set bit now begins ``least`` set bits
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() + 7 >> 3, "little"), np.uint8), bitorder="little"))
    gaps = np.flatnonzero(np.diff(ones) > 1)
    first, last = ones[np.concatenate([[0], gaps + 1])], ones[np.concatenate([gaps, [len(ones) - 1]])]
    return list(zip(first.tolist(), (last + least).tolist(), strict=True))


def lags(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place), by lag: pairs of equal windows at places kp and (k+1)p; a lag without any has no run."""
    n = len(ids)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    w, window = 1, (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    p, top = 1, n // 2
    while p <= top:
        while 4 * w <= max(p, (least + 1) // 2) + 2 and 2 * w <= n:
            window = (window[:-w] ^ (window[:-w] >> _HIGH)) * _MIX + (window[w:] ^ (window[w:] >> _LOW))
            w *= 2
        end = min(top, max(p, 4 * w - 3)) if 2 * w <= n else top  # the lags of this window
        # windows that reach over an end of the text get values of their own
        own = np.concatenate([np.arange(w, dtype=np.uint64), window, np.arange(w, 3 * w, dtype=np.uint64)])
        while p <= end:
            counts = (n - 1) // np.arange(p, end + 1)
            counts = counts[: max(1, int(np.searchsorted(np.cumsum(counts), PAIRS, "right")))]
            period = np.repeat(np.arange(p, p + len(counts)), counts)
            place = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
            other = place + period
            hit = np.flatnonzero((own[place + w] == own[other + w]) | (own[place + 1] == own[other + 1]))
            if len(hit):
                found.append((period[hit], place[hit]))
            p += len(counts)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lag, place = (np.concatenate(x) for x in zip(*found, strict=True))
    return lag, place


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``ids``, by start and period.

    A run is a maximal stretch with smallest period p, of at least max(``least``, 2p) words.  A lag that is a multiple of the
    smallest period gives the same stretch again, which the smaller lag has claimed.
    """
    n = len(ids)
    if n < least:
        return []
    lag, place = lags(ids, least)
    if not len(lag):
        return []
    own, claimed, out = planes(ids), set(), []
    long_runs: list[tuple[int, int, int]] = []  # by falling length: (start, end, period) of those that hold 4 periods
    heads = np.flatnonzero(np.concatenate([[True], lag[1:] != lag[:-1]]))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(lag)], strict=True):
        p, left = int(lag[a]), place[a:b]
        for s, e, q in long_runs:
            if e - s < 2 * p or not len(left):
                break
            if p % q == 0:  # pairs of places inside such a run tell of that run only
                left = left[(left < s) | (left + p >= e)]
        if not len(left):
            continue
        differs = 0
        for plane in own:
            differs |= plane ^ (plane >> p)
        for s, e in stretches(~differs & ((1 << (n - p)) - 1), max(p, least - p)):
            if (s, e + p) not in claimed:
                claimed.add((s, e + p))
                out.append((s, e + p - s, p))
                if e + p - s >= 4 * p:
                    long_runs.append((s, e + p, p))
        long_runs.sort(key=lambda r: r[0] - r[1])
    return sorted(out, key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """For each of n words, whether a run holds it after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, m, p in runs:
        edge[s + p] += 1
        edge[s + m] -= 1
    return np.cumsum(edge[:-1]) > 0


def _finder(least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for text in batch.column(1):
                own = _words(text.as_py() or "")
                got = find_runs(pc.dictionary_encode(pa.array(own, pa.string())).indices.to_numpy().astype(np.int64), least) if len(own) >= least else []
                runs.append([{"start": s, "length": m, "period": p} for s, m, p in got])
                kept.append(" ".join(w for w, x in zip(own, dropped(len(own), got), strict=True) if not x) if got else " ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    return run


def _words(text: str) -> list[str]:
    return re.findall("[^\\x20\\x09-\\x0d]+", text)


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed) of each row of ``docs`` (doc_id, text).

    Runs are those of ``find_runs``, in word numbers from 0; collapsed is the text's words without those that repeat a run's first period,
    joined by one space.  A null or empty text has no runs and an empty collapsed text.  Rows stay as often as they occur, ids may be null, other columns are not read.
    Texts are whole; a text is worked on in one task, with O(n log n) for the lags and n/64 steps for each plane of a lag that is looked at.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _finder(least), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def longest(runs: Column) -> Column:
    """The run of greatest length (then smallest start, then smallest period); null without runs."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(key)


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
