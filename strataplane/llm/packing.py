"""Best-fit decreasing packing of token sequences.

Best-fit decreasing looks at piece lengths only, and there are at most
``size`` of those.  So the driver gets the histogram of lengths (at most
``size`` rows at any data size) and packs it in runs: a run is many pieces of one
length that go to consecutive bins of one remaining capacity.  A segment tree
over remaining capacities finds the tightest open bins.  The runs are a small
table; each piece finds its bin and place by its rank among pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataplane.llm.common import Scratch

SIZE = 2048
#: Parts that ranks are counted in, so that no length's pieces meet in one task.
PARTS = 4096
END_ID = 0


class CapacityTree:
    """Over capacities 0..size: finds the smallest capacity >= c that has open bins, in logarithmic time."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, has: bool) -> None:
        at = capacity + self.leaves
        self.open[at] = has
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, capacity: int) -> int | None:
        at = capacity + self.leaves
        if self.open[at]:
            return capacity
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, count, bins_from, per_bin, offset) of best-fit decreasing.

    Pieces first .. first+count-1 of a length, in rank order, go ``per_bin`` to
    a bin, to bins from ``bins_from`` on, at ``offset`` and after each other.
    Deterministic; equal to placing pieces one by one in order of length.
    """
    tree = CapacityTree(size)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_bins.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, have = size, bins, -(-left // (size // length))
                bins += have
            else:
                first, have = open_bins[capacity].pop()
                if not open_bins[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            full = min(have, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, size - capacity))
                put(capacity - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            used = full
            if left and full < have:  # the last pieces of this length share one bin
                runs.append((length, rank, left, first + full, left, size - capacity))
                put(capacity - left * length, first + full, 1)
                left, used = 0, full + 1
            put(capacity, first + used, have - used)
    return runs


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible bytes stand for themselves, others for 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE file of the tokenizers library, read on the driver.

    Merges must be listed by id, as they are where ids are ranks; then merging
    by lowest rank gives the same ids as that library.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    symbol = _byte_of_symbol()
    ranks = {bytes(symbol[c] for c in token): i for token, i in model["vocab"].items() if all(c in symbol for c in token)}
    at = 256
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        if model["vocab"][a + b] != at:
            raise ValueError(f"merge {a} {b} is not listed by id")
        at += 1
    return {t: i for t, i in ranks.items() if i < at}


def load_added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the same file: literals that stand for one id wherever a text holds them."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that depend on what stands around them are not read")
    return {t["content"]: t["id"] for t in added}


def pieces_of(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than ``size``."""
    if n <= size:
        return [(0, n)]
    head = (n - 1) % size + 1
    return [(0, head)] + [(s, size) for s in range(head, n, size)]


def _piece_maker(shared, added: dict[str, int], pattern: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=shared.value, special_tokens=added).encode_to_numpy
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(ids, texts, strict=True):
                got = encode(text.as_py() or "", allowed_special="all").astype("<u4")
                got = np.append(got, np.uint32(END_ID)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(got), size)):
                    doc.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(got[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row of ``docs``; a null text counts as empty, one END_ID."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))  # the vocabulary: about 50,000 entries
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_piece_maker(shared, load_added_tokens(vocabulary), pattern, size), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Repeated rows are packed as often as they occur.  An empty table gives an
    empty one.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")
    held = scratch.save(pieces.withColumn("part", part))
    counts = scratch.save(held.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    runs = best_fit(histogram, size)
    table = spark.createDataFrame(runs, "length long, first long, count long, bins_from long, per_bin long, run_offset long")
    # ranks: within (length, part) by row_number, before it by the parts' counts
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ahead = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("ahead"))
    order = W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = held.withColumn("r", F.row_number().over(order) - 1).join(ahead, ["length", "part"]).withColumn("rank", F.col("ahead") + F.col("r")).drop("ahead", "r", "part")
    # each length has few runs (one for each capacity it meets): an array of them, looked up by rank
    lists = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "count", "bins_from", "per_bin", "run_offset"))).alias("runs"))
    found = ranked.join(F.broadcast(lists), "length").withColumn("x", F.element_at(F.filter("runs", lambda x: F.col("rank").between(x["first"], x["first"] + x["count"] - 1)), 1))
    k = F.col("rank") - F.col("x.first")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("x.bins_from") + F.floor(k / F.col("x.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("x.run_offset") + (k % F.col("x.per_bin")) * F.col("length")).cast("long").alias("offset"),
    )
