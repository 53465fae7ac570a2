"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens.  Every round has a quantum for each queue, its share of a window of ``size`` tokens in units
of 1/UNIT token; a queue adds the quantum to its deficit counter and serves whole tokens while the counter covers them, and the
rest of a token is carried to the next round.  A queue that runs dry leaves, and the others share the window from the next round on.
Windows are cut from the stream of rounds without gaps, so only the last one is short.  What a queue has served after k
rounds is the whole part of its summed quanta, so a window holds its share within one token and the
tokens by which the rounds so far fell short (less than one for each queue).

The counters after any round follow from the queues' totals, so partitions need not wait for each other: each knows how many tokens
its queues hold in the partitions before it, and finds the rounds of its documents from there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataplane.llm.common import BROADCAST_BYTES, Scratch
from strataplane.llm.packing import SIZE, load_added_tokens, load_vocabulary

END_ID = 1
#: Deficits are counted in units of 1/UNIT token; totals of up to 2**47 tokens stay in 64 bits.
UNIT = 1 << 16
#: Queues at most; sources beyond share the last one.
QUEUES = 64
#: (document, round) rows that are cut at a time.
BLOCK = 1 << 14


class Rounds:
    """The deficit counters of all queues after any number of rounds.

    ``totals``: tokens of each queue; ``weights``: whole numbers, shares relative to the queues that are not dry.
    Between the rounds in which a queue runs dry (a phase) the quanta are constant.
    """

    def __init__(self, totals: list[int], weights: list[int], size: int = SIZE):
        start, credits, quanta = [], [], []
        credit, k = [0] * len(totals), 0
        active = [q for q, t in enumerate(totals) if t]
        while active:
            whole = sum(weights[q] for q in active)
            quantum = [0] * len(totals)
            for q in active:
                quantum[q] = max(1, size * UNIT * weights[q] // whole) if whole else size * UNIT // len(active)
            start.append(k)
            credits.append(list(credit))
            quanta.append(quantum)
            rounds = min(-((credit[q] - totals[q] * UNIT) // quantum[q]) for q in active)
            k += rounds
            for q in active:
                credit[q] = min(credit[q] + rounds * quantum[q], totals[q] * UNIT)
            active = [q for q in active if credit[q] < totals[q] * UNIT]
        self.totals = np.array(totals, np.int64)
        self.start, self.credit, self.quantum = (np.array(x or [y], np.int64) for x, y in ((start, 0), (credits, [0] * len(totals)), (quanta, [0] * len(totals))))
        self.rounds = k

    def served(self, k: np.ndarray) -> np.ndarray:
        """(len(k), queues): tokens that each queue has served before round k."""
        phase = np.searchsorted(self.start, k, "right") - 1
        return np.minimum((self.credit[phase] + (k - self.start[phase])[:, None] * self.quantum[phase]) // UNIT, self.totals)

    def round_of(self, q: int, token: np.ndarray) -> np.ndarray:
        """The rounds that serve the tokens with these numbers of queue ``q``."""
        need = (token + 1) * UNIT
        phase = np.searchsorted(self.credit[:, q], need, "left") - 1
        return self.start[phase] - (self.credit[phase, q] - need) // self.quantum[phase, q] - 1

    def place(self, q: np.ndarray, first: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Pieces (row, start, length, sequence, offset) of rows that hold tokens first .. first+n-1 of queues ``q``."""
        lo, hi = np.empty_like(first), np.empty_like(first)
        for x in np.unique(q):
            of = q == x
            lo[of], hi[of] = self.round_of(x, first[of]), self.round_of(x, first[of] + n[of] - 1)
        found = []
        few = hi - lo < n  # else most rounds serve nothing of the queue: tokens are fewer
        spans = np.where(few, hi - lo + 1, n)
        border = np.searchsorted(np.cumsum(spans), np.arange(BLOCK, max(int(spans.sum()), 1) + BLOCK, BLOCK), "left") + 1
        at = 0
        for to in np.unique(np.minimum(border, len(q))):
            own = np.arange(at, to)
            at = to
            row = np.repeat(own, spans[own])
            step = np.arange(len(row)) - np.repeat(np.cumsum(spans[own]) - spans[own], spans[own])
            k = lo[row] + step
            for i in own[~few[own]]:
                k[row == i] = self.round_of(q[i], first[i] + np.arange(n[i]))
            keep = np.concatenate([[True], (row[1:] != row[:-1]) | (k[1:] != k[:-1])]) if len(row) else np.zeros(0, bool)
            found.append(self._cut(row[keep], k[keep], q, first, n, size))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))

    def _cut(self, row, k, q, first, n, size):
        before, after = self.served(k), self.served(k + 1)
        line = np.arange(len(row))
        own = q[row]
        begin = np.maximum(first[row], before[line, own])
        end = np.minimum(first[row] + n[row], after[line, own])
        # in the stream: earlier rounds, then this round's earlier queues, then the queue's own tokens
        ahead = np.cumsum(after - before, axis=1)[line, own] - (after - before)[line, own]
        pos = before.sum(axis=1) + ahead + begin - before[line, own]
        some = end > begin
        row, begin, end, pos = row[some], begin[some], end[some], pos[some]
        # pieces that follow each other in the stream are one
        joins = np.concatenate([[False], (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + (end - begin)[:-1])]) if len(row) else np.zeros(0, bool)
        heads = np.flatnonzero(~joins)
        length = np.add.reduceat(end - begin, heads) if len(heads) else np.zeros(0, np.int64)
        row, begin, pos = row[heads], begin[heads] - first[row[heads]], pos[heads]
        # and are cut where a window ends
        parts = (pos + length - 1) // size - pos // size + 1
        of = np.repeat(np.arange(len(row)), parts)
        window = pos[of] // size + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.maximum(pos[of], window * size)
        right = np.minimum(pos[of] + length[of], (window + 1) * size)
        return row[of], begin[of] + left - pos[of], right - left, window, left - window * size


def _reader(shared, added: dict[str, int], pattern: str, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=shared.value, special_tokens=added).encode_to_numpy
        part = TaskContext.get().partitionId()
        held: dict[int, int] = {}
        for batch in batches:
            queues, texts = batch.column(1).to_pylist(), batch.column(2)
            ids, n, before = [], [], []
            for queue, text in zip(queues, texts, strict=True):
                got = np.append(encode(text.as_py() or "", allowed_special="all"), np.uint32(END_ID)).astype(width)
                ids.append(got.tobytes())
                n.append(len(got))
                before.append(held.get(queue, 0))
                held[queue] = before[-1] + len(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "queue", "part", "n", "before", "ids"],
            )

    return run


def _cutter(rounds: Rounds, size: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, first, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            row, start, length, window, offset = rounds.place(q, first, n, size)
            ids, own, crc = batch.column(4), -1, []
            for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                if r != own:
                    own, text = r, np.frombuffer(ids[r].as_buffer(), width).astype("<u4")
                crc.append(zlib.crc32(text[s : s + m]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[row], window, offset))],
                names=["doc_id", "queue", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def named_queues(docs: DataFrame, source: str, queues: int = QUEUES) -> list[str]:
    """The ``queues`` - 1 sources with most rows (ties: by name), which get queues of their own; at most so many come to the driver."""
    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    return [r["name"] for r in docs.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(queues - 1).collect()]


def pack(docs: DataFrame, vocabulary: str, pattern: str, targets: dict[str, float] | None = None, source: str = "source", size: int = SIZE, queues: int = QUEUES) -> DataFrame:
    """Pieces (doc_id, queue, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``docs`` (doc_id, text, ``source``).

    ``targets``: proportions of tokens of named sources, 1 in all at most; the other sources share one queue, which gets the
    rest.  Without it, the ``queues`` - 1 sources with most rows have a queue each, the others share one, and each queue gets its share of all tokens.
    Documents of a queue follow each other as they are stored.  A null text counts as empty (END_ID alone), a null source as ''.
    Repeated rows are packed as often as they occur; an empty table gives an empty one; other columns are not read.
    """
    if targets is not None and (min(targets.values(), default=0) < 0 or sum(targets.values()) > 1 + 1e-9):
        raise ValueError("proportions are at least 0 and 1 in all at most")
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixture")
    ranks, added = load_vocabulary(vocabulary), load_added_tokens(vocabulary)
    width = "<u2" if max([END_ID, *ranks.values(), *added.values()]) < 1 << 16 else "<u4"
    names = list(targets) if targets is not None else named_queues(docs, source, queues)
    number = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    index = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)]) if names else F.create_map().cast("map<string,int>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.try_element_at(index, number), F.lit(len(names))).alias("queue"), F.col("text").cast("string").alias("text"))
    # ids are kept as bytes, so documents are encoded once; before counts the queue's tokens ahead in the same partition
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary: about 50,000 entries
    held = scratch.save(rows.mapInArrow(_reader(shared, added, pattern, width), "doc_id long, queue int, part int, n long, before long, ids binary"))
    sums = scratch.save(held.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    totals = [0] * (len(names) + 1)
    for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # a row a queue
        totals[r["queue"]] = r["n"]
    weights = totals
    if targets is not None:
        weights = [round(x * (1 << 40)) for x in (*targets.values(), max(0.0, 1 - sum(targets.values())))]
    rounds = Rounds(totals, weights, size)
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("queue", "part", ahead.alias("ahead"))
    small = sums.count() * 32 <= BROADCAST_BYTES
    placed = held.join(F.broadcast(base) if small else base, ["queue", "part"]).select("doc_id", "queue", (F.col("ahead") + F.col("before")).alias("first"), "n", "ids")
    return placed.mapInArrow(_cutter(rounds, size, width), "doc_id long, queue int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
