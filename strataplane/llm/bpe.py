"""Byte-level BPE encoding and decoding.

A match of the split pattern starts as single bytes.  A segment tree over byte
positions holds, for each live position, the rank of the pair that starts
there; its root is the leftmost pair of least rank.  A merge changes three
leaves: the merged pair's own, its right part's and its left neighbour's, each
a logarithmic point update.  Many short matches are merged together, one array
row each; single long ones by the same tree over lists.  Each distinct match is
merged once while it stays in a worker's bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct matches that a worker keeps; beyond that it starts anew.
CACHE_MATCHES = 300_000
#: Characters of text that are split at once.
CHUNK_CHARS = 2_000_000
NONE = np.int64(1) << np.int64(62)
SHIFT = np.int64(24)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number; read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Merges byte strings by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        codes = np.array(sorted(found), dtype=np.int64)
        self.pair = np.append(codes, NONE)
        self.pair_rank = np.append(np.array([found[c] for c in codes.tolist()], dtype=np.int64), 0)

    def _key(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values: rank and position of the pair, or NONE."""
        code = left << np.int64(32) | right
        i = np.searchsorted(self.pair, code)
        return np.where(self.pair[i] == code, self.pair_rank[i] << SHIFT | at, NONE)

    def many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray | None] = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()) if w else 2, []).append(i)
        for width, members in groups.items():
            most = max(1, (1 << 19) // width)
            for a in range(0, len(members), most):
                part = members[a : a + most]
                if len(part) < 24:
                    for i in part:
                        out[i] = self.one(words[i])
                else:
                    for i, ids in zip(part, self._rows([words[i] for i in part], width), strict=True):
                        out[i] = ids
        return out

    def _rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n = np.array([len(w) for w in words], dtype=np.int64)
        rows, cols = len(words), np.arange(width, dtype=np.int64)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(rows, width)
        token = np.full((rows, width + 1), -1, dtype=np.int64)
        token[:, :width] = np.where(cols < n[:, None], self.byte[raw], -1)
        after = np.tile(np.arange(1, width + 2, dtype=np.int64), (rows, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int64), (rows, 1))
        live = np.zeros((rows, width + 1), dtype=bool)
        live[:, :width] = cols < n[:, None]
        tree = np.full((rows, 2 * width), NONE)
        pairs = cols[None, :-1] + 1 < n[:, None]
        key = self._key(token[:, : width - 1], token[:, 1:width], cols[None, :-1])
        tree[:, width : 2 * width - 1] = np.where(pairs, key, NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        flat = tree.reshape(-1)
        act = np.arange(rows)
        while True:
            act = act[tree[act, 1] < NONE]
            if not len(act):
                break
            root = tree[act, 1]
            i, rank = root & ((np.int64(1) << SHIFT) - 1), root >> SHIFT
            j = after[act, i]
            k = after[act, j]
            token[act, i], after[act, i], before[act, np.minimum(k, width)], live[act, j] = rank, k, i, False
            end = k >= n[act]
            right = np.where(end, NONE, self._key(rank, token[act, np.minimum(k, width)], i))
            h = before[act, i]
            left = np.where(h >= 0, self._key(token[act, np.maximum(h, 0)], rank, h), right)
            base = act * (2 * width)
            for leaf, value in ((j, NONE), (i, right), (np.where(h >= 0, h, i), left)):
                at = leaf + width
                flat[base + at] = value
                at = at >> 1
                while at[0]:
                    flat[base + at] = np.minimum(flat[base + 2 * at], flat[base + 2 * at + 1])
                    at = at >> 1
        return [token[r][live[r]] for r in range(rows)]

    def one(self, word: bytes) -> np.ndarray:
        """Ids of one word, by the tree over lists."""
        n, ranks, longest = len(word), self.ranks, self.longest
        size = max(2, 1 << max(0, n - 1).bit_length())
        none = 1 << 62
        after, before, live = list(range(1, n + 2)), list(range(-1, n)), [True] * n

        def value(i: int) -> int:
            j = after[i]
            if j >= n:
                return none
            e = after[j]
            rank = ranks.get(word[i:e]) if e - i <= longest else None
            return none if rank is None else rank << 32 | i

        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = value(i)
        for at in range(size - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def put(i: int, v: int) -> None:
            at = size + i
            tree[at] = v
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                tree[at] = a if a < b else b
                at >>= 1

        while tree[1] < none:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            after[i], live[j] = k, False
            if k < n:
                before[k] = i
            put(j, none)
            put(i, value(i))
            if before[i] >= 0:
                put(before[i], value(before[i]))
        return np.array([ranks[word[i : after[i]]] for i in range(n) if live[i]], dtype=np.int64)


class Encoder:
    """Splits texts by a pattern and encodes each match."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = CACHE_MATCHES):
        import regex

        self.merger, self.split, self.most = Merger(ranks), regex.compile(pattern).findall, most
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        matches = [self.split(t) for t in texts]
        new: set[str] = set()
        for m in matches:
            new.update(m)
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
        known = self.cache
        missing = [m for m in new if m not in known]
        raw = [m.encode("utf-8") for m in missing]
        whole = self.merger.ranks
        rest = []
        for m, r in zip(missing, raw, strict=True):
            if r in whole:
                known[m] = whole[r].to_bytes(4, "little")
            else:
                rest.append((m, r))
        for (m, _), ids in zip(rest, self.merger.many([r for _, r in rest]), strict=True):
            known[m] = ids.astype("<u4").tobytes()
        return [b"".join([known[m] for m in found]) for found in matches]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.merger.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_encoders: dict[tuple, Encoder] = {}


def _share(spark, vocabulary: str) -> tuple:
    """The vocabulary (about 50,000 entries) as a broadcast, and a digest of it."""
    ranks = load_ranks(vocabulary)
    digest = hashlib.sha256()
    for token, rank in sorted(ranks.items()):
        digest.update(b"%d:%d:%b" % (rank, len(token), token))
    return spark.sparkContext.broadcast(ranks), digest.hexdigest()


def _encoder(shared: tuple, pattern: str) -> Encoder:
    """One encoder a worker process, kept between tasks; another vocabulary or pattern takes its place."""
    ranks, digest = shared
    key = (digest, pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value, pattern)
    return _encoders[key]


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters; every text is whole."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def _round_trip(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for part in chunks([t or "" for t in batch.column(1).to_pylist()]):
                for ids in coder.encode(part):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _tokens(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared, pattern)
        for batch in batches:
            flat = [ids for part in chunks([t or "" for t in batch.column(1).to_pylist()]) for ids in coder.encode(part)]
            ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in flat])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(flat), dtype="<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row of ``docs``; a null or empty text has no ids.  Other columns are ignored."""
    shared = _share(docs.sparkSession, vocabulary)
    return _rows(docs).mapInArrow(_tokens(shared, pattern), "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, content binary) of each row of (doc_id, ids); a null array has no bytes."""
    shared = _share(rows.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared, pattern)
        for batch in batches:
            out = [coder.decode(np.array(ids or [], dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs``: encoded and decoded again.

    A null or empty text has no ids.  Rows are independent, so repeated rows
    repeat.  Other columns are ignored.
    """
    shared = _share(docs.sparkSession, vocabulary)
    return _rows(docs).mapInArrow(_round_trip(shared, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
