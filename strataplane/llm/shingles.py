"""Vectorised word-shingle sets over UTF-8 bytes.

One batch of texts becomes one byte buffer.  Words are maximal runs of bytes
outside ``\\x20\\x09-\\x0D``; A-Z counts as a-z.  A word's 64-bit value is a
polynomial over random byte values modulo 2**64, so all words of a batch come
out of one cumulative sum; a shingle's value mixes the values of its words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Bytes that are hashed at once; a longer word is hashed whole.
SEGMENT = 1 << 18
#: Bytes of texts that are taken together; a longer text is taken alone.
GROUP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array; wraps silently."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15 >> 3))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for reuse."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, n.bit_length())
        with np.errstate(over="ignore"):
            have = np.concatenate([np.ones(1, U), np.full(size - 1, base & _MASK, U)])
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def word_values(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, ends) of the words of ``blob``, in order."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    values = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):  # a word's value depends on its own bytes only, so runs of words are hashed apart
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        part = raw[starts[i] : ends[j - 1]]
        begin, end = starts[i:j] - starts[i], ends[i:j] - starts[i]
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, dtype=U)
            np.cumsum(_BYTE[part] * _power(_BASE, len(part)), out=total[1:])
            value = (total[end] - total[begin]) * _power(_INVERSE, len(part))[begin]
            values[i:j] = mix(value + (end - begin).astype(U))
        i = j
    return values, starts, ends


def shingle_sets(texts: list[str | None], width: int = 3) -> list[np.ndarray]:
    """For each text, the sorted distinct values of its ``width``-word shingles.

    A text of fewer words is one shingle of all of them; a null, empty or
    blank text has the empty set.
    """
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        if not group:
            return
        sizes = np.array([len(b) + 1 for b in group])
        values, starts, _ = word_values(b"\n".join(group) + b"\n")
        cut = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(values), dtype=U)
            for i in range(min(width, len(values))):
                rolled[: len(values) - i] += mix(values[i:] + U(i * 0x632BE59BD9B4E019 & _MASK))
            rolled = mix(rolled)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a >= width:
                    out.append(np.unique(rolled[a : b - width + 1]))
                elif b > a:
                    short = U((b - a) * 0xD6E8FEB86659FD93 & _MASK)
                    for v in values[a:b]:
                        short = mix(np.array([short * U(3) + v]))[0]
                    out.append(np.array([short]))
                else:
                    out.append(np.empty(0, U))
        group.clear()

    for b in blobs:
        if held + len(b) > GROUP:
            flush()
            held = 0
        group.append(b)
        held += len(b)
    flush()
    return out
