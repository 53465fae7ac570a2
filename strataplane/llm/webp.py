"""Lossless WebP images to and from pixel arrays.

``decode`` reads any lossless image: prefix codes, back-references, colour
cache, grouped codes, and the predictor, cross-colour, subtract-green and
palette transforms.  ``encode`` writes ARGB arrays with given ones of these;
``store_all`` chooses them for payloads, and ``load_all`` reads these back.
Both work on many files together: tokens are read in step, one of each file at
a time, and Huffman trees are joined in step; ``decode`` reads one file by
itself.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np

#: Fixed values of the format.
SIGNATURE = 0x2F
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
MOST_SIDE = 1 << 14
#: Short distance codes: offsets (x, y) to the left or above, nearest first; at equal distance the higher first, then the right one.
NEAR = sorted([(x, 0) for x in range(1, 9)] + [(x, y) for y in range(1, 8) for x in range(-7, 9)], key=lambda o: (o[0] ** 2 + o[1] ** 2, -o[1], -o[0]))
NEAR_OFFSETS = np.array(NEAR)
#: The share of pixels that a colour cache must hold to be used.
CACHE_SHARE = 0.04
#: Code lengths that this encoder uses at most, so that a lane's table stays small.
MOST_BITS = 9


class Bits:
    """Reads least-significant bits first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the image data ends early")
        first, shift = self.at >> 3, self.at & 7
        self.at += n
        return int.from_bytes(self.data[first : first + 5], "little") >> shift & (1 << n) - 1

    def peek(self, at: int, n: int) -> int:
        first = at >> 3
        return int.from_bytes(self.data[first : (at + n + 7) >> 3], "little") >> (at & 7) & (1 << n) - 1


class BitSink:
    """Collects least-significant bits first."""

    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 4096:
            whole = self.n // 8
            self.parts.append((self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def flush(self) -> None:
        """Leaves less than a byte in ``value``."""
        whole = self.n // 8
        if whole:
            self.parts.append((self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def done(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.n + 7) // 8, "little")


def put_each(sinks: list[BitSink], values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
    """Many fields to each of many sinks: ``counts`` of them go to each in turn; each has at most 64 bits."""
    for sink in sinks:
        sink.flush()
    held = np.array([sink.n for sink in sinks])
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    ends = held + total[edges[1:]] - total[edges[:-1]]
    # a sink begins with a word of its own
    room = (ends >> 6) + 2
    first = np.cumsum(room) - room
    at = total[:-1] + np.repeat(64 * first + held - total[edges[:-1]], counts)
    word, off = at >> 6, (at & 63).astype(np.uint64)
    words = np.zeros(int(room.sum()), dtype=np.uint64)
    if len(at):
        edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[edge]] = np.bitwise_or.reduceat(values << off, edge)
        over = np.flatnonzero((at & 63) + sizes > 64)
        words[word[over] + 1] |= values[over] >> (np.uint64(64) - off[over])
    words[first] |= np.array([sink.value for sink in sinks], dtype=np.uint64)
    data = words.tobytes()
    for sink, a, n in zip(sinks, (8 * first).tolist(), ends.tolist(), strict=True):
        whole = n // 8
        sink.parts.append(data[a : a + whole])
        sink.n = n % 8
        sink.value = data[a + whole] & (1 << sink.n) - 1


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Huffman code length of each symbol in each row of counts, at most ``most``; a single symbol has length 0.  Rows are worked on in step."""
    lengths = np.zeros(counts.shape, np.int64)
    rows = np.flatnonzero((counts > 0).sum(axis=1) > 1)
    shift = 0
    while len(rows):
        c = counts[rows]
        found = _depths(np.where(c > 0, (c >> shift) + 1 if shift else c, 0))
        lengths[rows] = found
        rows = rows[found.max(axis=1) > most]
        shift += 2
    return lengths


def _depths(weights: np.ndarray) -> np.ndarray:
    """Depth of each symbol in the Huffman tree of its row; weight 0 is none, and each row has two symbols at least."""
    n = weights.shape[1]
    used = (weights > 0).sum(axis=1)
    # rows with the most symbols first, so that those which still join are a prefix
    by_size = np.argsort(-used, kind="stable")
    weights, used = weights[by_size], used[by_size]
    rows, none = len(weights), 1 << 60
    width = int(used[0])
    leaves = np.sort(np.where(weights > 0, weights << 12 | np.arange(n), none), axis=1)[:, :width]
    symbols = leaves & 4095
    # leaves and joined nodes both come in rising order, so the two least are at their heads; behind them stands what is never taken
    stride = width + 1
    weight = np.full((rows, stride), none)
    weight[:, :width] = np.where(np.arange(width) < used[:, None], leaves >> 12, none)
    joined = np.full((rows, stride), 2 * none)
    parent = np.zeros(2 * rows * stride, np.int64)  # of leaves, then of joined nodes
    flat_weight, flat_joined = weight.reshape(-1), joined.reshape(-1)
    leaf, inner = np.arange(rows) * stride, np.arange(rows) * stride
    for new in range(width - 1):
        live = int(np.searchsorted(-used, -(new + 1), side="left"))  # rows of more than new + 1 symbols
        leaf, inner = leaf[:live], inner[:live]
        total = np.zeros(live, np.int64)
        for _ in (0, 1):
            w, q = flat_weight.take(leaf), flat_joined.take(inner)
            is_leaf = w <= q
            parent[np.where(is_leaf, leaf, inner + rows * stride)] = new
            total += np.minimum(w, q)
            leaf = leaf + is_leaf
            inner = inner + ~is_leaf
        joined[:live, new] = total
    of_leaf, of_inner = parent.reshape(2, rows, stride)
    depth = np.zeros((rows, stride), np.int64)
    each = np.arange(rows)
    for at in range(width - 3, -1, -1):
        live = int(np.searchsorted(-used, -(at + 2), side="left"))  # the root is node used - 2
        depth[:live, at] = depth[each[:live], of_inner[:live, at]] + 1
    real = np.arange(width) < used[:, None]
    out = np.zeros((rows, n), np.int64)
    row, column = np.nonzero(real)
    out[by_size[row], symbols[row, column]] = depth[row, of_leaf[row, column]] + 1
    return out


@lru_cache(maxsize=16)
def _reversed_bits(n: int) -> np.ndarray:
    """Each number below 2^n with its n bits in reverse."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(n):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol's code as they are stored, for rows of code lengths (0: none) of at most MOST_BITS."""
    n = lengths.shape[1]
    keys = np.sort(np.where(lengths > 0, lengths << 12 | np.arange(n), 1 << 40), axis=1)
    row, column = np.nonzero(keys < 1 << 40)
    span = np.where(keys < 1 << 40, 1 << MOST_BITS - np.minimum(keys >> 12, MOST_BITS), 0)
    out = np.zeros(lengths.shape, np.uint64)
    out[row, keys[row, column] & 4095] = _reversed_bits(MOST_BITS)[(np.cumsum(span, axis=1) - span)[row, column]]
    return out


def _in_order(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols and their lengths in the order of their codes, and the largest length."""
    s, n = np.array(list(lengths.keys()), dtype=np.int64), np.array(list(lengths.values()), dtype=np.int64)
    order = np.argsort(n << 16 | s)
    return s[order], n[order], int(n[order[-1]])


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bits as they are stored, lengths), in the order of the codes."""
    s, n, most = _in_order(lengths)
    # a code filled up to the largest length is the sum of what the codes before it span
    span = 1 << most - n
    return s, _reversed_bits(most)[np.cumsum(span) - span], n


#: This encoder stores code lengths by one fixed code of four bits each.
USED_LENGTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 16, 17, 18)
LENGTHS_CODE = {s: b for s, b in zip(*(x.tolist() for x in canonical(dict.fromkeys(USED_LENGTHS, 4))[:2]), strict=True)}


def _lengths_head() -> tuple[int, int]:
    value, n = len(CODE_LENGTH_ORDER) - 4 << 1, 5
    for s in CODE_LENGTH_ORDER:
        value |= (4 if s in USED_LENGTHS else 0) << n
        n += 3
    return value, n + 1


#: What goes before the lengths in every stored code: not simple, the code of lengths, all symbols follow; (bits, count).
LENGTHS_HEAD = _lengths_head()


class Code:
    """A prefix code that reads from Bits; a single symbol takes no bits."""

    def __init__(self, lengths: dict[int, int]):
        used = {s: n for s, n in lengths.items() if n}
        if len(used) <= 1:
            self.only = next(iter(used or lengths), 0)
            return
        s, n, self.most = _in_order(used)
        self.only = None
        # by first bit first the table is one run a symbol; its index is read last bit first
        entries = np.repeat(s << 4 | n, 1 << self.most - n)
        if len(entries) != 1 << self.most:
            raise ValueError("a prefix code is not complete")
        self.entries = entries[_reversed_bits(self.most)]

    @cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    def table_mask(self) -> tuple[list[int], int]:
        """Symbol and bits (4) by the next bits of the data, and the mask of these."""
        return (self.table, (1 << self.most) - 1) if self.only is None else ([self.only << 4], 0)

    def channel(self, place: int) -> tuple[list[int], int]:
        """As ``table_mask``, with bits in 6 and the symbol shifted by ``place`` beside them, so that entries of several channels add up."""
        if self.only is not None:
            return [self.only << 6 + place], 0
        return (self.entries >> 4 << 6 + place | self.entries & 15).tolist(), (1 << self.most) - 1

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        first, shift = bits.at >> 3, bits.at & 7
        x = self.table[int.from_bytes(bits.data[first : first + 3], "little") >> shift & (1 << self.most) - 1]
        bits.at += x & 15
        if bits.at > bits.end:
            raise ValueError("the image data ends early")
        return x >> 4


@lru_cache(maxsize=64)
def _meta_code(lengths: int) -> Code:
    """The code of code lengths, from these, three bits each; files of one encoder mostly share it."""
    return Code({s: n for i, s in enumerate(CODE_LENGTH_ORDER) if (n := lengths >> 3 * i & 7)})


def read_lengths(bits: Bits, symbols: int) -> dict[int, int]:
    """The code lengths of one stored prefix code."""
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        out = {first: 1, bits.read(8): 1} if two else {first: 0}
        if max(out) >= symbols:
            raise ValueError("a code holds a symbol outside its alphabet")
        return out
    n = 3 * (4 + bits.read(4))
    if bits.at + n > bits.end:
        raise ValueError("the image data ends early")
    code = _meta_code(bits.peek(bits.at, n))
    bits.at += n
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    out, at, before = {}, 0, 8
    table, mask = code.table_mask()
    # a length and its repeats take at most 14 bits
    first, most = bits.at >> 3, (bits.at & 7) + 14 * symbols
    held, taken = int.from_bytes(bits.data[first : first + (most + 7 >> 3)], "little") >> (bits.at & 7), 0
    while at < symbols and left:
        left -= 1
        x = table[held & mask]
        n, k = x >> 4, x & 15
        if n < 16:
            if n:
                out[at] = before = n
            at += 1
        elif n == 16:
            for _ in range(3 + (held >> k & 3)):
                out[at] = before
                at += 1
            k += 2
        elif n == 17:
            at += 3 + (held >> k & 7)
            k += 3
        else:
            at += 11 + (held >> k & 127)
            k += 7
        held >>= k
        taken += k
    bits.at += taken
    if bits.at > bits.end:
        raise ValueError("the image data ends early")
    if at > symbols:
        raise ValueError("code lengths run past the alphabet")
    return out


def write_lengths(sink: BitSink, lengths: dict[int, int], symbols: int) -> None:
    """Stores a prefix code; its code lengths go by a fixed code of four bits each."""
    names = sorted(lengths)
    if len(names) <= 2 and names[-1] < 256:
        sink.put(1, 1)
        sink.put(len(names) - 1, 1)
        sink.put(1, 1)
        for s in names:
            sink.put(s, 8)
        return
    value, have = LENGTHS_HEAD
    # a single symbol of a large alphabet still needs a length; a second, unused one completes the code
    if len(names) == 1:
        lengths = {names[0]: 1, (names[0] + 1) % symbols: 1}
        names = sorted(lengths)
    at, code = 0, LENGTHS_CODE
    for s in [*names, symbols]:
        gap = s - at
        while gap:
            if gap >= 11:
                n = min(gap, 138)
                value |= (code[18] | n - 11 << 4) << have
                have += 11
            elif gap >= 3:
                n = gap
                value |= (code[17] | n - 3 << 4) << have
                have += 7
            else:
                n = 1
                value |= code[0] << have
                have += 4
            gap -= n
        if s < symbols:
            value |= code[lengths[s]] << have
            have += 4
        at = s + 1
    sink.put(value, have)


# --------------------------------------------------------------------- decoding


def _codes(bits: Bits, cache_bits: int) -> list[Code]:
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    out: list[Code] = []
    before, start = -1, 0
    for n in sizes:
        span = bits.at - start
        # a code that is stored bit by bit as the one before it, for an alphabet of the same size, is that code
        if n == before and bits.at + span <= bits.end and bits.peek(start, span) == bits.peek(bits.at, span):
            start = bits.at
            bits.at += span
            out.append(out[-1])
            continue
        before, start = n, bits.at
        out.append(Code(read_lengths(bits, n)))
    return out


def _head(bits: Bits, width: int, height: int, main: bool) -> tuple[int, int, int, list[int] | None, list[list[Code]]]:
    """What stands before the pixels of an entropy-coded image: cache bits, tile, tiles across, groups by tile and their codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, tile, across = None, 0, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        groups = [p >> 8 & 0xFFFF for p in _pixels(bits, across, -(-height >> tile), False)]
    return cache_bits, tile, across, groups, [_codes(bits, cache_bits) for _ in range(max(groups) + 1 if groups else 1)]


def _pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """One entropy-coded image as ARGB integers."""
    return _read_pixels(bits, width, height, *_head(bits, width, height, main))


def _read_pixels(bits: Bits, width: int, height: int, cache_bits: int, tile: int, across: int, groups: list[int] | None, grouped: list[list[Code]]) -> list[int]:
    """The pixels behind a ``_head``, one after the other."""
    codes = [(g.table_mask(), r.channel(16), b.channel(0), a.channel(24), d.table_mask()) for g, r, b, a, d in grouped]
    total, out = width * height, []
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    (green, gm), (red, rm), (blue, bm), (alpha, am), (distance, dm) = codes[0]
    # bits are taken from the low end of ``held``, ``have`` of them, filled up from ``data``
    data, at = bits.data, bits.at >> 3
    held, have = 0, 0
    if bits.at & 7:
        held, have, at = data[at] >> (bits.at & 7), 8 - (bits.at & 7), at + 1
    from_bytes, append, size = int.from_bytes, out.append, len(data)
    n = 0
    while n < total:
        if have < 64:
            held |= from_bytes(data[at : at + 16], "little") << have
            at += 16
            have += 128
            if at - (have >> 3) > size:
                raise ValueError("the image data ends early")
        if groups is not None:
            y, x = divmod(n, width)
            (green, gm), (red, rm), (blue, bm), (alpha, am), (distance, dm) = codes[groups[(y >> tile) * across + (x >> tile)]]
        s = green[held & gm]
        k = s & 15
        held >>= k
        have -= k
        s >>= 4
        if s < 256:
            r = red[held & rm]
            held >>= r & 63
            b = blue[held & bm]
            held >>= b & 63
            a = alpha[held & am]
            held >>= a & 63
            r += a + b
            have -= r & 63
            append(r >> 6 | s << 8)
            n += 1
        elif s < 256 + LENGTH_CODES:
            s -= 256
            extra = s - 2 >> 1 if s > 3 else 0
            run = (2 + (s & 1) << extra) + (held & (1 << extra) - 1) + 1 if s > 3 else s + 1
            held >>= extra
            s = distance[held & dm]
            k = s & 15
            held >>= k
            s >>= 4
            more = s - 2 >> 1 if s > 3 else 0
            d = (2 + (s & 1) << more) + (held & (1 << more) - 1) + 1 if s > 3 else s + 1
            held >>= more
            have -= extra + k + more
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > n or n + run > total:
                raise ValueError("a back-reference leaves the image")
            if d >= run:
                out += out[n - d : n - d + run]
            else:
                out += (out[n - d :] * (run // d + 1))[:run]
            n += run
        else:
            for p in out[cached:]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
            cached = n
            out.append(cache[s - 256 - LENGTH_CODES])
            n += 1
    bits.at = 8 * at - have
    if bits.at > bits.end:
        raise ValueError("the image data ends early")
    return out


def _average(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _bytes_of(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _of_bytes(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def _clamp(v: int) -> int:
    return 0 if v < 0 else min(v, 255)


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The predicted pixel from the pixels to the left, above, above left and above right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    channels = list(zip(_bytes_of(left), _bytes_of(top), _bytes_of(corner), strict=True))
    if mode == 11:
        return left if sum(abs(t - c) for _, t, c in channels) < sum(abs(x - c) for x, _, c in channels) else top
    if mode == 12:
        return _of_bytes(_clamp(x + t - c) for x, t, c in channels)
    if mode == 13:
        halves = zip(_bytes_of(_average(left, top)), _bytes_of(corner), strict=True)
        return _of_bytes(_clamp(m + int((m - c) / 2)) for m, c in halves)
    return 0xFF000000


def _add(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _subtract(a: int, b: int) -> int:
    return _of_bytes(x - y & 255 for x, y in zip(_bytes_of(a), _bytes_of(b), strict=True))


def _predicted(pixels: list[int], at: int, width: int, tile: int, modes: list[int]) -> int:
    y, x = divmod(at, width)
    if not y:
        return pixels[at - 1] if x else 0xFF000000
    if not x:
        return pixels[at - width]
    mode = modes[(y >> tile) * (-(-width >> tile)) + (x >> tile)] >> 8 & 15
    return predict(mode, pixels[at - 1], pixels[at - width], pixels[at - width - 1], pixels[at - width + 1])


def _signed(v: np.ndarray) -> np.ndarray:
    return ((v & 255) ^ 128).astype(np.int64) - 128


def _cross(pixels: list[int], width: int, height: int, tile: int, factors: list[int], sign: int) -> list[int]:
    """Adds (1) or takes away (-1) what green tells of red, and green and red of blue."""
    p = np.array(pixels, dtype=np.int64).reshape(height, width)
    rows, cols = np.arange(height) >> tile, np.arange(width) >> tile
    f = np.array(factors, dtype=np.int64).reshape(-1, -(-width >> tile))[rows][:, cols]
    red, green, blue = p >> 16 & 255, _signed(p >> 8), p & 255
    new_red = red + sign * (_signed(f) * green >> 5) & 255
    from_red = new_red if sign > 0 else red
    new_blue = blue + sign * ((_signed(f >> 8) * green >> 5) + (_signed(f >> 16) * _signed(from_red) >> 5)) & 255
    return (p & 0xFF00FF00 | new_red << 16 | new_blue).reshape(-1).tolist()


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


#: Extra bits and least value (0 for 1) of the symbols of lengths and distances.
EXTRA = np.array([0] * 4 + [s - 2 >> 1 for s in range(4, DISTANCE_CODES)])
LEAST = np.array([*range(4), *(2 + (s & 1) << (s - 2 >> 1) for s in range(4, DISTANCE_CODES))])
#: Bits of a token that a lane sees at least.
LANE_BITS = 57
#: Images that are read in step at least; fewer are read one by one.
LEAST_LANES = 64
#: Tokens between two looks at which images have ended.
STRIDE = 16


def _fits_lane(head) -> bool:
    """Whether every token of an image fits the bits that a lane sees, so that it can be read in step with others."""
    if head[3] is not None:
        return False
    g, r, b, a, d = (0 if c.only is not None else c.most for c in head[4][0])
    return max(g + r + b + a, g + int(EXTRA[LENGTH_CODES - 1]) + d + int(EXTRA[-1])) <= LANE_BITS


def _tokens_alone(bits: Bits, at: int, n: int, total: int, codes: list[Code]):
    """The tokens of one image from bit ``at`` and pixel ``n`` on, as lists (place, green symbol, value of a literal, run, distance), and the bit behind them."""
    (green, gm), (red, rm), (blue, bm), (alpha, am), (distance, dm) = (c.table_mask() if i in (0, 4) else c.channel(p) for i, (c, p) in enumerate(zip(codes, (0, 16, 0, 24, 0), strict=True)))
    extras, least = EXTRA.tolist(), LEAST.tolist()
    data, first, size = bits.data, at >> 3, len(bits.data)
    held, have, first = (data[first] >> (at & 7) if first < size else 0), 8 - (at & 7), first + 1
    places, symbols, values, runs, far = [], [], [], [], []
    while n < total:
        if have < 64:
            held |= int.from_bytes(data[first : first + 16], "little") << have
            first += 16
            have += 128
            if first - (have >> 3) > size:
                break
        s = green[held & gm]
        held >>= s & 15
        have -= s & 15
        s >>= 4
        places.append(n)
        symbols.append(s)
        if s < 256:
            r = red[held & rm]
            held >>= r & 63
            b = blue[held & bm]
            held >>= b & 63
            a = alpha[held & am]
            held >>= a & 63
            r += a + b
            have -= r & 63
            values.append(r >> 6 | s << 8)
            n += 1
            continue
        values.append(0)
        if s >= 256 + LENGTH_CODES:
            n += 1
            continue
        extra = extras[s - 256]
        runs.append(least[s - 256] + (held & (1 << extra) - 1) + 1)
        held >>= extra
        d = distance[held & dm]
        held >>= d & 15
        more = extras[d >> 4]
        far.append(least[d >> 4] + (held & (1 << more) - 1) + 1)
        held >>= more
        have -= extra + (d & 15) + more
        n += runs[-1]
    return places, symbols, values, runs, far, 8 * first - have


def _tokens(jobs: list, base: np.ndarray, total: np.ndarray, words: np.ndarray, at: np.ndarray, first: np.ndarray):
    """The tokens of many images, the next one of each at a time; what is left of the last few is read one by one.

    Yields literals as (places, values), cache hits as (places, slots), and
    references as (lanes, places, runs, distances); places are among all pixels.
    At the end ``at`` holds the bit behind each image.
    """
    tables, offset, mask, have = [], np.zeros((5, len(jobs)), np.int64), np.zeros((5, len(jobs)), np.int64), 0
    for lane, (_, _, _, _, head) in enumerate(jobs):
        known: dict[int, int] = {}
        for c, code in enumerate(head[4][0]):
            if id(code) not in known:
                known[id(code)] = have
                tables.append(code.entries if code.only is None else np.array([code.only << 4]))
                have += len(tables[-1])
            offset[c, lane] = known[id(code)]
            mask[c, lane] = 0 if code.only is not None else (1 << code.most) - 1
    table = np.concatenate(tables)
    lanes, done = np.arange(len(jobs)), np.zeros(len(jobs), np.int64)
    literal = 256 << 4
    while len(lanes) >= LEAST_LANES:
        (og, orr, ob, oa, od), (gm, rm, bm, am, dm) = offset[:, lanes], mask[:, lanes]
        pos, shape = at[lanes], (STRIDE, len(lanes))
        greens, values, spent, runs = np.empty(shape, np.int64), np.empty(shape, np.int64), np.empty(shape, np.int64), np.ones(shape, np.int64)
        references = []
        for t in range(STRIDE):
            h = words.take(pos >> 3, mode="clip")
            h >>= pos & 7
            g = table.take(og + (h & gm), out=greens[t], mode="clip")
            k = g & 15
            h >>= k
            rest = np.flatnonzero(g >= literal)
            r = table.take(orr + (h & rm), mode="clip")
            x = r & 15
            used = k + x
            h >>= x
            b = table.take(ob + (h & bm), mode="clip")
            x = b & 15
            used += x
            if len(rest):
                used[rest] = k[rest]
                symbol = (g[rest] >> 4) - 256
                refs = symbol < LENGTH_CODES
                if refs.any():
                    refs, symbol = rest[refs], symbol[refs]
                    held = words.take(pos[refs] >> 3, mode="clip") >> (pos[refs] & 7) + k[refs]
                    extra = EXTRA[symbol]
                    run = LEAST[symbol] + (held & (1 << extra) - 1) + 1
                    held >>= extra
                    d = table[od[refs] + (held & dm[refs])]
                    held >>= d & 15
                    more = EXTRA[d >> 4]
                    references.append((t, refs, run, LEAST[d >> 4] + (held & (1 << more) - 1) + 1))
                    runs[t, refs] = run
                    used[refs] += extra + (d & 15) + more
            h >>= x
            a = table.take(oa + (h & am), mode="clip")
            x = a & 15
            if len(rest):
                x[rest] = 0
            np.add(used, x, out=spent[t])
            pos += spent[t]
            r <<= 12
            b >>= 4
            a <<= 20
            r &= -65536
            a &= -16777216
            r += b
            np.add(r, a, out=values[t])
        ends = done[lanes] + np.cumsum(runs, axis=0)
        starts = ends - runs
        real = starts < total[lanes]
        starts += base[lanes]
        own = real & (greens < literal)
        yield (starts[own], values[own] + (greens[own] >> 4 << 8)), (), ()
        hit = np.nonzero(real & (greens >= 256 + LENGTH_CODES << 4))
        if len(hit[0]):
            yield (), (starts[hit], (greens[hit] >> 4) - 256 - LENGTH_CODES), ()
        for t, refs, run, far in references:
            ok = real[t, refs]
            yield (), (), (lanes[refs[ok]], starts[t, refs[ok]], run[ok], far[ok])
        at[lanes] += (spent * real).sum(axis=0)
        done[lanes] = ends[-1]
        # an image that ends early is not read further
        lanes = lanes[(ends[-1] < total[lanes]) & (at[lanes] >> 3 < len(words))]
    for lane in lanes.tolist():
        bits, _, _, _, head = jobs[lane]
        places, symbols, values, runs, far, end = _tokens_alone(bits, int(at[lane] - 8 * first[lane]), int(done[lane]), int(total[lane]), head[4][0])
        at[lane] = end + 8 * first[lane]
        places, symbols, values = np.array(places, np.int64) + base[lane], np.array(symbols, np.int64), np.array(values, np.int64)
        own, hit = symbols < 256, symbols >= 256 + LENGTH_CODES
        refs = np.array(runs, np.int64)
        yield (places[own], values[own]), (places[hit], symbols[hit] - 256 - LENGTH_CODES), (np.full(len(runs), lane), places[~own & ~hit], refs, np.array(far, np.int64))


def _chase(source: np.ndarray, places: np.ndarray) -> None:
    """Lets each of ``places`` point to where the chain of its sources ends."""
    while len(places):
        before = source[places]
        after = source[before]
        moved = after != before
        places = places[moved]
        source[places] = after[moved]


def _pixels_in_step(jobs: list) -> list[np.ndarray | Exception | None]:
    """The pixels of main images (bits, width, height, steps, head), token by token in step; references and the cache are followed afterwards, over all of them at once.

    None where a slot of the cache is read before it is written: its pixel 0 goes to another slot, which takes reading in order.
    """
    total = np.array([w * h for _, w, h, _, _ in jobs])
    base = np.cumsum(total) - total
    held = [j[0].data + bytes(8) for j in jobs]
    sizes = np.array([len(h) for h in held])
    first = np.cumsum(sizes) - sizes
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(held) + bytes(8), np.uint8), 8).copy().view("<i8").reshape(-1)
    start = 8 * first + np.array([j[0].at for j in jobs])
    at = start.copy()
    pixels = np.zeros(int(total.sum()), np.uint32)
    source = np.arange(len(pixels), dtype=np.int32 if len(pixels) < 1 << 31 else np.int64)
    wrong: dict[int, Exception] = {}
    in_order: set[int] = set()
    hits, found_slots, references = [], [], []
    for literals, cached, refs in _tokens(jobs, base, total, words, at, first):
        if literals:
            pixels[literals[0]] = literals[1]
        if cached:
            hits.append(cached[0])
            found_slots.append(cached[1])
        if refs:
            references.append(refs)
    del words, held
    copies = np.zeros(0, np.int64)
    if references:
        lane, place, run, d = (np.concatenate(x) for x in zip(*references, strict=True))
        across = np.array([w for _, w, _, _, _ in jobs])
        short = d <= len(NEAR)
        near = NEAR_OFFSETS[np.where(short, d, 1) - 1]
        d = np.where(short, np.maximum(1, near[:, 0] + near[:, 1] * across[lane]), d - len(NEAR))
        ok = (d <= place - base[lane]) & (place + run <= base[lane] + total[lane])
        for i in lane[~ok].tolist():
            wrong[i] = ValueError("a back-reference leaves the image")
        place, run, d = place[ok], run[ok], d[ok]
        copies = np.arange(int(run.sum())) + np.repeat(place - np.cumsum(run) + run, run)
        source[copies] = copies - np.repeat(d, run)
    _chase(source, copies)
    if hits:
        # a hit is the pixel that was the last of its slot; slots are known of literals by value, of hits by symbol, of copies by where they come from
        shift = np.array([32 - j[4][0] for j in jobs], np.uint32)
        found, kept = np.concatenate(hits), np.concatenate(found_slots).astype(np.uint16)
        hashed = pixels * np.uint32(CACHE_MULTIPLIER)
        hashed >>= np.repeat(np.minimum(shift, 31), total) if (shift != shift[0]).any() or shift[0] == 32 else shift[0]
        slot = hashed.astype(np.uint16)
        slot[found] = kept
        slot[copies] = slot[source[copies]]
        order = np.argsort(slot, kind="stable")
        last = np.empty_like(source)
        last[order[1:]] = order[:-1]
        last[order[0]] = order[0]
        last = last[found]
        image = np.repeat(np.arange(len(jobs), dtype=np.int32), total)
        known = (slot[last] == slot[found]) & (image[last] == image[found]) & (last != found)
        source[found[known]] = last[known]
        in_order = set(image[found[~known]].tolist())
        _chase(source, np.concatenate([found, copies]))
    pixels = pixels[source]
    out: list[np.ndarray | Exception | None] = []
    for i, (bits, *_) in enumerate(jobs):
        if at[i] - 8 * first[i] > bits.end:
            wrong.setdefault(i, ValueError("the image data ends early"))
        out.append(wrong[i] if i in wrong else None if i in in_order else pixels[base[i] : base[i] + total[i]])
    return out


def _open(image: bytes):
    """(bits, width of the coded image, height, transforms, head of the coded image) of a file."""
    bits = Bits(chunk(image))
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            steps.append((kind, across, tile, _pixels(bits, -(-across >> tile), -(-height >> tile), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _pixels(bits, n, 1, False)
            for i in range(1, n):
                colours[i] = _add(colours[i], colours[i - 1])
            steps.append((kind, across, _palette_bits(n), colours))
            across = -(-across >> _palette_bits(n))
        else:
            steps.append((kind, across, 0, []))
    return bits, across, height, steps, _head(bits, across, height, True)


def _undo(pixels, height: int, steps: list) -> np.ndarray:
    """Takes back the transforms of a coded image."""
    for kind, across, tile, extra in reversed(steps):
        if kind == PREDICTOR:
            pixels = pixels if isinstance(pixels, list) else pixels.tolist()
            for at in range(len(pixels)):
                pixels[at] = _add(pixels[at], _predicted(pixels, at, across, tile, extra))
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, across, height, tile, extra, 1)
        elif kind == SUBTRACT_GREEN:
            p = np.array(pixels, dtype=np.int64)
            g = p >> 8 & 255
            pixels = (p & 0xFF00FF00 | (p & 0x00FF00FF) + (g << 16 | g) & 0x00FF00FF).tolist()
        else:
            p = np.array(pixels, dtype=np.int64).reshape(height, -1) >> 8 & 255
            each = 8 >> tile
            index = np.repeat(p, 1 << tile, axis=1)[:, :across] >> (np.arange(across) % (1 << tile)) * each & (1 << each) - 1
            colours = np.array(extra + [0] * (256 - len(extra)), dtype=np.int64)
            pixels = colours[index].reshape(-1).tolist()
    return np.asarray(pixels, dtype=np.uint32).reshape(height, -1)


def decode(image: bytes) -> np.ndarray:
    """The image as an array (height, width) of unsigned 32-bit ARGB."""
    bits, across, height, steps, head = _open(image)
    return _undo(_read_pixels(bits, across, height, *head), height, steps)


def decode_all(images: list[bytes]) -> list[np.ndarray]:
    """``decode`` of many files, whose pixels are read in step where their codes allow it; the first broken file raises."""
    jobs = [_open(image) for image in images]
    out: list = [None] * len(jobs)
    lanes = [i for i, j in enumerate(jobs) if _fits_lane(j[4])]
    if len(lanes) >= LEAST_LANES:
        for i, pixels in zip(lanes, _pixels_in_step([jobs[i] for i in lanes]), strict=True):
            out[i] = pixels
    for i, (bits, across, height, steps, head) in enumerate(jobs):
        if out[i] is None:
            out[i] = _read_pixels(bits, across, height, *head)
        if isinstance(out[i], Exception):
            raise out[i]
        out[i] = _undo(out[i], height, steps)
    return out


# --------------------------------------------------------------------- encoding


def chunk(image: bytes) -> bytes:
    """The VP8L chunk of a RIFF file."""
    if image[:4] != b"RIFF" or image[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return image[20 : 20 + struct.unpack("<I", image[16:20])[0]]


def _area(image: bytes) -> int:
    """The pixels of a file by its header."""
    bits = Bits(chunk(image))
    bits.read(8)
    return (bits.read(14) + 1) * (bits.read(14) + 1)


def riff(data: bytes) -> bytes:
    pad = b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def _header(sink: BitSink, width: int, height: int) -> None:
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        raise ValueError("an image has sides of 1 to 16384")
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        sink.put(value, n)


def _to_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their value) of lengths or distances."""
    v = value - 1
    high = np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, high - 1)
    symbol = np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1))
    return symbol, extra, np.where(v < 4, 0, v & (1 << extra) - 1)


def _runs(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (at, length, distance), first come first, none overlapping: the last place where three pixels stood before."""
    if len(p) < 4:
        return []
    key = (p[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xFF51AFD7ED558CCD) ^ p[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    before = np.full(len(key), -1)
    before[order[1:][same]] = order[:-1][same]
    places = np.flatnonzero(before >= 0)
    out, i = [], 0
    while i < len(places):
        at = int(places[i])
        start, run = int(before[at]), 0
        most = min(4096, len(p) - at)
        for step in (16, 4096):
            part = np.flatnonzero(p[at + run : at + min(most, run + step)] != p[start + run : start + min(most, run + step)])
            if len(part):
                run += int(part[0])
                break
            run = min(most, run + step)
        if run < 3:
            i += 1
            continue
        out.append((at, run, at - start))
        i = int(np.searchsorted(places, at + run))
    return out


def _cache_hits(p: np.ndarray, image: np.ndarray, count: np.ndarray, cache_bits: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which free pixels of images their cache holds, and each pixel's slot; where these are few, ``cache_bits`` becomes 0."""
    shift = np.repeat(np.where(cache_bits > 0, 32 - cache_bits, 31).astype(np.uint32), count)
    slot = (p * np.uint32(CACHE_MULTIPLIER) >> shift).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(p), dtype=bool)
    slots, of, pixel = slot[order], image[order], p[order]
    hit[order[1:]] = (slots[1:] == slots[:-1]) & (pixel[1:] == pixel[:-1]) & (of[1:] == of[:-1])
    hit &= free
    share = np.bincount(image[hit], minlength=len(count))
    cache_bits[share < CACHE_SHARE * count] = 0
    hit &= cache_bits[image] > 0
    return hit, slot


def _write_all(jobs: list) -> None:
    """Entropy-coded images (sink, pixels, width, main, cache bits, references), each with one group of codes; red, blue and alpha share their code's lengths."""
    parts = [np.asarray(j[1], dtype=np.uint32) for j in jobs]
    p = np.concatenate(parts)
    count = np.array([len(x) for x in parts])
    base = np.cumsum(count) - count
    image = np.repeat(np.arange(len(jobs), dtype=np.int32), count)
    found = [_runs(x) if j[5] else [] for x, j in zip(parts, jobs, strict=True)]
    runs = np.array([r for f in found for r in f], dtype=np.int64).reshape(-1, 3)
    owner = np.repeat(np.arange(len(jobs)), [len(f) for f in found])
    place, run = runs[:, 0] + base[owner], runs[:, 1]
    covered = np.zeros(len(p) + 1, np.int8)
    covered[place] += 1
    covered[place + run] -= 1
    free = np.cumsum(covered[:-1], dtype=np.int8) == 0
    cache_bits = np.array([j[4] for j in jobs])
    hit, slot = _cache_hits(p, image, count, cache_bits, free) if cache_bits.any() else (np.zeros(len(p), dtype=bool), None)
    own = free & ~hit
    starts = own | hit
    starts[place] = True
    tokens = np.flatnonzero(starts)
    of = image[tokens]
    symbols = (p[tokens] >> np.uint32(8) & np.uint32(255)).astype(np.int32)
    literal = np.flatnonzero(own[tokens])
    lit, lit_of = p[tokens[literal]], of[literal]
    if hit.any():
        cached = np.flatnonzero(hit[tokens])
        symbols[cached] = slot[tokens[cached]].astype(np.int32) + 256 + LENGTH_CODES
    if len(runs):
        reference = np.flatnonzero(~free[tokens])
        s, n, v = _to_prefix(run)
        widths = [j[2] for j in jobs]
        near = {w: {x + y * w: i + 1 for i, (x, y) in reversed(list(enumerate(NEAR))) if x + y * w > 0} for w in set(widths)}
        e, m, w = _to_prefix(np.array([near[widths[o]].get(d, d + len(NEAR)) for o, d in zip(owner.tolist(), runs[:, 2].tolist(), strict=True)], dtype=np.int64))
        symbols[reference] = s + 256
    green = 256 + LENGTH_CODES + (1 << int(cache_bits.max()) if cache_bits.any() else 0)
    channels = [(lit >> np.uint32(k) & np.uint32(255)).astype(np.uint8) for k in (16, 0, 24)]
    counts = [
        np.bincount(of * green + symbols, minlength=len(jobs) * green).reshape(-1, green),
        sum(np.bincount(lit_of * 256 + c, minlength=len(jobs) * 256) for c in channels).reshape(-1, 256),
        (np.bincount(owner * DISTANCE_CODES + e, minlength=len(jobs) * DISTANCE_CODES) if len(runs) else np.zeros(len(jobs) * DISTANCE_CODES, np.int64)).reshape(-1, DISTANCE_CODES),
    ]
    lengths, stored = [], []
    for c in counts:
        lengths.append(code_lengths(c))
        row, symbol = np.nonzero(c)
        each = np.split(symbol, np.searchsorted(row, np.arange(1, len(jobs))))
        stored.append([dict(zip(x.tolist(), lengths[-1][i, x].tolist(), strict=True)) or {0: 0} for i, x in enumerate(each)])
    of_each = np.bincount(of, minlength=len(jobs))
    del p, parts, image, covered, free, hit, slot, own, starts, tokens, lit
    for i, (sink, _, _, main, _, _) in enumerate(jobs):
        bits = int(cache_bits[i])
        sink.put(1 if bits else 0, 1)
        if bits:
            sink.put(bits, 4)
        if main:
            sink.put(0, 1)
        size = 256 + LENGTH_CODES + (1 << bits if bits else 0)
        write_lengths(sink, stored[0][i], size)
        apart = BitSink()
        write_lengths(apart, stored[1][i], 256)
        once = (int.from_bytes(apart.done(), "little"), 8 * sum(map(len, apart.parts)) + apart.n)
        for _ in range(3):
            sink.put(*once)
        write_lengths(sink, stored[2][i], DISTANCE_CODES)
        if len(stored[0][i]) == 1 and (only := next(iter(stored[0][i]))) >= 256:
            lengths[0][i, [only, (only + 1) % size]] = 1
    codes, lengths = [codes_of(x) for x in lengths], [x.astype(np.int16) for x in lengths]
    values, sizes = codes[0][of, symbols], lengths[0][of, symbols]
    value, size = values[literal], sizes[literal]
    for c in channels:
        value |= codes[1][lit_of, c] << size.astype(np.uint64)
        size += lengths[1][lit_of, c]
    values[literal], sizes[literal] = value, size
    if len(runs):
        value, size = values[reference], sizes[reference]
        for x, bits in ((v.astype(np.uint64), n), (codes[2][owner, e], lengths[2][owner, e]), (w.astype(np.uint64), m)):
            value |= x << size.astype(np.uint64)
            size += bits
        values[reference], sizes[reference] = value, size
    put_each([j[0] for j in jobs], values, sizes, of_each)


def encode(image: np.ndarray, transforms: tuple[int, ...] = (), tile: int = 3, cache_bits: int = 0, references: bool = False, modes=None, factors=None) -> bytes:
    """A lossless file of an ARGB array, with ``transforms`` in order.

    Modes (0 to 13) and factors (three signed bytes as blue, green, red) are
    per tile; without them they run through all values.  A palette needs at
    most 256 colours and comes first.
    """
    return _encode_all([_steps(image, transforms, tile, cache_bits, references, modes, factors)])[0]


def _encode_all(files: list[Iterator[tuple]]) -> list[bytes]:
    """Files that are given as ``_steps``; the images that they are at are written together."""
    sinks: list[BitSink] = [None] * len(files)
    live = list(enumerate(files))
    while live:
        at = [(i, steps, job) for i, steps in live if (job := next(steps, None)) is not None]
        if at:
            _write_all([job for _, _, job in at])
        for i, _, job in at:
            sinks[i] = job[0]
        live = [(i, steps) for i, steps, job in at if not job[3]]
    return [riff(sink.done()) for sink in sinks]


def _steps(image: np.ndarray, transforms: tuple[int, ...], tile: int, cache_bits: int, references: bool, modes=None, factors=None) -> Iterator[tuple]:
    """The entropy-coded images of a file as ``_write_all`` takes them, the main one last; what stands between goes to their sink."""
    height, width = image.shape
    sink = BitSink()
    _header(sink, width, height)
    pixels, across = image.reshape(-1).tolist() if transforms else image.reshape(-1), width
    for kind in transforms:
        sink.put(1, 1)
        sink.put(kind, 2)
        tiles = -(-across >> tile) * -(-height >> tile)
        if kind == PREDICTOR:
            chosen = [(m % 14) << 8 | 0xFF000000 for m in (modes or range(tiles))]
            sink.put(tile - 2, 3)
            yield sink, chosen, -(-across >> tile), False, 0, False
            pixels = [_subtract(p, _predicted(pixels, at, across, tile, chosen)) for at, p in enumerate(pixels)]
        elif kind == CROSS_COLOUR:
            chosen = [0xFF000000 | f & 0xFFFFFF for f in (factors or [i * 0x3B1D57 for i in range(tiles)])]
            sink.put(tile - 2, 3)
            yield sink, chosen, -(-across >> tile), False, 0, False
            pixels = _cross(pixels, across, height, tile, chosen, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = [p & 0xFF00FF00 | ((p >> 16) - (p >> 8) & 255) << 16 | (p - (p >> 8) & 255) for p in pixels]
        else:
            colours, where = np.unique(np.asarray(pixels, dtype=np.uint32), return_inverse=True)
            sink.put(len(colours) - 1, 8)
            yield sink, np.concatenate([colours[:1], _minus(colours[1:], colours[:-1])]), len(colours), False, 0, False
            fold = _palette_bits(len(colours))
            each, across_before, across = 8 >> fold, across, -(-across >> fold)
            index = np.zeros((height, across << fold), np.uint32)
            index[:, :across_before] = where.reshape(height, -1)
            pixels = sum(index[:, k :: 1 << fold] << np.uint32(k * each) for k in range(1 << fold))
            pixels = (pixels << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1).tolist()
    sink.put(0, 1)
    yield sink, pixels, across, True, cache_bits, references


# ------------------------------------------------------------------ payloads

#: Pixels across a file (64 bytes), rows of a file at most; a longer payload takes several files.
WIDTH, FILE_ROWS = 16, 2048
CACHE_BITS = 7
#: Pixels that are stored or read together, so that what a task holds is bounded.
STORED_TOGETHER, READ_TOGETHER = 1 << 19, 1 << 20
WHOLE = 9  # the largest tile: one predictor mode for 512 x 512 pixels


#: n * log2(n) in units of 2^-20, so that sums don't depend on their order.
N_LOG = np.concatenate([[0], np.round(np.arange(1, WIDTH * FILE_ROWS + 1) * np.log2(np.arange(1, WIDTH * FILE_ROWS + 1)) * (1 << 20))]).astype(np.int64)


def _entropies(p: np.ndarray, image: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bits of the four channels of images by their own frequencies, and of their codes; ``image`` says whose each pixel is."""
    key = image * 1024
    n = sum(np.bincount(key + c * 256 + (p >> np.uint32(8 * c) & np.uint32(255)), minlength=1024 * len(count)) for c in range(4)).reshape(-1, 1024)
    return (4 * N_LOG[count] - N_LOG[n].sum(axis=1)) / (1 << 20) + 5 * np.count_nonzero(n, axis=1)


def _entropy(p: np.ndarray) -> float:
    return float(_entropies(p, np.zeros(len(p), np.int64), np.array([len(p)]))[0])


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b, each channel modulo 256."""
    return (np.ascontiguousarray(a).view(np.uint8) - np.ascontiguousarray(b).view(np.uint8)).view(np.uint32)


def _small(p: np.ndarray) -> float:
    """The share of bytes within 2 of 0."""
    return float(np.count_nonzero(np.ascontiguousarray(p).view(np.uint8) + np.uint8(2) < 5)) / (4 * len(p))


def choose(p: np.ndarray) -> dict:
    """How to encode the pixels of a payload (rows of WIDTH): the plan with the fewest estimated bits.

    Plans: as they are, green subtracted, predicted from above or from above and
    left, with or without a cross-colour step, or a palette.
    """
    plans = {(): (_entropy(p), {})}
    green = p >> np.uint32(8) & np.uint32(255)
    without = _minus(p, green | green << np.uint32(16))
    if _small(without) > 0.75:  # half of the bytes are green's and alpha's own
        plans[SUBTRACT_GREEN,] = (_entropy(without) + 8, {})
    if len(p) > WIDTH:
        for mode, guess in ((2, p[:-WIDTH]), (1, p[WIDTH - 1 : -1])):
            rest = _minus(p[WIDTH:], guess)
            if _small(rest) < 0.3:  # no use: residuals of such a guess are as mixed as the pixels
                continue
            residual = p.copy()
            residual[WIDTH:] = rest
            residual[1:WIDTH] = _minus(p[1:WIDTH], p[: WIDTH - 1])
            bits = _entropy(residual) + 64
            if bits < plans.get((PREDICTOR,), (np.inf,))[0]:
                plans[PREDICTOR,] = (bits, {"modes": mode})
            crossed = _crossed(residual)
            if (bits := _entropy(crossed) + 128) < plans.get((PREDICTOR, CROSS_COLOUR), (np.inf,))[0]:
                plans[PREDICTOR, CROSS_COLOUR] = (bits, {"modes": mode, "factors": FACTOR})
    colours, counts = np.unique(p, return_counts=True) if len(p) <= 512 or len(np.unique(p[:512])) <= 256 else (p, p)  # more than 256 in a part are more than 256
    if len(colours) <= 256:
        fold = 1 << _palette_bits(len(colours))
        plans[PALETTE,] = ((len(p) * np.log2(len(p)) - float((counts * np.log2(counts)).sum())) / min(fold, 2) + 5 * len(colours) + _entropy(colours) + 64, {})
    transforms = min(plans, key=lambda k: (plans[k][0], len(k)))
    return {"transforms": transforms, **plans[transforms][1]}


#: The cross-colour factors that are tried: half of green is told of red and of blue (in 1/32).
FACTOR = 16 | 16 << 8


def _crossed(p: np.ndarray) -> np.ndarray:
    """What FACTOR leaves of red and blue."""
    told = (_signed(p >> np.uint32(8)) * 16 >> 5).astype(np.uint8).astype(np.uint32)
    return _minus(p, told << np.uint32(16) | told)


def _groups(rows: list, sizes: list[int], most: int) -> Iterator[list]:
    """``rows`` in runs whose sizes add up to ``most`` at most; a larger one is alone."""
    group, held = [], 0
    for row, size in zip(rows, sizes, strict=True):
        if group and held + size > most:
            yield group
            group, held = [], 0
        group.append(row)
        held += size
    if group:
        yield group


def _small_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of a - b are within 2 of 0, by pixel."""
    return (_minus(a, b).view(np.uint8) + np.uint8(2) < 5).view(np.uint32) * np.uint32(0x01010101) >> np.uint32(24)


def choose_all(files: list[np.ndarray]) -> list[dict]:
    """``choose`` for each of many payloads; those where only a palette can be of use are decided together."""
    p = np.concatenate(files)
    count = np.array([len(f) for f in files])
    base = np.cumsum(count) - count
    image = np.repeat(np.arange(len(files)), count)
    inside = np.arange(len(p)) - base[image]
    green = p >> np.uint32(8) & np.uint32(255)
    other = np.add.reduceat(_small_bytes(p, green | green << np.uint32(16)), base, dtype=np.int64) / (4 * count) > 0.75
    for back in (1, WIDTH):
        small = np.zeros(len(p), np.uint32)
        small[back:] = _small_bytes(p[back:], p[:-back])
        small[inside < WIDTH] = 0
        other |= (count > WIDTH) & (np.add.reduceat(small, base, dtype=np.int64) >= 0.3 * 4 * (count - WIDTH))
    # a palette: more than 256 colours in a part are more than 256
    part = inside < 512
    keys = image[part] << 32 | p[part]
    keys.sort()
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    of = keys[edge] >> 32
    colours = np.bincount(of, minlength=len(files))
    few = colours <= 256
    other |= few & (count > 512)
    few &= ~other
    bits = _entropies(p, image, count)
    chosen = few[of]
    counted = np.zeros(len(files), np.int64)
    np.add.at(counted, of, N_LOG[np.diff(np.concatenate([edge, [len(keys)]]))])
    table = _entropies((keys[edge][chosen] & 0xFFFFFFFF).astype(np.uint32), of[chosen], np.where(few, colours, 0))
    fold = np.where(colours <= 16, 2, 1)
    palette = few & ((N_LOG[np.minimum(count, 512)] - counted) / (1 << 20) / fold + 5 * colours + table + 64 < bits)
    return [choose(f) if o else {"transforms": (PALETTE,) if q else ()} for f, o, q in zip(files, other.tolist(), palette.tolist(), strict=True)]


def store_bytes(payload: bytes) -> bytes:
    """Lossless files, one after the other, whose pixels are ``payload`` (a positive multiple of 64 bytes), four bytes each.

    Depends on the payload alone.
    """
    return store_all([payload])[0]


def store_all(payloads: list[bytes]) -> list[bytes]:
    """``store_bytes`` of many payloads, worked on together."""
    cut = [(i, np.frombuffer(x, "<u4", min(WIDTH * FILE_ROWS, (len(x) - a) // 4), a)) for i, x in enumerate(payloads) for a in range(0, len(x), 4 * WIDTH * FILE_ROWS)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for group in _groups(cut, [len(p) for _, p in cut], STORED_TOGETHER):
        steps = []
        for (_, p), plan in zip(group, choose_all([p for _, p in group]), strict=True):
            tiles = -(-(len(p) // WIDTH) >> WHOLE)
            modes = [plan["modes"]] * tiles if "modes" in plan else None
            factors = [plan["factors"]] * tiles if "factors" in plan else None
            cache = 0 if PALETTE in plan["transforms"] else CACHE_BITS
            steps.append(_steps(p.reshape(-1, WIDTH), plan["transforms"], WHOLE, cache, True, modes, factors))
        for (i, _), file in zip(group, _encode_all(steps), strict=True):
            out[i].append(file)
    return [b"".join(x) for x in out]


def load_bytes(stored: bytes) -> bytes:
    """The payload of files that ``store_bytes`` or any other encoder wrote: their pixels, four bytes each."""
    return load_all([stored])[0]


def load_all(stored: list[bytes]) -> list[bytes]:
    """``load_bytes`` of many, read together."""
    each = [(_area(f), i, f) for i, s in enumerate(stored) for f in files(s)]
    order = sorted(range(len(each)), key=lambda k: each[k][0])  # files of about the same size end together
    read: list[bytes] = [b""] * len(each)
    for group in _groups(order, [each[k][0] for k in order], READ_TOGETHER):
        for k, pixels in zip(group, decode_all([each[k][2] for k in group]), strict=True):
            read[k] = pixels.astype("<u4").tobytes()
    out: list[list[bytes]] = [[] for _ in stored]
    for (_, i, _), part in zip(each, read, strict=True):
        out[i].append(part)
    return [b"".join(x) for x in out]


def files(stored: bytes) -> list[bytes]:
    """The files that stand one after the other."""
    out, at = [], 0
    while at < len(stored):
        n = 8 + struct.unpack("<I", stored[at + 4 : at + 8])[0]
        out.append(stored[at : at + n])
        at += n
    return out
