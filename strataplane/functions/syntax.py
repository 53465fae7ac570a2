"""Values that headers and blocks derive from coded fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataplane.functions.integers import clip, div, lit64

#: Fixed values of the format: 64 x 64 blocks between a copy and its source, tile limits in samples, bits of a superblock's side.
COPY_DELAY, MOST_TILE_WIDTH, SIDE_BITS = 4, 4096, 6
MOST_TILE_COLUMNS = 64


def uvlc(word: Column, bits: int) -> Column:
    """The unsigned code at the head of ``word``, its low ``bits`` (at most 63) read from the highest.

    z zeros, a one and z more bits, whose number less one is the value; null if they run past the word.
    """
    used = F.length(F.bin(word))
    past = 2 * used - bits - 1  # bits after the code: bits - (2 z + 1), where z is bits - used
    return F.when((word > 0) & (past >= 0), F.call_function("shiftright", word, past.cast("int")) - 1)


def superres_width(width: Column, denominator: Column) -> Column:
    """Coded width of a frame that is upscaled to ``width`` by denominator / 8."""
    return div(width * 8 + div(denominator, lit64(2)), denominator)


def units4(side: Column) -> Column:
    """Columns or rows of 4 x 4 units, an even number."""
    return F.shiftright(side + 7, 3) * 2


def tile_starts(side: Column, finer: Column) -> Column:
    """Where tiles of uniform spacing start, in 64-sample superblocks: the coarsest split allowed, ``finer`` doublings further."""
    blocks = F.shiftright(units4(side) + 15, 4)

    def doublings(unit: int, target: Column) -> Column:
        # the least k with unit << k >= target
        return F.length(F.bin(F.greatest(div(target + unit - 1, lit64(unit)), lit64(1)) - 1)) - (target <= unit).cast("int")

    least = doublings(MOST_TILE_WIDTH >> SIDE_BITS, blocks)
    most = doublings(1, F.least(blocks, lit64(MOST_TILE_COLUMNS)))
    k = F.least(F.greatest(most, least), least + finer.cast("int"))
    width = F.call_function("shiftright", blocks + F.call_function("shiftleft", lit64(1), k) - 1, k)
    return F.sequence(lit64(0), blocks - 1, width)


def segment_quantiser(base: Column, delta: Column) -> Column:
    """A segment's quantiser index: the frame's with the segment's delta, in 0..255."""
    return clip(base + delta, lit64(0), lit64(255))


def copy_allowed(row: Column, col: Column, y4: Column, x4: Column, height: Column, width: Column, tile: tuple[int, int, int, int], large: bool = False, chroma: Column | None = None) -> Column:
    """Whether a block may copy from its own frame by (row, col), in eighths of a sample.

    The source must lie at whole samples inside ``tile`` (top, left, bottom,
    right in 4 x 4 units) and far enough behind the wavefront of superblocks
    (128 samples wide if ``large``).  Where ``chroma`` holds (subsampled both
    ways), a block narrower or lower than 8 also needs the 4 samples before it.
    """
    top, left, bottom, right = (32 * t for t in tile)
    up, before = y4 * 32 + row, x4 * 32 + col
    down, after = (y4 * 4 + height) * 8 + row, (x4 * 4 + width) * 8 + col
    inside = (up >= top) & (before >= left) & (down <= bottom) & (after <= right)
    if chroma is not None:
        inside &= ~(chroma & (((width < 8) & (before < left + 32)) | ((height < 8) & (up < top + 32))))
    whole = (F.pmod(row, lit64(8)) == 0) & (F.pmod(col, lit64(8)) == 0)
    here_row, here = F.shiftright(y4, 5 if large else 4), F.shiftright(x4, 4)
    from_row, source = F.shiftright(F.shiftright(down, 3) - 1, 7 if large else 6), F.shiftright(F.shiftright(after, 3) - 1, 6)
    across = (tile[3] - tile[1] - 1 >> 4) + 1
    earlier = from_row * across + source < here_row * across + here - COPY_DELAY
    wave = (from_row <= here_row) & (source < here - COPY_DELAY + (here_row - from_row) * (1 + COPY_DELAY + int(large)))
    return whole & inside & earlier & wave
