"""Tile groups, their ranges, and tile lists with their anchors."""

import pytest
from pyspark.sql import functions as F
from test_headers import S, data

from strataplane.sources import headers, tiles


def test_groups():
    two = b"\0" + b"\x02" + b"abc" + b"rest"
    assert tiles.group(two, 0, 2, 1, 1, 1) == [(0, 2, 3), (1, 5, 4)]
    assert tiles.group(b"only", 0, 1, 1, 0, 0) == [(0, 0, 4)]
    assert tiles.group(bytes([0b1_01_10_000]) + b"\x01\x00" + b"ab" + b"rest", 0, 2, 2, 2, 2) == [(1, 3, 2), (2, 5, 4)]
    with pytest.raises(ValueError, match="before it starts"):
        tiles.group(bytes([0b1_10_01_000]), 0, 2, 2, 2, 1)
    with pytest.raises(ValueError, match="leaves the frame"):
        tiles.group(bytes([0b1_00_11_000]) + bytes(20), 0, 3, 1, 2, 1)
    with pytest.raises(ValueError, match="size leaves"):
        tiles.group(b"\0\1", 0, 2, 1, 1, 2)
    with pytest.raises(ValueError, match="tile leaves"):
        tiles.group(b"\0\x09abc", 0, 2, 1, 1, 1)
    with pytest.raises(ValueError, match="early"):
        tiles.group(b"", 0, 2, 1, 1, 1)


def test_ranges_follow_their_header(spark):
    """A unit with two frames: each group takes the header before it; other units and streams don't lend theirs."""
    still = data("000", "11", "00000", (9, 4), (8, 4), (639, 10), (359, 9), "000", "000", "0", "0", "0", "0", "00", "0", "0")
    one = data("1", "0", "0", "1", "00", (0, 8), "0", "0", "0", "0", "0", "0")
    wide = data("1", "0", "0", "1", "10", "0", "0", "00", (0, 8), "0", "0", "0", "0", "0", "0")
    rows = [("a", 0, 0, 1, 0, 0, still), ("a", 1, 0, 3, 0, 0, one), ("a", 2, 0, 4, 0, 0, b"tile"), ("a", 3, 0, 3, 0, 0, wide), ("a", 4, 0, 4, 0, 0, b"\0\x01abrest"), ("a", 5, 1, 4, 0, 0, b"late"), ("b", 0, 0, 4, 0, 0, None), ("c", 0, 0, 1, 0, 0, still), ("c", 1, 0, 6, 0, 0, b"\x80")]
    r = spark.createDataFrame(rows, S)
    got = sorted((x.stream_id, x.obu_index, x.frame or -1, x.tile if x.tile is not None else -1, x.offset, x.length, x.error) for x in tiles.tile_ranges(r, headers.headers(r, ("tiling", "header_bits"))).collect())
    assert got == [("a", 2, 1, 0, 0, 4, None), ("a", 4, 3, 0, 2, 2, None), ("a", 4, 3, 1, 4, 4, None), ("a", 5, -1, -1, None, None, "no frame header"), ("b", 0, -1, -1, None, None, "no frame header"), ("c", 1, -1, -1, None, None, "no frame header")]


def test_lists(spark):
    entry = lambda a, r, c, t: bytes([a, r, c]) + (len(t) - 1).to_bytes(2, "big") + t
    good = b"\x01\x00\x00\x01" + entry(0, 0, 1, b"abc") + entry(7, 1, 0, b"z")
    assert list(tiles.entries(good)) == [(2, 1, 0, 0, 1, 9, 3), (2, 1, 7, 1, 0, 17, 1)]
    for wrong, text in ((b"\0\0\0", "early"), (b"\xff\xff\x02\x00", "too many"), (b"\0\0\0\1" + good[4:], "places"), (good + b"x", "after"), (good[:-1], "leaves"), (good[:13], "early"), (b"\0\0\0\0" + entry(128, 0, 0, b"a"), "beyond")):
        with pytest.raises(ValueError, match=text):
            list(tiles.entries(wrong))
    lists = tiles.tile_lists(spark.createDataFrame([("a", 0, 8, good), ("a", 1, 8, good[:-1]), ("b", 0, 8, good), ("b", 1, 4, good), ("c", 0, 8, None)], "stream_id string, obu_index long, type int, payload binary"))
    anchors = spark.createDataFrame([("a", 0, 50, 2, 1), ("a", 7, 51, 2, 1)], "stream_id string, anchor int, frame long, columns int, rows int")
    got = {(r.stream_id, r.obu_index, r.entry): (r.frame, r.tile, r.output_row, r.output_column, r.error) for r in tiles.resolve(lists, anchors).collect()}
    assert got["a", 0, 0] == (50, 1, 0, 0, None) and got["a", 0, 1][4] == "a tile is outside its anchor frame" and got["a", 1, None][4] == "a tile leaves the record"
    assert got["b", 0, 0][4] == "the anchor frame is not there" and "early" in got["c", 0, None][4] and len(got) == 6
    assert tiles.tile_lists(spark.createDataFrame([], "stream_id string, obu_index long, type int, payload binary")).agg(F.count("*")).first()[0] == 0
