"""Queries on tile groups and tile lists: a still stream for each part, a list for each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataplane.functions.integers import let
from strataplane.plans.base import query, table
from strataplane.plans.containers import raw, u
from strataplane.plans.headers import bits, packed, where
from strataplane.sources import headers, tiles

_I = lambda e: f"CAST({e} AS INTEGER)"
_L = lambda e: f"CAST({e} AS BIGINT)"
#: Tiles of a part: tc and tr doublings of columns and rows of a frame of 8 x (5..8) superblocks; z bytes of a size; two groups where more than one tile and k odd.
_PART = "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, p_partkey % 3 AS tc, p_size % 2 AS tr, p_partkey % 4 + 1 AS z FROM part"


def _filled(text):
    """Bytes of a string of bits, filled up with zeros."""
    byte = lambda t: lambda i: F.lpad(F.hex(F.conv(F.rpad(F.substring(t, i, 8), 8, "0"), 2, 10).cast("bigint")), 2, "0")
    return let(text, lambda t: F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.length(t), F.lit(8)), byte(t)), "")))


def streams(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s")).withColumns({"tc": F.expr("k % 3"), "tr": F.expr("s % 2"), "z": F.expr("k % 4 + 1")})
    parts = parts.withColumn("n", F.expr("shiftleft(1L, int(tc)) * if(tr = 1, 2, 1)"))
    sequence = bits("000", "11", "00000", "1011", "1011", ("511", 12), ("320 + s % 4 * 64 - 1", 12), "000", "000", "0", "0", "0", "0", "00", "0", "0")
    tiling = bits("1", F.expr("repeat('1', int(tc))"), "0", F.expr("repeat('1', int(tr))"), "0", where("tc + tr > 0", F.expr("repeat('0', int(tc + tr))"), ("z - 1", 2)))
    header = bits("100", tiling, ("0", 8), "000", "0", "0", "0")
    # the tiles from..to: a size before each but the last one, whose bytes end the record

    def body(first: str, last: str):
        tile = lambda i: F.concat(F.when(i < F.expr(last), _le_at(i)).otherwise(raw(b"")), F.encode(F.repeat(F.lit("x"), (F.lit(1) + (F.col("s") * (i + 3) + F.col("k")) % 24).cast("int")), "UTF-8"))

        def _le_at(i):
            v = (F.col("s") * (i + 3) + F.col("k")) % 24
            v = F.when(F.expr("k % 11 = 4") & (i == F.expr(first)), F.lit(255)).otherwise(v)
            return F.substring(F.concat(F.unhex(F.lpad(F.hex(v.cast("bigint")), 2, "0")), raw(b"\0\0\0")), F.lit(1), F.col("z").cast("int"))

        return F.unhex(F.array_join(F.transform(F.sequence(F.expr(first), F.expr(last)), lambda i: F.hex(tile(i))), ""))

    def positions(first: str, last: str):
        return _filled(bits("1", where("tc + tr > 0", F.expr(f"lpad(bin({first}), int(tc + tr), '0')"), F.expr(f"lpad(bin({last}), int(tc + tr), '0')"))))

    whole = F.concat(F.when(F.expr("n > 1"), raw(b"\0")).otherwise(raw(b"")), body("0L", "n - 1"))
    half = "n div 2"
    row = lambda i, kind, data, when="true": F.when(F.expr(when), F.struct(F.lit(i).cast("long").alias("obu_index"), F.lit(kind).alias("type"), data.alias("payload")))
    backwards = F.when(F.expr("k % 13 = 6"), positions("n - 1", "0L")).otherwise(positions("0L", f"{half} - 1"))
    two = "k % 2 = 1 and n > 1"
    rows = F.array(
        row(0, 1, packed(sequence)), row(1, 6, F.concat(_filled(header), whole), f"not ({two})"), row(1, 3, _filled(F.concat(header, F.lit("1"))), two),
        row(2, 4, F.concat(backwards, body("0L", f"{half} - 1")), two), row(3, 4, F.concat(positions(half, "n - 1"), body(half, "n - 1")), two), row(4, 4, raw(b"late"), "k % 17 = 3"),
    )
    each = parts.select(F.col("k").cast("string").alias("stream_id"), F.explode(F.array_compact(rows)).alias("r")).select("stream_id", "r.*")
    return each.select("stream_id", "obu_index", F.when(F.col("obu_index") == 4, 1).otherwise(0).cast("long").alias("unit"), "type", F.lit(0).alias("temporal_id"), F.lit(0).alias("spatial_id"), "payload")


@query(
    "tile_ranges",
    f"WITH p AS (SELECT *, (1 << CAST(tc AS INTEGER)) * CASE WHEN tr = 1 THEN 2 ELSE 1 END AS n FROM ({_PART})),"
    " h AS (SELECT *, (17 + 1 + tc + 1 + tr + 1 + CASE WHEN tc + tr > 0 THEN tc + tr + 2 ELSE 0 END + 7) // 8 AS head, k % 2 = 1 AND n > 1 AS two FROM p),"
    " g AS (SELECT k, s, z, n, 1 AS i, head + CASE WHEN n > 1 THEN 1 ELSE 0 END AS pos, 0 AS a, n - 1 AS b, NOT two AS own FROM h WHERE NOT two UNION ALL SELECT k, s, z, n, 2, 1, 0, n // 2 - 1, false FROM h WHERE two UNION ALL SELECT k, s, z, n, 3, 1, n // 2, n - 1, false FROM h WHERE two),"
    " e AS (SELECT *, CASE WHEN i = 2 AND k % 13 = 6 THEN 'a tile group ends before it starts' WHEN k % 11 = 4 AND b > a THEN 'a tile leaves the record' END AS error FROM g),"
    " t AS (SELECT *, unnest(CASE WHEN error IS NULL THEN range(a, b + 1) ELSE [CAST(NULL AS BIGINT)] END) AS tile FROM e)"
    f" SELECT k, {_L('i')} AS i, {_L('1')} AS frame, {_I('tile')} AS tile, {_L('pos + (tile - a) * z + CASE WHEN tile < b THEN z ELSE 0 END + coalesce(sum(1 + (s * (tile + 3) + k) % 24) OVER (PARTITION BY k, i ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS \"offset\", {_L('1 + (s * (tile + 3) + k) % 24')} AS length, error FROM t"
    " UNION ALL SELECT p_partkey, 4, NULL, NULL, NULL, NULL, 'no frame header' FROM part WHERE p_partkey % 17 = 3",
)
def tile_ranges(spark, d):
    """Ranges of the tiles of still frames of 1 to 8 tiles, in one group within the frame's record or in two records of their own."""
    r = streams(spark, d)
    found = tiles.tile_ranges(r, headers.headers(r, ("tiling", "header_bits")))
    return found.select(F.col("stream_id").cast("bigint").alias("k"), F.col("obu_index").alias("i"), "frame", "tile", "offset", "length", "error")


def lists(spark, d):
    """A tile list for each order: 1 + c % 5 entries on a grid of 2 + c % 2 columns and 3 rows."""
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    entry = lambda i: F.concat(u((F.col("c") + i) % 6 + F.when(F.expr("k % 19 = 5"), 200).otherwise(0), 1), u((F.col("k") + i) % 3, 1), u((F.col("c") + 2 * i) % 4, 1), u((F.col("k") + 7 * i) % 30, 2), F.encode(F.repeat(F.lit("t"), ((F.col("k") + 7 * i) % 30 + 1).cast("int")), "UTF-8"))
    body = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.expr("c % 5")), lambda i: F.hex(entry(i))), ""))
    tail = F.when(F.expr("k % 23 = 7"), raw(b"x")).otherwise(raw(b""))
    data = F.concat(u("1 + c % 2", 1), u("if(k % 29 = 3, 0, 2)", 1), u("c % 5", 2), body, tail)
    return own.select(F.col("k").cast("string").alias("stream_id"), F.lit(0).cast("long").alias("obu_index"), F.lit(8).alias("type"), data.alias("payload"))


@query(
    "tile_list_entries",
    "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, c % 5 + 1 AS n FROM orders), w AS (SELECT *, CASE WHEN k % 29 = 3 AND n > 2 + c % 2 THEN 'a tile list has more entries than places' WHEN k % 19 = 5 THEN 'an anchor frame is beyond the most' WHEN k % 23 = 7 THEN 'bytes after the last tile' END AS wrong FROM o),"
    " e AS (SELECT *, unnest(CASE WHEN wrong IS NULL THEN range(0, n) ELSE [CAST(NULL AS BIGINT)] END) AS i FROM w),"
    " a AS (SELECT *, (c + i) % 6 AS anchor, (k + i) % 3 AS r, (c + 2 * i) % 4 AS q, 1 + (c + i) % 6 % 3 AS have_rows, 2 + (c + i) % 6 % 3 AS have_columns FROM e),"
    " x AS (SELECT *, CASE WHEN wrong IS NOT NULL THEN wrong WHEN anchor = 5 THEN 'the anchor frame is not there' WHEN r >= have_rows OR q >= have_columns THEN 'a tile is outside its anchor frame' END AS error FROM a)"
    f" SELECT k, {_I('i')} AS entry, CASE WHEN error IS NULL THEN k * 10 + anchor END AS frame, {_I('CASE WHEN error IS NULL THEN r * have_columns + q END')} AS tile, {_I('CASE WHEN error IS NULL THEN i // (2 + c % 2) END')} AS output_row, {_I('CASE WHEN error IS NULL THEN i % (2 + c % 2) END')} AS output_column,"
    f" {_L('9 + 6 * i + coalesce(sum((k + 7 * i) % 30) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS \"offset\", {_L('(k + 7 * i) % 30 + 1')} AS length, error FROM x",
)
def tile_list_entries(spark, d):
    """Entries of tile lists with the stored frames they name: five anchors for each order, of different tilings; some lists and entries are wrong."""
    anchors = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("anchor"))
    anchors = anchors.select(F.col("k").cast("string").alias("stream_id"), "anchor", (F.col("k") * 10 + F.col("anchor")).alias("frame"), (F.lit(2) + F.col("anchor") % 3).alias("columns"), (F.lit(1) + F.col("anchor") % 3).alias("rows"))
    got = tiles.resolve(tiles.tile_lists(lists(spark, d)), anchors)
    return got.select(F.col("stream_id").cast("bigint").alias("k"), "entry", "frame", "tile", "output_row", "output_column", "offset", "length", "error")
