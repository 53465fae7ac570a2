"""Queries on sample programs that are data: each block or part has a payload of its own, written from its row."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataplane.operators import programs
from strataplane.plans.base import BLOCKS, blocks, query, table
from strataplane.plans.containers import raw, u


def token(code, value=None, width="w"):
    """A token's byte, with a constant's bytes (an expression, two's complement of ``width`` bits)."""
    own = u(code, 1)
    return own if value is None else F.concat(own, F.expr(f"unhex(substring(lpad(hex(bigint({value})), 16, '0'), 17 - int({width} / 4)))"))


#: op % 14 of a block: binary operators 128.. by number, then unary ones on the difference; w: width in bits, c and e: constants
_F = "vec_id, vec_id % 14 AS f, CAST(8 AS BIGINT) << CAST(vec_id % 4 AS INTEGER) AS w, vec_id % 17 - 8 AS c, vec_id % 7 - 1 AS e"
_ERRORS = "CASE WHEN vec_id % 23 = 5 THEN 'bytes after the program' WHEN vec_id % 23 = 7 THEN 'an operator lacks operands' WHEN vec_id % 23 = 9 THEN 'a program ends early' WHEN vec_id % 23 = 11 THEN 'a reserved token' WHEN vec_id % 23 = 13 THEN 'another version' WHEN vec_id % 23 = 15 THEN 'an input is not there' WHEN vec_id % 23 = 17 AND vec_id % 4 = 0 AND large > 127 THEN 'an input is beyond the width' END"


def block_programs(spark, d):
    """(vec_id, payload, s): programs of two inputs and one or two constants; some are wrong in one of seven ways."""
    own = blocks(spark, d).withColumns({"f": F.expr("vec_id % 14"), "w": F.expr("shiftleft(8L, int(vec_id % 4))"), "c": F.expr("vec_id % 17 - 8"), "e": F.expr("vec_id % 7 - 1")})
    head = u("if(vec_id % 23 = 13, 64, 0) + vec_id % 4", 1)
    first = F.when(F.expr("vec_id % 23 = 7"), raw(b"")).otherwise(u("if(vec_id % 23 = 15, 3, 1)", 1))
    second = F.when(F.expr("f = 7"), token(0, "e")).otherwise(u(2, 1))
    operator = F.when(F.expr("f < 10"), u("if(vec_id % 23 = 11, 99, 128 + f)", 1)).otherwise(F.concat(u("if(vec_id % 23 = 11, 99, 129)", 1), u("54 + f", 1)))
    count = u("5 + if(f < 10, 0, 1) - if(vec_id % 23 = 7, 1, 0)", 1)
    body = F.concat(head, count, first, second, operator, token(0, "c"), u(128, 1))
    data = F.when(F.expr("vec_id % 23 = 5"), F.concat(body, raw(b"x"))).when(F.expr("vec_id % 23 = 9"), F.expr("substring(body, 1, octet_length(body) - 1)")).otherwise(F.col("body"))
    return own.withColumn("body", body).select("vec_id", "s", data.alias("payload"))


@query(
    "sato_programs",
    f"WITH {BLOCKS}, own AS (SELECT {_F}, s, list_max(s) AS large FROM blk), made AS (SELECT *, {_ERRORS} AS error FROM own),"
    " px AS (SELECT vec_id, error, f, w, c, e, unnest(range(0, 64)) AS i, unnest(s) AS x, unnest(list_reverse(s)) AS y FROM made),"
    " ab AS (SELECT *, CASE WHEN vec_id % 23 = 17 THEN x ELSE x // 4 END AS a, CASE WHEN vec_id % 23 = 17 THEN y ELSE y // 4 END AS b, (CAST(1 AS HUGEINT) << CAST(w - 1 AS INTEGER)) - 1 AS top FROM px),"
    " r AS (SELECT *, CAST(CASE f WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN a * b WHEN 3 THEN CASE WHEN b = 0 THEN a ELSE a // b END WHEN 4 THEN a & b WHEN 5 THEN a | b WHEN 6 THEN xor(a, b)"
    " WHEN 7 THEN CASE WHEN a < 2 THEN a WHEN e < 0 THEN 0 WHEN e = 0 THEN 1 WHEN e = 1 THEN a WHEN e = 2 THEN a * a WHEN e = 3 THEN a * a * a WHEN e = 4 THEN a * a * a * a ELSE a * a * a * a * a END"
    " WHEN 8 THEN least(a, b) WHEN 9 THEN greatest(a, b) WHEN 10 THEN b - a WHEN 11 THEN abs(a - b) WHEN 12 THEN b - a - 1 ELSE CASE WHEN a - b <= 0 THEN 0 ELSE length(bin(a - b)) - 1 END END AS HUGEINT) AS v FROM ab),"
    " z AS (SELECT vec_id, error, i, greatest(0, least(1023, greatest(-top - 1, least(top, greatest(-top - 1, least(top, v)) + c)))) AS v FROM r)"
    " SELECT vec_id, CASE WHEN error IS NULL THEN sum(v * (i + 1))::BIGINT END AS digest, CASE WHEN error IS NULL THEN max(v)::BIGINT END AS largest, error FROM z GROUP BY vec_id, error",
)
def sato_programs(spark, d):
    """A program for each block over the block and its reverse, in four widths, with all operators; wrong ones give their error."""
    rows = block_programs(spark, d)
    scaled = lambda x: F.transform(x, lambda v: F.when(F.expr("vec_id % 23 = 17"), v).otherwise(F.floor(v / 4)))
    out = programs.transform_planes(rows, "vec_id", F.array(scaled(F.col("s")), scaled(F.reverse("s"))), F.lit(0), F.lit(1023))
    digest = F.aggregate(F.transform("plane", lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return out.select("vec_id", digest.alias("digest"), F.array_max("plane").alias("largest"), "error")


@query(
    "sato_tokens",
    "WITH p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, CAST(8 AS BIGINT) << CAST(p_partkey % 4 AS INTEGER) AS w FROM part)"
    " SELECT k, CAST(w AS INTEGER) AS width, CAST(CASE WHEN k % 9 = 4 THEN 0 ELSE 2 * (1 + s % 5) + 1 END AS INTEGER) AS tokens, CASE WHEN k % 9 <> 4 THEN (k % 3 - 1) * (s * CASE w WHEN 8 THEN 2 WHEN 16 THEN 600 WHEN 32 THEN 40000000 ELSE 180000000000000000 END) END AS first_constant,"
    " CAST(CASE WHEN k % 9 = 4 THEN 0 WHEN k % 9 = 2 THEN 2 * (1 + s % 5) + 1 ELSE 2 END AS INTEGER) AS depth, CASE WHEN k % 9 = 4 THEN 'a program without tokens' WHEN k % 9 = 2 THEN 'a program leaves one value' END AS error FROM p",
)
def sato_tokens(spark, d):
    """What is read of programs of 3 to 11 tokens with constants of all widths."""
    scale = "case w when 8 then 2 when 16 then 600 when 32 then 40000000 else 180000000000000000 end"
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"), F.expr("shiftleft(8L, int(p_partkey % 4))").alias("w"))
    value = token(0, f"(k % 3 - 1) * (s * {scale})")
    pairs = F.concat(*[F.when(F.expr(f"s % 5 >= {i}"), F.concat(u(1, 1), u("if(k % 9 = 2, 2, 128)", 1))).otherwise(raw(b"")) for i in range(5)])
    data = F.concat(u("k % 4", 1), u("if(k % 9 = 4, 0, 2 * (1 + s % 5) + 1)", 1), F.when(F.expr("k % 9 = 4"), raw(b"")).otherwise(F.concat(value, pairs)))
    got = programs.programs(parts.select("k", data.alias("payload"))).select("k", F.col("program.*"))
    return got.select("k", "width", F.size("codes").alias("tokens"), F.get("constants", F.lit(0)).alias("first_constant"), "depth", "error")
