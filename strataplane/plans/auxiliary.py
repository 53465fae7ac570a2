"""Queries on auxiliary images: a file for each part, with a grid of 1 to 4 cells, its auxiliary items, and a plain image."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataplane.operators import auxiliary
from strataplane.plans.base import query, table


def _tables(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"))

    def item(number: str, kind: str, width: str, height: str, configured: str = "true", usable: str = "true", is_cell: str = "false", transforms: str = "'turned'", where: str = "true") -> str:
        return f"CASE WHEN {where} THEN named_struct('item', bigint({number}), 'type', {kind}, 'width', bigint({width}), 'height', bigint({height}), 'configured', {configured}, 'usable', {usable}, 'is_cell', {is_cell}, 'transforms', {transforms}) END"

    own = [
        item("1", "'grid'", "s * 8", "s * 4"), item("100", "'av01'", "s", "s"), item("101", "'av01'", "if(k % 7 = 1, null, s + k % 2)", "s", "k % 11 <> 1", "k % 13 <> 1", where="k % 3 = 0"),
        item("20", "if(k % 8 = 0, 'grid', if(k % 16 = 4, 'hvc1', 'av01'))", "s * 8 + if(k % 7 = 0, 1, 0)", "s * 4", "k % 11 <> 0", "k % 13 <> 0", transforms="if(k % 19 = 0, 'plain', 'turned')", where="k % 4 = 0"),
    ]
    for i in range(4):
        own.append(item(f"{2 + i}", "'av01'", "64 + s", "64", is_cell="true", where=f"s % 4 >= {i}"))
        has = f"s % 4 >= {i} AND k % 4 <> 0 AND NOT (k % 5 = 0 AND s % 4 = {i})"
        own.append(item(f"{30 + i}", f"if(k % 13 = 0 and {i} = 2, 'grid', 'av01')", f"64 + s + if(k % 7 = 0 and {i} = 1, 1, 0)", "64", f"k % 11 <> 0 or {i} > 0", is_cell=f"k % 17 = 0 and {i} = 0", transforms=f"if(k % 19 = 0 and {i} = 3, 'plain', 'turned')", where=has))
    items = parts.select("file", F.expr(f"explode(array_compact(array({', '.join(own)})))").alias("x")).select("file", "x.*")
    target = F.when(F.col("item") == 20, 1).when(F.col("item") == 101, 100).when(F.col("item") >= 30, F.col("item") - 28)
    links = items.where("item = 20 or item = 101 or item between 30 and 40").select("file", F.col("item").alias("aux"), target.cast("bigint").alias("item"))
    cells = items.where("item between 2 and 5").select("file", F.lit(1).cast("bigint").alias("grid"), (F.col("item") - 2).alias("place"), "item")
    return items, links, cells


_FACTS = "WITH p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s FROM part)"
_GRID = {
    True: "CASE WHEN k % 13 = 0 THEN 'the auxiliary item is not usable' WHEN k % 19 = 0 THEN 'the auxiliary item has other transforms' WHEN k % 16 = 4 THEN 'the auxiliary item is of another type' WHEN k % 7 = 0 THEN 'the auxiliary item differs in size' WHEN k % 11 = 0 AND k % 8 <> 0 THEN 'the auxiliary item has no configuration' END",
    False: "CASE WHEN k % 13 = 0 THEN 'the auxiliary item is not usable' WHEN k % 16 = 4 THEN 'the auxiliary item is of another type' WHEN k % 11 = 0 AND k % 8 <> 0 THEN 'the auxiliary item has no configuration' END",
}
#: for each cell: null good, '' without auxiliary, else what is wrong
_CELL = {
    True: "CASE WHEN k % 5 = 0 AND s % 4 = i THEN '' WHEN k % 13 = 0 AND i = 2 THEN 'the auxiliary item is of another type' WHEN k % 17 = 0 AND i = 0 THEN 'the auxiliary item is a cell of another image' WHEN k % 7 = 0 AND i = 1 THEN 'the auxiliary item differs in size' WHEN k % 11 = 0 AND i = 0 THEN 'the auxiliary item has no configuration' WHEN k % 19 = 0 AND i = 3 THEN 'the auxiliary item has other transforms' END",
    False: "CASE WHEN k % 5 = 0 AND s % 4 = i THEN '' WHEN k % 13 = 0 AND i = 2 THEN 'the auxiliary item is of another type' WHEN k % 17 = 0 AND i = 0 THEN 'the auxiliary item is a cell of another image' WHEN k % 11 = 0 AND i = 0 THEN 'the auxiliary item has no configuration' WHEN k % 7 = 0 AND i = 1 THEN 'the auxiliary item differs in size' END",
}
_IMAGE = {
    True: "CASE WHEN k % 13 = 1 THEN 'the auxiliary item is not usable' WHEN k % 7 <> 1 AND k % 2 = 1 THEN 'the auxiliary item differs in size' WHEN k % 11 = 1 THEN 'the auxiliary item has no configuration' END",
    False: "CASE WHEN k % 13 = 1 THEN 'the auxiliary item is not usable' WHEN k % 7 = 1 THEN 'the auxiliary item has no size' WHEN k % 11 = 1 THEN 'the auxiliary item has no configuration' END",
}

for _kind, _alpha in {"alpha": True, "depth": False}.items():
    _size = "s * 8, s * 4" if _alpha else "s * 8 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END, s * 4"
    _width, _height = _size.split(", ")
    query(
        f"auxiliary_{_kind}",
        f"{_FACTS}, g AS (SELECT *, {_GRID[_alpha]} AS error FROM p WHERE k % 4 = 0), e AS (SELECT k, s, i, {_CELL[_alpha]} AS event FROM p, range(0, 4) r(i) WHERE k % 4 <> 0 AND i <= s % 4),"
        " c AS (SELECT k, s, min_by(event, i) FILTER (event IS NOT NULL) AS first FROM e GROUP BY k, s),"
        f" i AS (SELECT *, CASE WHEN k % 3 = 0 THEN {_IMAGE[_alpha]} END AS error FROM p)"
        f" SELECT k, CAST(1 AS BIGINT) AS item, CASE WHEN error IS NULL THEN CASE WHEN k % 8 = 0 THEN 'grid' ELSE 'item' END END AS source, CASE WHEN error IS NULL THEN CAST(20 AS BIGINT) END AS aux, CAST(NULL AS BIGINT) AS cells, CASE WHEN error IS NULL THEN {_width} END AS width, CASE WHEN error IS NULL THEN {_height} END AS height, error FROM g"
        " UNION ALL SELECT k, 1, CASE WHEN first IS NULL THEN 'cells' END, NULL, CASE WHEN first IS NULL THEN s % 4 + 1 END, CASE WHEN first IS NULL THEN s * 8 END, CASE WHEN first IS NULL THEN s * 4 END, nullif(first, '') FROM c"
        f" UNION ALL SELECT k, 100, CASE WHEN error IS NULL AND k % 3 = 0 THEN 'item' END, CASE WHEN error IS NULL AND k % 3 = 0 THEN 101 END, NULL, CASE WHEN error IS NULL AND k % 3 = 0 THEN {'s' if _alpha else 's + k % 2'} END, CASE WHEN error IS NULL AND k % 3 = 0 THEN s END, error FROM i",
    )((lambda alpha: lambda spark, d: auxiliary.resolve(*_tables(spark, d), alpha).where("item in (1, 100)").select(F.col("file").alias("k"), "item", "source", "aux", F.when(F.col("cells").isNotNull(), F.size("cells").cast("bigint")).alias("cells"), "width", "height", "error"))(_alpha))
