"""Queries on tables with large keys, against their SQL."""

import os

import compare
import duckdb
import pytest

from strataplane.plans import catalog

SF = "/root/testdata/sf0.001"


def tables(folder, **made: str) -> str:
    """A folder of the smallest tables, with those that are given as SQL over them in their place."""
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for t in compare.TABLES:
        if t in made:
            con.execute(f"COPY ({made[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    return str(folder)


def differences(spark, folder, name):
    return compare.differences(spark, compare.connect(folder), folder, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", ["wide_associations", "wide_extents", "wide_headers", "wide_items", "wide_references"])
def test_item_numbers_of_more_than_32_bits(spark, tmp_path, name):
    """61357 * 70000 is the first that does not fit; 2**28 * 70000 has no low bits at all."""
    folder = tables(tmp_path, part="SELECT * REPLACE (CAST(k AS BIGINT) AS p_partkey) FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part), (VALUES (1, 3), (2, 61356), (3, 61357), (4, 122714), (5, 1199999), (6, 268435456)) v(n2, k) WHERE n = n2")
    assert differences(spark, folder, name) == []


def test_vectors_of_parts_over_a_million(spark, tmp_path):
    """Two writes to one place: the earlier line's part is so large that it stands last."""
    row = "SELECT * REPLACE (CAST({p} AS BIGINT) AS l_partkey, CAST({n} AS INTEGER) AS l_linenumber, CAST(64 AS BIGINT) AS l_suppkey, {q} AS l_quantity) FROM (SELECT * FROM lineitem ORDER BY ALL LIMIT 1)"
    lines = " UNION ALL ".join(row.format(p=p, n=n, q=q) for p, n, q in [(64 * 31252, 1, 25.0), (64, 2, 26.0)])
    assert differences(spark, tables(tmp_path, lineitem=lines), "mv_projection") == []
