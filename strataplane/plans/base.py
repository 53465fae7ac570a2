"""Bindings to the driver tables: 8x8 sample blocks, and a registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query function, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def samples(embedding: Column) -> Column:
    """The 64 values of a block as bigint samples 0..255."""
    return F.transform(embedding, lambda e: F.floor((e.cast("double") + 1.0) * 127.5).cast("bigint"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, s array<bigint>): one 8x8 block a row, row-major."""
    return table(spark, sf_dir, "embeddings").select("vec_id", samples(F.col("embedding")).alias("s"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, x, v): one sample a row."""
    each = blocks(spark, sf_dir).select("vec_id", F.posexplode("s").alias("i", "v"))
    return each.select("vec_id", F.floor(F.col("i") / 8).cast("bigint").alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), "v")


#: The same tables in SQL.
PX = "px AS MATERIALIZED (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, 64)) AS i FROM embeddings))"
BLOCKS = "blk AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT)) AS s FROM embeddings)"
