"""Shared pieces: tables, materialised intermediates, broadcast checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataplane.functions.integers import let  # noqa: F401

#: Sides of a join whose measured size is at most this are broadcast.
BROADCAST_BYTES = 16 << 20

#: White space between words, as a Java character class body.
SPACE_CLASS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder all nodes share, from spark.checkpoint.dir; a temporary one only in local mode, where driver and tasks share the machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="strataplane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self._read(self.spark, df, path)

    def reread(self, saved: DataFrame, spark: SparkSession) -> DataFrame:
        """A saved table as seen from another session of the application."""
        return self._read(spark, saved, saved._scratch_path)

    @staticmethod
    def _read(spark: SparkSession, like: DataFrame, path: str) -> DataFrame:
        out = spark.read.schema(like.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def is_word(c):
    """Whether a string column holds a character outside white space."""
    return c.rlike(f"[^{SPACE_CLASS}]")


def words(text):
    """Array of the maximal runs outside ``\\x20\\x09-\\x0D``; null text counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def sha_hex(c):
    return F.sha2(c, 256)
