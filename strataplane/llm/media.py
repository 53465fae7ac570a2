"""Media columns: payloads kept as lossless WebP files, pixel arrays and features read back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplane.llm import webp

UNIT = 64


def padded(content: bytes) -> bytes:
    """``content`` with bytes 0 up to a positive multiple of 64."""
    return content + b"\0" * (UNIT * max(1, -(-len(content) // UNIT)) - len(content))


def feature(samples: bytes) -> str:
    """rows x 64, mean, deviation, entropy, and a 64-bit difference hash over an 8 x 9 grid of means."""
    x = np.frombuffer(samples, dtype=np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    cut = (np.arange(73) * len(x)) // 72
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    grid = ((total[cut[1:]] - total[cut[:-1]]) / np.maximum(1, cut[1:] - cut[:-1])).reshape(8, 9)
    sign = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()
    return f"{len(x) // UNIT}x{UNIT} mean={x.mean():.6f} std={x.std():.6f} entropy={max(0.0, float(-(p * np.log2(p)).sum())):.6f} dhash={sign}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each row's text as UTF-8, padded, as the pixels of lossless WebP files one after the other.

    A null or empty text is 64 bytes 0.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes = pa.array([len(b) for b in contents], pa.int64())
            contents = [padded(b) for b in contents]
            media = webp.store_all(contents)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(stored: DataFrame) -> DataFrame:
    """``stored`` (doc_id, n_bytes, media) with payload (the pixels read back as bytes) and feature; a null media gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            read = iter(webp.load_all([m for m in media if m is not None]))
            payload = [None if m is None else next(read) for m in media]
            features = [None if not b else feature(b) for b in payload]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(features, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def pixels(images: DataFrame) -> DataFrame:
    """(id, width, height, pixels array<int>, error) of rows (id, image): any lossless WebP file as signed 32-bit ARGB, row by row.

    A null or broken image gives null pixels, and what is wrong in error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, px, err = [], [], [], []
            for image in batch.column(1).to_pylist():
                got, why = None, None
                try:
                    got = webp.decode(image) if image is not None else None
                except (ValueError, IndexError) as e:
                    why = str(e) or type(e).__name__
                h.append(None if got is None else got.shape[0])
                w.append(None if got is None else got.shape[1])
                px.append(None if got is None else got.reshape(-1).view(np.int32))
                err.append(why)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(px, pa.list_(pa.int32())), pa.array(err, pa.string())], names=["id", "width", "height", "pixels", "error"])

    return images.select(F.col("id").cast("long").alias("id"), "image").mapInArrow(run, "id long, width int, height int, pixels array<int>, error string")
