"""Headers read in step against headers read one by one, over random streams."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strataplane.plans import header_writer
from strataplane.sources import headers

IN = pa.schema([("stream_id", pa.string()), ("segment", pa.int64()), ("obu_index", pa.int64()), ("unit", pa.int64()), ("type", pa.int32()), ("temporal_id", pa.int32()), ("spatial_id", pa.int32()), ("head", pa.binary())])


def noise(rng, n, head=""):
    text = head + "".join(rng.choice("01") for _ in range(8 * n - len(head)))
    return int(text, 2).to_bytes(n, "big")


def sequence(rng):
    """A sequence header without frame ids and decoder model, mostly; its tools and colours are random."""
    lead = "{:03b}".format(rng.choice([0, 0, 1, 2])) + "00" + "0" + "0" + "00000" + "0" * 12 + "00101" + "10001000" + f"{rng.randint(0, 511):09b}{rng.randint(0, 511):09b}"
    return noise(rng, 40, lead + rng.choice(["0", "0", "0", "0", "1"]))


def stream(rng, frames, odd):
    """Records (unit, type, payload) of one stream: frames that take rare turns or are broken come by the share ``odd``."""
    data = sequence(rng)
    q = headers.sequence_header(data)
    slots, out = [None] * 8, [(0, 1, data)]
    for unit in range(frames):
        h = None
        for _ in range(200):
            head = "0001" if not unit or rng.random() < 0.05 else rng.choice(["0011", "0011", "0011", "0010", "0101", "0111", "1"])
            payload = noise(rng, 300, head + ("0" if rng.random() < 0.5 else ""))
            if rng.random() < odd / 10:
                payload = payload[: rng.randint(0, 60)]
            try:
                h = headers.frame_header(payload, q, slots)
            except ValueError:
                if rng.random() < odd / 10:
                    break
                continue
            if rng.random() < odd / 3 or not h["short_signalling"] and h["tiling"]["uniform"] and (h["show_existing"] or len(payload) == 300):
                break
        kind = 6 if rng.random() < 0.5 and not (h and h["show_existing"] and rng.random() > odd / 3) else 3
        out.append((unit, kind, payload))
        if h is not None:
            slots = [h if h["refresh"] >> i & 1 else s for i, s in enumerate(slots)]
        if rng.random() < 0.1:
            data = data if rng.random() < 0.7 else sequence(rng)
            q = headers.sequence_header(data)
            out.append((unit + 1, 1, data))
    return out


def rows(rng, n, odd):
    """Rows in order of (stream, segment, record) with the segments that the engine numbers."""
    out = []
    for s in range(n):
        records = stream(rng, rng.choice([1, 2, 3, 5, 8, 80]) if s % 10 == 0 else rng.randint(1, 8), odd)
        if rng.random() < 0.1 * odd:
            records = records[1:]
        begins = {u for u, k, _ in records if k == 1} & {u for u, k, d in records if k != 1 and d[:1] and d[0] >> 4 == 1}
        for i, (unit, kind, payload) in enumerate(records):
            out.append((f"{s:04d}", sum(b <= unit for b in begins), i, unit, kind, 0, 0, payload))
    return out


@pytest.fixture
def out(spark):
    return to_arrow_schema(StructType.fromDDL(f"stream_id string, obu_index long, unit long, type int, sequence struct<{headers.SEQUENCE_FIELDS}>").add("header", StructType.fromDDL(headers.FRAME_FIELDS)).add("error", "string"))


def walked(out, own, monkeypatch, steps, batch, size, whole, active):
    monkeypatch.setattr(headers, "STEPS", steps)
    monkeypatch.setattr(headers, "ROWS", batch)
    table = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own, strict=True), IN, strict=True)], schema=IN)])
    run = headers._walker(out, active, whole)
    return sorted((r for b in run(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()), key=lambda r: (r["stream_id"], r["obu_index"]))


@pytest.mark.parametrize("odd", [0, 0.1, 1])
def test_in_step_and_one_by_one(out, monkeypatch, odd):
    rng = random.Random(round(10 * odd))
    own = rows(rng, 60, odd)
    plain = walked(out, own, monkeypatch, 0, 1 << 15, 1000, False, True)
    assert len(plain) == len(own) and sum(r["header"] is not None for r in plain) > len(own) / 3
    for steps, batch, size, whole in ((64, 1 << 15, 1000, False), (64, 50, 7, False), (4, 50, 20, False), (64, 1 << 15, 1000, True), (64, 50, 7, True), (1000, 10, 3, True)):
        got = walked(out, own, monkeypatch, steps, batch, size, whole, True)
        assert len(got) == len(plain)
        for a, b in zip(got, plain, strict=True):
            assert a == b, [(k, a["header"] and a["header"][k], b["header"] and b["header"][k]) for k in out.field("header").type.names if (a["header"] or {}).get(k) != (b["header"] or {}).get(k)]


def test_plain_streams_are_read_in_step(out, monkeypatch):
    """No header of a plain stream is left to the slower way."""
    own = rows(random.Random(5), 30, 0)
    own = [r for r in own if not headers.sequence_header(next(x[-1] for x in own if x[0] == r[0]))["frame_ids"] and not any(x[0] == r[0] and x[4] == 1 and x[2] for x in own) and sum(x[0] == r[0] for x in own) <= 64]
    monkeypatch.setattr(headers, "frame_header", None)
    assert len(own) > 40 and len(walked(out, own, monkeypatch, 64, 1 << 15, 100, True, False)) == len(own)
    cut = [(*r[:-1], r[-1][:3] if r[4] != 1 and r[2] % 3 == 2 else r[-1]) for r in own]
    assert {"a header ends early", "an earlier header of the segment is broken"} <= {r["error"] for r in walked(out, cut, monkeypatch, 64, 1 << 15, 100, True, False)}


def test_streams_as_a_whole(spark):
    """Streams that are shuffled as a whole are cut into the same segments, also where records are out of the order of their units."""
    rng = random.Random(9)
    own = [(s, i if int(s) % 3 else (i * 7) % 11, unit, kind, 0, 0, data) for s, _, i, unit, kind, _, _, data in rows(rng, 25, 0.2)] + [("x", 0, None, 1, 0, 0, None), (None, 1, 0, 3, 0, 0, b"\x10"), ("y", 1, 2, 4, 0, 0, b"tile")]
    records = spark.createDataFrame([r for n, r in enumerate(own) if (r[0], r[1]) not in {(x[0], x[1]) for x in own[:n]}], "stream_id string, obu_index long, unit long, type int, temporal_id int, spatial_id int, payload binary").repartition(3)
    key = lambda r: (r["stream_id"] or "", r["obu_index"])
    plain = sorted((r.asDict(True) for r in headers.headers(records).collect()), key=key)
    assert len(plain) > 60 and sorted((r.asDict(True) for r in headers.headers(records, most=1000).collect()), key=key) == plain


def test_written_fields():
    c = {"q": np.array([0, 1, 5]), "n": np.array([1, 2, 3])}
    assert header_writer.vector("4 * n + CASE WHEN n % 2 = 0 THEN 8 ELSE 0 END", c).tolist() == [4, 16, 12]
    assert header_writer.vector("CASE WHEN n > 1 AND q <> 5 THEN q % 3 ELSE 7 END", c).tolist() == [7, 1, 7]
    t = header_writer.Text(3)
    t.bits("1" * 60)
    t.put(c["q"], 3, c["n"] > 1)
    t.put(-1, 7)
    held, size = t.bytes()
    text = ["".join(f"{b:08b}" for b in row[:k]) for row, k in zip(held, size, strict=True)]
    assert text == [("1" * 60 + m + "1" * 8).ljust(72, "0") for m in ("", "001", "101")]
