"""Mixture packing, whitening and periodic runs against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataplane.llm import mixture, periodic, queries, whitening

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")


def clash(df):
    """Extra columns with names that operators use inside."""
    return df.withColumns({c: F.lit(9) for c in ("queue", "part", "n", "before", "ids", "first", "ahead", "name", "_x", "size", "h", "a", "w", "g", "p", "runs", "collapsed") if c not in df.columns})


# ----------------------------------------------------------------------- packing


def turns(totals, weights, size):
    """The round-robin as a loop over windows: (round, queue, tokens) with a deficit counter for each queue."""
    left, deficit, k, out = list(totals), [0] * len(totals), 0, []
    while any(left):
        active = [q for q, t in enumerate(left) if t]
        whole = sum(weights[q] for q in active)
        for q in active:
            deficit[q] += max(1, size * mixture.UNIT * weights[q] // whole) if whole else size * mixture.UNIT // len(active)
            n = min(deficit[q] // mixture.UNIT, left[q])
            deficit[q] -= n * mixture.UNIT
            left[q] -= n
            out.append((k, q, n))
        k += 1
    return out


@pytest.mark.parametrize("seed", range(60))
def test_rounds_are_the_loop(seed):
    rng = random.Random(seed)
    size = rng.choice([4, 16, 64, 2048])
    totals = [rng.choice([0, 1, rng.randint(0, 40), rng.randint(0, 3000)]) for _ in range(rng.randint(1, 7))]
    weights = totals if rng.random() < 0.4 else [rng.choice([0, 1, rng.randint(1, 1000)]) for _ in totals]
    if not any(w for w, t in zip(weights, totals, strict=True) if t) and seed % 2:
        weights = totals
    if max(totals) > 200 and any(t and w * size * 200 < sum(weights) for t, w in zip(totals, weights, strict=True)):
        totals = [min(t, 3) for t in totals]
        weights = [max(w, 1) for w in weights]
    stream = [(q, k) for k, q, n in turns(totals, weights, size) for _ in range(n)]
    rounds = mixture.Rounds(totals, weights, size)
    # documents over the queues' tokens
    q, first, n = [], [], []
    for queue, total in enumerate(totals):
        at = 0
        while at < total:
            m = min(rng.choice([1, 2, rng.randint(1, 50), rng.randint(1, 2000)]), total - at)
            q.append(queue)
            first.append(at)
            n.append(m)
            at += m
    order = list(range(len(q)))
    rng.shuffle(order)
    q, first, n = (np.array([x[i] for i in order], np.int64) for x in (q, first, n))
    row, start, length, window, offset = rounds.place(q, first, n, size)
    places = {}
    for r, s, m, w, o in zip(row, start, length, window, offset, strict=True):
        assert m > 0 and o + m <= size
        for i in range(m):
            assert places.setdefault(int(w * size + o + i), (int(q[r]), int(first[r] + s + i))) == (int(q[r]), int(first[r] + s + i))
    want, seen = {}, Counter()
    for pos, (queue, _) in enumerate(stream):
        want[pos] = (queue, seen[queue])
        seen[queue] += 1
    assert places == want
    for a, b in zip(range(len(row)), range(1, len(row)), strict=False):  # no cut without need
        assert not (row[a] == row[b] and window[a] == window[b] and offset[a] + length[a] == offset[b])


def test_rounds_in_blocks(monkeypatch):
    """Pieces are the same whatever the number of rows worked on at a time, and a queue of few tokens may wait for many rounds."""
    rounds = mixture.Rounds([100_000, 50, 7000], [10**6, 1, 10**4], 64)
    q, first, n = np.array([0, 1, 2, 1, 0]), np.array([0, 0, 0, 20, 60_000]), np.array([60_000, 20, 7000, 30, 40_000])
    whole = rounds.place(q, first, n, 64)
    monkeypatch.setattr(mixture, "BLOCK", 1)
    assert all((a == b).all() for a, b in zip(whole, rounds.place(q, first, n, 64), strict=True))
    assert sum(whole[2]) == n.sum()


def check_pieces(rows, out, size=2048):
    tok = Tokenizer.from_file(JSON)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, _ in rows}
    covered, windows = {}, {}
    for r in out:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for s, m in sorted(covered[i]):
            assert s == at
            at += m
        assert at == len(own)
    for places in windows.values():
        at = 0
        for o, m in sorted(places):
            assert o == at
            at += m
        assert at <= size
    assert len(windows) == -(-sum(map(len, ids.values())) // size)
    return ids


def test_mixture_of_documents(spark):
    """Every id in one piece, no gaps, only the last window short; each window holds its sources' shares."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()] + [(10_000, None, "src0"), (10_001, "", None), (10_002, "a <|endoftext|> b " * 900, "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixture.pack(clash(df), JSON, public_tokenizers.PATTERN).collect()
    ids = check_pieces(rows, out)
    source = {i: s or "" for i, _, s in rows}
    totals, got = Counter(), {}
    for i, own in ids.items():
        totals[source[i]] += len(own)
    for r in out:
        got.setdefault(r.sequence_id, Counter())[source[r.doc_id]] += r.length
    whole, last = sum(totals.values()), max(got)
    for w, held in got.items():
        if w < last - 1:
            assert all(abs(held[s] - 2048 * t / whole) <= len(totals) + 2 for s, t in totals.items()), (w, held)


def test_mixture_targets(spark):
    """Named sources get their proportions until they run dry; the rest shares one queue."""
    rows = [(i, "word " * 300, f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixture.pack(df, JSON, public_tokenizers.PATTERN, targets={"s0": 0.5, "s1": 0.2}).collect()
    check_pieces(rows, out)
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, Counter())[r.queue] += r.length
    early = [held[w] for w in range(20)]
    assert all(abs(h[0] - 1024) <= 4 and abs(h[1] - 409.6) <= 4 and abs(h[2] - 614.4) <= 4 for h in early)
    assert all(h[0] == 0 for w, h in held.items() if w > max(held) - 10)  # s0 is dry by then
    with pytest.raises(ValueError):
        mixture.pack(df, JSON, public_tokenizers.PATTERN, targets={"s0": 0.9, "s1": 0.2})


def test_mixture_odd_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mixture.pack(spark.createDataFrame([], schema), JSON, public_tokenizers.PATTERN).count() == 0
    rows = [(1, "same", "a"), (1, "same", "a"), (None, "x", None), (2, "w " * 20_000, "b")]
    out = mixture.pack(clash(spark.createDataFrame(rows, schema)), JSON, public_tokenizers.PATTERN).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == 4 and sum(r.length for r in out if r.doc_id is None) == 2
    assert sum(r.length for r in out if r.doc_id == 2) == [r.doc_tokens for r in out if r.doc_id == 2][0]
    # more sources than queues: the rest shares the last one
    many = [(i, "one two three", f"s{i % 40}") for i in range(200)]
    out = mixture.pack(spark.createDataFrame(many, schema), JSON, public_tokenizers.PATTERN, queues=8).collect()
    check_pieces(many, out)
    assert {r.queue for r in out} == set(range(8))


def test_mixture_base_as_a_join(spark, monkeypatch):
    """What the partitions hold may be too large to be sent to all: the same rows by a join."""
    rows = [(i, f"text {i} " * (i % 7), f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).cache()
    one = sorted(map(tuple, mixture.pack(df, JSON, public_tokenizers.PATTERN).collect()))
    monkeypatch.setattr(mixture, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, mixture.pack(df, JSON, public_tokenizers.PATTERN).collect())) == one


# --------------------------------------------------------------------- whitening


def plain_whitening(vectors, k=4):
    """By full eigenvectors: n, sums, trace, values and components of distinct whole vectors."""
    x = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array(x, float) - np.array([float(Fraction(s, n)) for s in sums])
    values, found = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1][:k], found.T[::-1][:k], values.sum()


def check_whitening(got, rows, k=4):
    n, sums, values, components, trace = plain_whitening([v for _, v in rows], k)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    want = {}
    for i, v in rows:
        x = [math.floor(256 * float(c)) for c in v]
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        want[i] = dev, (np.array(x, float) - np.array(sums) / n) @ components.T / np.sqrt(values)
    for c, own in by.items():
        assert sorted(r.vec_id for r in own) == sorted(i for i, _ in rows)
        sign = np.sign(sum(r.whitened * want[r.vec_id][1][c - 1] for r in own))
        for r in own:
            assert r.n == n and r.deviation == want[r.vec_id][0]
            assert abs(r.whitened * sign - want[r.vec_id][1][c - 1]) < 1e-8
            assert abs(r.explained / (values[c - 1] / trace) - 1) < 1e-9
            assert r.identity_error < 1e-9


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op12_whitening(spark, SF).collect(), rows)


def test_whitening_paths(spark):
    """A falling spectrum ends by residuals, a flat one needs the full dimension; copies don't count."""
    rng = np.random.default_rng(5)
    schema = "vec_id long, embedding array<double>"
    for fall, expanded in ((0.35, False), (1.0, True)):
        x = rng.standard_normal((600, 40)) * fall ** np.arange(40) * 40 + 3
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows + rows[:50] + [(7, rows[3][1])] * 200, schema)
        held = whitening.vectors(df).select("_x").distinct().cache()
        model = whitening.fit(held)
        assert model.expanded == expanded and model.n == 600 and model.passes <= whitening.PASSES + 1
        check_whitening(whitening.whiten(clash(spark.createDataFrame(rows, schema))).collect(), rows)


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<double>"
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 0.25]), (2, [0.0, -1.0, 0.25]), (None, [3.0, 1.0, 9.0])]
    bad = [(10, None), (11, [1.0, None, 2.0]), (12, [nan, 1.0, 1.0]), (13, [1.0, inf, 1.0]), (14, []), (15, [1.0, 2.0]), (16, [1.0, -inf, 0.0])]
    got = whitening.whiten(clash(spark.createDataFrame(good + bad, schema))).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in good for c in (1, 2, 3))
    assert all(r.whitened is None and r.explained == 0 for r in got if r.component == 3) and all(r.identity_error < 1e-9 for r in got)  # three points have rank 2
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame(bad[:5], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame(good[:1] * 3, schema)).collect()
    assert len(one) == 9 and all(r.whitened is None and r.identity_error is None and r.explained == 0 and r.deviation == 0 for r in one)
    # large entries: exact where 64 bits hold the deviation, null beyond
    big = [(i, [float(v), 1.0]) for i, v in enumerate([2e6, -3e6, 1e6])]
    n, sums, *_ = plain_whitening([v for _, v in big])
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(big, schema)).collect()}
    assert got == {i: sum((n * math.floor(256 * c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in big}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], schema)).collect()
    assert len(huge) == 4 and all(r.deviation is None for r in huge)


# ------------------------------------------------------------------ periodic runs


def plain_runs(x, least=12):
    found = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p) and j > i:
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(20))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n, kinds = rng.randint(0, 160), rng.choice([1, 2, 2, 3, 5, 40])
        x = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 14 else 0):
            p, s = rng.randint(1, n // 2), rng.randint(0, n - 1)
            for i in range(s + p, rng.randint(s, n)):
                x[i] = x[i - p]
        least = rng.choice([12, 12, 12, 1, 2, 3, 5, 20, 41])
        assert periodic.find_runs(np.array(x, np.int64), least) == plain_runs(x, least)


def test_runs_of_long_texts(monkeypatch):
    """Many copies of one word, a Fibonacci word, long periods; pairs in small portions give the same."""
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    rng = random.Random(2)
    block = [rng.randrange(400) for _ in range(700)]
    for x in ([5] * 3000, b[:1500], block * 2 + block[:300], [rng.randrange(2) for _ in range(1500)]):
        want = plain_runs(x)
        assert periodic.find_runs(np.array(x, np.int64)) == want
        with monkeypatch.context() as m:
            m.setattr(periodic, "PAIRS", 50)
            assert periodic.find_runs(np.array(x, np.int64)) == want
    assert periodic.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def test_stretches():
    rng = random.Random(4)
    for _ in range(300):
        bits = [rng.random() < 0.8 for _ in range(rng.randint(0, 90))]
        least = rng.randint(1, 9)
        want = [(m.start(), m.end()) for m in re.finditer("1{%d,}" % least, "".join("01"[b] for b in bits))]
        assert periodic.stretches(sum(1 << i for i, b in enumerate(bits) if b), least) == want


def plain_row(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def test_periodic_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000 or doc_id % 7 = 0")
    want = [plain_row(r.doc_id, r.text) for r in docs.collect()]
    ids = {r[0] for r in want}
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect() if r.doc_id in ids]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in want) > 10


def test_periodic_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b " * 6), (5, "a b " * 6), (None, "x " * 13), (7, "w\xa0 v\x1c u\x85 " * 5), (8, "a b\n" * 2000 + "c")]
    got = {r.doc_id: r for r in periodic.find(clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert len(got) == len(rows) - 1
    assert [tuple(r) for r in got[5].runs] == [(0, 12, 2)] and got[5].collapsed == "a b" and got[None].collapsed == "x"
    assert got[1].runs == [] and got[1].collapsed == "" and got[3].collapsed == "" and got[4].collapsed == "one"
    assert [tuple(r) for r in got[7].runs] == [(0, 15, 3)] and got[7].collapsed == "w\xa0 v\x1c u\x85" and got[8].collapsed == "a b c"
    assert periodic.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    planted = [(i, " ".join(f"w{j}" for j in range(40))) for i in range(-40, 40)] + [(None, "a"), (3, None), (100, "z")]
    out = queries.with_repeats(clash(spark.createDataFrame(planted, "doc_id long, text string"))).collect()
    assert len(out) == len(planted) and sum(r.text != t for r, (_, t) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(planted, key=lambda r: (r[0] is None, r[0])), strict=True) if t) > 0
