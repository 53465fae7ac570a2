"""Sequence and frame headers: single cases, state of slots, errors, and the cut into segments."""

import random

import pytest

from strataplane.sources import headers

S = "stream_id string, obu_index long, unit long, type int, temporal_id int, spatial_id int, payload binary"


def data(*parts):
    """Bytes of (value, width) pairs and strings of bits, closed by a one and zeros."""
    text = "".join(p if isinstance(p, str) else f"{p[0] % (1 << p[1]):0{p[1]}b}" for p in parts) + "1"
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


#: 640 x 360 reduced still picture without tools, and 64 x 64 streams with order hints of 4 bits, motion vectors of references, warped motion.
STILL = data("000", "11", "00000", (9, 4), (8, 4), (639, 10), (359, 9), "000", "000", "0", "0", "0", "0", "00", "0", "0")


def inter_sequence(grain=0):
    return data("000", "00", "0", "0", "00000", "0" * 12, "00101", (5, 4), (5, 4), (63, 6), (63, 6), "0", "000", "0010", "1", "01", "0", "0", (3, 3), "100", "0", "0", "0", "0", "00", "0", (grain, 1))


def sequence(payload):
    return headers.sequence_header(payload)


def slot(hint, **more):
    """A stored header with what frames inherit."""
    size = {"upscaled_width": 64, "width": 64, "height": 64, "render_width": 66, "render_height": 68, "denominator": 8}
    plain = {"features": [[None] * 8 for _ in range(8)]}
    return {"order_hint": hint, "frame_type": 0, "frame_id": None, "size": size, "segmentation": plain, "filter": {"ref_deltas": [1, 0, 0, 0, -1, 0, -1, -1], "mode_deltas": [0, 0]}, "motion": [{"kind": 0, "params": list(headers.STILL)}] * 7, "grain": {"apply": False, "y": []}} | more


HINTS = [9, 8, 7, 11, 12, 13, 14, 15]
SLOTS = [slot(h) for h in HINTS]


def inter(refs=None, short=False, motion="0" * 7, after=""):
    names = [(0, 3), (3, 3)] if short else [(i, 3) for i in (refs or range(7))]
    lead = ["0", (1, 2), "1", "0", "1", "1", (10, 4), (7, 3), (0x12, 8), (short, 1), *names, "1", "0", "1", "1"]
    tail = ["1", "1", "1", (0, 8), "0", "0", "0", "0", "0", "1", "1", "1", "0", motion, after]
    return data(*lead, *tail)


def test_reduced_still():
    h = headers.frame_header(data("1", "0", "0", "1", "00", (0, 8), "0", "0", "0", "0", "0", "0"), sequence(STILL), [None] * 8)
    assert (h["frame_type"], h["shown"], h["showable"], h["error_resilient"], h["cdf_update_off"], h["integer_mv"], h["primary_ref"], h["refresh"]) == (0, True, False, True, True, True, 7, 255)
    assert h["size"] == {"width": 640, "upscaled_width": 640, "height": 360, "render_width": 640, "render_height": 360, "denominator": 8}
    assert h["tiling"] == {"uniform": True, "columns": 1, "rows": 1, "log2_columns": 0, "log2_rows": 0, "column_starts": [0, 10], "row_starts": [0, 6], "context_tile": 0, "size_bytes": 0}
    assert h["quantiser"]["base"] == 0 and not h["segmentation"]["enabled"] and h["all_lossless"] and h["transform_mode"] == "only_4x4" and h["filter"]["deltas"] and not h["refresh_context"] and not h["grain"]["apply"]


def test_feature_of_value_zero():
    features = "0" * 16 + "1" + "0" * 9 + "0" * 7 + "0" * 40
    h = headers.frame_header(data("1", "0", "0", "1", "00", (0, 8), "0", "0", "0", "0", "1" + features, "0" * 20), sequence(STILL), [None] * 8)
    s = h["segmentation"]
    assert s["enabled"] and s["update_map"] and s["update_data"] and not s["preskip"] and s["last"] == 2 and s["features"][2][0] == 0 and s["index"][2] == 0


def test_size_of_a_reference():
    h = headers.frame_header(inter(), sequence(inter_sequence()), SLOTS)
    assert h["size"] == {"upscaled_width": 64, "height": 64, "render_width": 66, "render_height": 68, "denominator": 8, "width": 64}
    assert h["refs"] == list(range(7)) and h["order_hint"] == 10 and h["refresh"] == 0x12 and h["high_precision"] and h["interpolation"] == 4 and h["switchable_motion"] and h["ref_mvs"]
    assert h["compound"] and h["skip_allowed"] and h["skip_mode"] and h["skip_refs"] == [0, 3] and h["warped"] and not h["reduced_transforms"]
    with pytest.raises(ValueError, match="gives the size"):
        headers.frame_header(inter(), sequence(inter_sequence()), [None, *SLOTS[1:]])


def test_short_references():
    """Ties and missing directions: a plain search over the published order of choices."""
    rng = random.Random(1)
    for _ in range(400):
        d = [rng.randint(-6, 6) for _ in range(8)]
        last, golden = rng.sample(range(8), 2)
        got = headers.short_references(d, last, golden)
        used, want = {last, golden}, {0: last, 3: golden}

        def choose(place, better, ok):
            best = None
            for i in range(8):
                if i not in used and ok(d[i]) and (best is None or better(d[i], d[best])):
                    best = i
            if best is not None:
                want[place] = best
                used.add(best)

        choose(6, lambda a, b: a >= b, lambda x: x >= 0)
        choose(4, lambda a, b: a < b, lambda x: x >= 0)
        choose(5, lambda a, b: a < b, lambda x: x >= 0)
        for place in (1, 2, 4, 5, 6):
            if place not in want:
                choose(place, lambda a, b: a >= b, lambda x: x < 0)
        assert got == [want.get(i, d.index(min(d))) for i in range(7)]
    h = headers.frame_header(inter(short=True), sequence(inter_sequence()), [slot(x) for x in (9, 14, 12, 11, 13, 9, 8, 7)])
    assert h["short_signalling"] and h["refs"] == [0, 5, 6, 3, 2, 4, 1]
    with pytest.raises(ValueError, match="all slots"):
        headers.frame_header(inter(short=True), sequence(inter_sequence()), [None, *SLOTS[1:]])


def test_translation():
    h = headers.frame_header(inter(motion="101" + "0001" + "0010" + "0" * 6), sequence(inter_sequence()), SLOTS)
    assert h["motion"][0] == {"kind": 1, "params": [-(1 << 13), 1 << 13, 1 << 16, 0, 0, 1 << 16]} and all(m["kind"] == 0 for m in h["motion"][1:])


def near_code(v, limit, reference):
    """Bits that stand for ``v``: by trying all codes of the interval it falls in."""
    for steps in range(20):
        base = 0 if not steps else 8 << (steps - 1)
        step = 3 if steps < 2 else steps + 2
        last = 2 * limit + 1 <= base + (3 << step)
        head = "1" * steps + ("" if last else "0")
        for x in range(1 << step) if not last else range(2 * limit + 1 - base):
            if last:
                n = 2 * limit + 1 - base
                w = n.bit_length()
                short = (1 << w) - n
                code = f"{x:0{w - 1}b}" if x < short else f"{x + short:0{w}b}"
            else:
                code = f"{x:0{step}b}"
            text = head + code
            if headers.Bits(int(text.ljust(64, "0"), 2).to_bytes(8, "big")).near(limit, reference) == v:
                return text
        if last:
            return None


@pytest.mark.parametrize("reference", [-9, -3, 0, 1, 8, 16, -16])
def test_near_numbers(reference):
    """Every number has one code, codes are free of prefixes, and nearer numbers have no longer ones."""
    codes = {v: near_code(v, 16, reference) for v in range(-16, 17)}
    assert None not in codes.values()
    found = sorted(codes.values())
    assert all(not b.startswith(a) for a, b in zip(found, found[1:], strict=False))
    inside = [v for v in codes if abs(v - reference) <= min(16 - abs(reference), 16)]
    assert all(len(codes[a]) <= len(codes[b]) + 1 for a in inside for b in inside if abs(a - reference) < abs(b - reference))


def test_bits():
    for n in range(1, 40):
        codes = []
        w = n.bit_length()
        for v in range(n):
            short = (1 << w) - n
            text = (f"{v:0{w - 1}b}" if w > 1 else "") if v < short else f"{v + short:0{w}b}"
            b = headers.Bits(int((text + "1").ljust(16, "0"), 2).to_bytes(2, "big"))
            assert b.below(n) == v and b.at == len(text)
            codes.append(text)
        assert len(set(codes)) == n
    assert headers.Bits(b"\0\0\0\0\x80").uvlc() == (1 << 32) - 1
    assert [headers.Bits(bytes([x])).uvlc() for x in (0x80, 0x40, 0x60, 0x20, 0x38)] == [0, 1, 2, 3, 6]
    assert headers.Bits(b"\xfe").s(7) == -1 and headers.Bits(b"\x7e").s(7) == 63
    with pytest.raises(ValueError, match="early"):
        headers.Bits(b"\xff").u(9)


def test_inherited_segments_and_deltas():
    features = [[None] * 8 for _ in range(8)]
    features[2][0], features[2][5], features[2][6] = 11, 3, 0
    first = slot(9, segmentation={"features": features}, filter={"ref_deltas": [2, 1, 0, -1, -2, 0, 1, 2], "mode_deltas": [3, -3]})
    payload = data("0", (1, 2), "1", "0", "1", "0", (10, 4), (0, 3), (0, 8), "0", *[(i, 3) for i in range(7)], "0", "0", "0", "000", "0", "0", "1", (20, 8), "0", "0", "0", "0", "1", "0", "0", "0", (0, 6), (0, 6), "000", "1", "0", "0", "0", "0", "0", "0" * 7)
    h = headers.frame_header(payload, sequence(inter_sequence()), [first, *SLOTS[1:]])
    s = h["segmentation"]
    assert s["enabled"] and not s["update_map"] and not s["update_data"] and s["preskip"] and s["last"] == 2 and s["features"][2] == features[2] and s["index"][2] == 31 and s["index"][0] == 20
    assert h["filter"]["ref_deltas"] == [2, 1, 0, -1, -2, 0, 1, 2] and h["filter"]["mode_deltas"] == [3, -3] and not h["skip_allowed"]
    with pytest.raises(ValueError, match="primary"):
        headers.frame_header(payload, sequence(inter_sequence()), [None, *SLOTS[1:]])


GRAIN = ["1", (0x1234, 16), "1", (2, 4), (16, 8), (32, 8), (128, 8), (200, 8), "0", (1, 4), (64, 8), (80, 8), (1, 4), (96, 8), (112, 8), (2, 2), (1, 2), *[(128 + i, 8) for i in range(4)], *[(120 + i, 8) for i in range(5)], *[(100 + i, 8) for i in range(5)], (1, 2), (3, 2), (77, 8), (88, 8), (300, 9), (66, 8), (55, 8), (123, 9), "1", "0"]


def grained(*parts):
    text = "".join(p if isinstance(p, str) else f"{p[0]:0{p[1]}b}" for p in parts)
    return inter(after=text)


def test_grain():
    q = sequence(inter_sequence(grain=1))
    g = headers.frame_header(grained(*GRAIN), q, SLOTS)["grain"]
    assert g["apply"] and g["seed"] == 0x1234 and g["y"] == [{"value": 16, "scaling": 32}, {"value": 128, "scaling": 200}] and g["cb"] == [{"value": 64, "scaling": 80}] and g["cr"] == [{"value": 96, "scaling": 112}]
    assert (g["scaling_shift"], g["lag"], g["ar_shift"], g["scale_shift"]) == (10, 1, 7, 3) and g["ar_y"] == [0, 1, 2, 3] and g["ar_cb"] == [-8, -7, -6, -5, -4]
    assert [g[k] for k in ("cb_mult", "cb_luma_mult", "cb_offset", "cr_mult", "cr_luma_mult", "cr_offset")] == [-51, -40, 44, -62, -73, -133] and g["overlap"] and not g["clip"]
    stored = [*SLOTS[:3], slot(11, grain=g), *SLOTS[4:]]
    again = headers.frame_header(grained("1", (0x4567, 16), "0", (3, 3)), q, stored)["grain"]
    assert again == g | {"seed": 0x4567, "update": False, "reference": 3}
    with pytest.raises(ValueError, match="not one of"):
        headers.frame_header(grained("1", (1, 16), "0", (7, 3)), q, stored)
    for wrong, text in ((["1", (1, 16), "1", (2, 4), (16, 8), (1, 8), (16, 8), (1, 8)], "increase"), (["1", (1, 16), "1", (15, 4)], "too many"), (["1", (1, 16), "1", (1, 4), (1, 8), (1, 8), "0", (0, 4), (1, 4), (9, 8), (9, 8)], "one chroma")):
        with pytest.raises(ValueError, match=text):
            headers.frame_header(grained(*wrong), q, SLOTS)


KEY = data("0001", "1", "0", (3, 4), "0", "0", "1", (7, 8), "0", "0", "0", "0", "0", "0", "0" * 12, "000", "0", "0", "0", "0")


def test_walk(spark):
    """Two segments of one stream, one broken; what a slot lacks; other records and odd rows."""
    rows = [("a", 0, 0, 1, 0, 0, inter_sequence()), ("a", 1, 0, 3, 0, 0, KEY), ("a", 2, 1, 6, 0, 0, inter() + b"samples" * 2000), ("a", 3, 2, 3, 0, 0, b"\x30"), ("a", 4, 3, 3, 0, 0, inter())]
    rows += [("a", 5, 4, 1, 0, 0, inter_sequence()), ("a", 6, 4, 3, 0, 0, KEY), ("a", 7, 5, 3, 0, 0, data("1", (2, 3))), ("a", 8, 5, 4, 0, 0, b"tile")]
    rows += [("b", 0, 0, 3, 0, 0, KEY), ("c", 0, 0, 1, 0, 0, None), ("d", 0, None, 1, 0, 0, inter_sequence()), ("d", 1, None, 3, 0, 0, inter())]
    got = {(r.stream_id, r.obu_index): r for r in headers.headers(spark.createDataFrame(rows, S)).collect()}
    assert len(got) == 12
    assert got["a", 1].header.frame_type == 0 and got["a", 2].header.size.render_width == 64 and got["a", 2].header.header_bits == 74
    assert got["a", 3].error == "a header ends early" and "earlier" in got["a", 4].error
    assert got["a", 6].header.order_hint == 3 and got["a", 7].header.show_existing and got["a", 7].header.refresh == 255 and got["a", 7].header.quantiser.base == 7
    assert got["b", 0].error == "no sequence header" and got["c", 0].error == "a header ends early" and "not there" in got["d", 1].error
    assert headers.headers(spark.createDataFrame([], S)).count() == 0
    assert headers.headers(spark.createDataFrame(rows, S), ("size",)).where("type = 3").select("header.*").columns == ["size"]


def test_every_cut_is_an_error():
    """A header that ends anywhere before its end raises ValueError, nothing else."""
    q = sequence(inter_sequence(grain=1))
    whole = grained(*GRAIN)
    for n in range(len(whole)):
        with pytest.raises(ValueError):
            headers.frame_header(whole[:n], q, SLOTS)
    rng = random.Random(7)
    for _ in range(3000):
        noise = bytes(rng.randrange(256) for _ in range(rng.randint(0, 120)))
        try:
            headers.frame_header(noise, q, [rng.choice([None, s]) for s in SLOTS])
        except ValueError:
            pass
        try:
            headers.sequence_header(noise)
        except ValueError:
            pass
