"""Sequence and frame headers of coded-video records, with what frames inherit from reference slots.

A header is a run of bits whose widths depend on what was read before and on eight slots that hold the headers of earlier frames.  The syntax
follows the published specification of the format (its clauses on sequence and uncompressed headers).  Only the first HEAD bytes of a record are
needed, so the coded samples behind a header are cut off before anything is shuffled.

A stream is cut where a unit holds a sequence header and a shown key frame, which replaces all slots; the segments between such units don't depend on each other.
Each task reads the short segments that it holds in step (``header_batches``), and walks the others in order with the slots of one segment at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strataplane.operators.container import sum_before
from strataplane.sources import header_batches as batches

#: A frame header has at most some 1200 bytes: 8 x 8 segment features, 128 tile sizes, 7 motions of 6 values and 34 grain points take under 600.
HEAD = 2048
SEQUENCE, FRAME_HEADER, FRAME = 1, 3, 6
KEY, INTER, INTRA_ONLY, SWITCH = range(4)
NO_PRIMARY = 7

# Fixed values of the format: bits and limits of segment features (the first five are signed), default deltas of the edge filter by reference,
# precision of motion (bits after the point of translations alone, translations, other parameters).
FEATURE_BITS = (8, 6, 6, 6, 6, 3, 0, 0)
FEATURE_LIMIT = (255, 63, 63, 63, 63, 7, 0, 0)
SIGNED_FEATURES, REFERENCE_FEATURE = 5, 5
REF_DELTAS, MODE_DELTAS = (1, 0, 0, 0, -1, 0, -1, -1), (0, 0)
STILL = (0, 0, 1 << 16, 0, 0, 1 << 16)
RESTORATION = ("none", "switchable", "wiener", "self_guided")
TILE_WIDTH, TILE_AREA, MOST_TILES = 4096, 4096 * 2304, 64

SEQUENCE_FIELDS = (
    "profile int, still_picture boolean, reduced boolean, timing_ticks long, timing_scale long, equal_interval boolean, decoder_model boolean, removal_bits int, presentation_bits int,"
    " points array<struct<idc:int,level:int,tier:int,decoder_model:boolean>>, width_bits int, height_bits int, max_width int, max_height int, frame_ids boolean, id_bits int, delta_id_bits int,"
    " large_blocks boolean, filter_intra boolean, intra_edge boolean, interintra boolean, masked_compound boolean, warped boolean, dual_filter boolean, order_bits int, joint_compound boolean, ref_mvs boolean,"
    " screen_content int, integer_mv int, superres boolean, cdef boolean, restoration boolean, depth int, monochrome boolean, primaries int, transfer int, matrix int, full_range boolean, sub_x int, sub_y int, chroma_position int, separate_uv boolean, grain boolean"
)
_POINTS = "array<struct<value:int,scaling:int>>"
GRAIN_FIELDS = f"apply:boolean,seed:int,update:boolean,reference:int,y:{_POINTS},from_luma:boolean,cb:{_POINTS},cr:{_POINTS},scaling_shift:int,lag:int,ar_y:array<int>,ar_cb:array<int>,ar_cr:array<int>,ar_shift:int,scale_shift:int,cb_mult:int,cb_luma_mult:int,cb_offset:int,cr_mult:int,cr_luma_mult:int,cr_offset:int,overlap:boolean,clip:boolean"
FRAME_FIELDS = (
    "show_existing boolean, existing_slot int, frame_id long, presentation_time long, frame_type int, shown boolean, showable boolean, error_resilient boolean, cdf_update_off boolean, screen_content boolean, integer_mv boolean,"
    " size_override boolean, order_hint int, primary_ref int, refresh int, short_signalling boolean, refs array<int>, reference_frames array<struct<order_hint:int,width:int,height:int>>,"
    " size struct<width:int,upscaled_width:int,height:int,render_width:int,render_height:int,denominator:int>,"
    " intra_copy boolean, high_precision boolean, interpolation int, switchable_motion boolean, ref_mvs boolean, refresh_context boolean,"
    " tiling struct<uniform:boolean,columns:int,rows:int,log2_columns:int,log2_rows:int,column_starts:array<int>,row_starts:array<int>,context_tile:int,size_bytes:int>,"
    " quantiser struct<base:int,y_dc:int,u_dc:int,u_ac:int,v_dc:int,v_ac:int,matrices:boolean,level_y:int,level_u:int,level_v:int>,"
    " segmentation struct<enabled:boolean,update_map:boolean,temporal:boolean,update_data:boolean,features:array<array<int>>,preskip:boolean,last:int,index:array<int>,lossless:array<boolean>>,"
    " delta struct<q:boolean,q_shift:int,filter:boolean,filter_shift:int,filter_multi:boolean>, coded_lossless boolean, all_lossless boolean,"
    " filter struct<levels:array<int>,u:int,v:int,sharpness:int,deltas:boolean,update:boolean,ref_deltas:array<int>,mode_deltas:array<int>>,"
    " cdef struct<damping:int,bits:int,y_primary:array<int>,y_secondary:array<int>,uv_primary:array<int>,uv_secondary:array<int>>,"
    " restoration struct<kinds:array<string>,luma_bits:int,chroma_bits:int>, transform_mode string, compound boolean, skip_allowed boolean, skip_mode boolean, skip_refs array<int>, warped boolean, reduced_transforms boolean,"
    f" motion array<struct<kind:int,params:array<int>>>, grain struct<{GRAIN_FIELDS}>, header_bits int"
)


class Bits:
    """A cursor over the bits of a record, most significant first; ValueError past the end."""

    def __init__(self, data: bytes):
        self.value, self.n = int.from_bytes(data, "big"), 8 * len(data)
        self.at = 0

    def u(self, n: int) -> int:
        self.at += n
        if self.at > self.n:
            raise ValueError("a header ends early")
        return self.value >> (self.n - self.at) & ((1 << n) - 1)

    def flag(self) -> bool:
        return bool(self.u(1))

    def s(self, n: int) -> int:
        """Two's complement of n bits."""
        v = self.u(n)
        return v - (v >> (n - 1) << n)

    def below(self, n: int) -> int:
        """A number under n in as few bits as its size allows."""
        w = n.bit_length()
        short = (1 << w) - n
        v = self.u(w - 1)
        return v if v < short else 2 * v - short + self.u(1)

    def uvlc(self) -> int:
        zeros = 0
        while not self.flag():
            zeros += 1
        return (1 << 32) - 1 if zeros >= 32 else (1 << zeros) - 1 + self.u(zeros)

    def near(self, limit: int, reference: int) -> int:
        """A number in -limit..limit, coded by its distance from ``reference``."""
        symbols, r = 2 * limit + 1, reference + limit
        base, step = 0, 3
        while symbols > base + 3 * (1 << step):
            if not self.flag():
                v = base + self.u(step)
                break
            base += 1 << step
            step += base > 8  # the first two intervals have 8 numbers each
        else:
            v = base + self.below(symbols - base)
        mirrored = 2 * r > symbols
        c = symbols - 1 - r if mirrored else r
        out = v if v > 2 * c else c - (v + 1 >> 1) if v & 1 else c + (v >> 1)
        return (symbols - 1 - out if mirrored else out) - limit


def sequence_header(data: bytes) -> dict:
    """SEQUENCE_FIELDS of a sequence header record."""
    b = Bits(data)
    q: dict = {"profile": b.u(3), "still_picture": b.flag(), "reduced": b.flag()}
    if q["profile"] > 2:
        raise ValueError("an unknown profile")
    q |= {"timing_ticks": None, "timing_scale": None, "equal_interval": False, "decoder_model": False, "removal_bits": 0, "presentation_bits": 0}
    full = not q["reduced"]
    if not full:
        q["points"] = [{"idc": 0, "level": b.u(5), "tier": 0, "decoder_model": False}]
    else:
        delay_bits = 0
        if b.flag():
            q |= {"timing_ticks": b.u(32), "timing_scale": b.u(32), "equal_interval": b.flag()}
            if q["equal_interval"]:
                b.uvlc()
            q["decoder_model"] = b.flag()
            if q["decoder_model"]:
                delay_bits = b.u(5) + 1
                b.u(32)
                q |= {"removal_bits": b.u(5) + 1, "presentation_bits": b.u(5) + 1}
        display_delay = b.flag()
        q["points"] = []
        for _ in range(b.u(5) + 1):
            point = {"idc": b.u(12), "level": b.u(5)}
            point["tier"] = b.u(1) if point["level"] > 7 else 0
            point["decoder_model"] = q["decoder_model"] and b.flag()
            if point["decoder_model"]:
                b.u(2 * delay_bits + 1)
            if display_delay and b.flag():
                b.u(4)
            q["points"].append(point)
    q |= {"width_bits": b.u(4) + 1, "height_bits": b.u(4) + 1}
    q |= {"max_width": b.u(q["width_bits"]) + 1, "max_height": b.u(q["height_bits"]) + 1}
    q |= {"frame_ids": full and b.flag(), "id_bits": 0, "delta_id_bits": 0}
    if q["frame_ids"]:
        q["delta_id_bits"] = b.u(4) + 2
        q["id_bits"] = q["delta_id_bits"] + b.u(3) + 1
    q |= {k: b.flag() for k in ("large_blocks", "filter_intra", "intra_edge")}
    q |= {k: full and b.flag() for k in ("interintra", "masked_compound", "warped", "dual_filter")}
    ordered = full and b.flag()
    q |= {k: ordered and b.flag() for k in ("joint_compound", "ref_mvs")}
    q |= {"screen_content": 2, "integer_mv": 2, "order_bits": 0}
    if full:
        q["screen_content"] = 2 if b.flag() else b.u(1)
        if q["screen_content"]:
            q["integer_mv"] = 2 if b.flag() else b.u(1)
        if ordered:
            q["order_bits"] = b.u(3) + 1
    q |= {k: b.flag() for k in ("superres", "cdef", "restoration")}
    q |= _colours(b, q["profile"])
    return q | {"grain": b.flag()}


def _colours(b: Bits, profile: int) -> dict:
    high = b.flag()
    depth = 12 if profile == 2 and high and b.flag() else 10 if high else 8
    q = {"depth": depth, "monochrome": profile != 1 and b.flag(), "primaries": 2, "transfer": 2, "matrix": 2, "sub_x": 1, "sub_y": 1, "chroma_position": 0, "separate_uv": False}
    if b.flag():
        q |= {"primaries": b.u(8), "transfer": b.u(8), "matrix": b.u(8)}
    if q["monochrome"]:
        return q | {"full_range": b.flag()}
    if (q["primaries"], q["transfer"], q["matrix"]) == (1, 13, 0):  # RGB in full range
        q |= {"full_range": True, "sub_x": 0, "sub_y": 0}
    else:
        q["full_range"] = b.flag()
        if profile == 1:
            q |= {"sub_x": 0, "sub_y": 0}
        elif profile == 2:
            q["sub_x"] = b.u(1) if depth == 12 else 1
            q["sub_y"] = b.u(1) if depth == 12 and q["sub_x"] else 0
        if q["sub_x"] and q["sub_y"]:
            q["chroma_position"] = b.u(2)
    return q | {"separate_uv": b.flag()}


def _distance(q: dict, a: int, b: int) -> int:
    """a - b on the circle of order hints."""
    if not q["order_bits"]:
        return 0
    half = 1 << (q["order_bits"] - 1)
    return ((a - b + half) & (2 * half - 1)) - half


def short_references(hints: list[int], last: int, golden: int) -> list[int]:
    """The seven references where a header names two: ``hints`` are the slots' distances from the frame.

    Backward references take the furthest frame ahead, then the nearest ones; forward ones the nearest frames behind; what is
    left repeats the earliest frame.
    """
    out: list[int | None] = [None] * 7
    out[0], out[3] = last, golden
    free = [i for i in range(8) if i not in (last, golden)]

    def take(place: int, chosen: list[int]) -> None:
        if chosen:
            out[place] = chosen[0]
            free.remove(chosen[0])

    ahead = lambda: [i for i in free if hints[i] >= 0]
    take(6, sorted(ahead(), key=lambda i: (-hints[i], -i)))
    take(4, sorted(ahead(), key=lambda i: (hints[i], i)))
    take(5, sorted(ahead(), key=lambda i: (hints[i], i)))
    for place in (1, 2, 4, 5, 6):
        if out[place] is None:
            take(place, sorted((i for i in free if hints[i] < 0), key=lambda i: (-hints[i], -i)))
    earliest = min(range(8), key=lambda i: (hints[i], i))
    return [earliest if i is None else i for i in out]


def frame_header(data: bytes, q: dict, slots: list[dict | None], temporal: int = 0, spatial: int = 0) -> dict:
    """FRAME_FIELDS of a frame header under the sequence header ``q`` and the headers in the eight slots; ValueError says what is wrong."""
    b = Bits(data)
    h: dict = {"show_existing": not q["reduced"] and b.flag(), "frame_id": None, "presentation_time": None}
    timed = q["decoder_model"] and not q["equal_interval"]
    if h["show_existing"]:
        h["existing_slot"] = b.u(3)
        if timed:
            h["presentation_time"] = b.u(q["presentation_bits"])
        stored = slots[h["existing_slot"]]
        if q["frame_ids"]:
            h["frame_id"] = b.u(q["id_bits"])
        if stored is None:
            raise ValueError("the frame to show is not there")
        if q["frame_ids"] and stored["frame_id"] != h["frame_id"]:
            raise ValueError("the frame to show has another id")
        # what is shown again has the stored fields; a key frame refreshes all slots
        return stored | h | {"shown": True, "showable": False, "refresh": 0xFF if stored["frame_type"] == KEY else 0, "header_bits": b.at}
    h |= {"existing_slot": None, "frame_type": KEY, "shown": True, "showable": False, "error_resilient": True}
    if not q["reduced"]:
        h |= {"frame_type": b.u(2), "shown": b.flag()}
        if h["shown"]:
            if timed:
                h["presentation_time"] = b.u(q["presentation_bits"])
            h["showable"] = h["frame_type"] != KEY
        else:
            h["showable"] = b.flag()
        h["error_resilient"] = h["frame_type"] == SWITCH or (h["frame_type"] == KEY and h["shown"]) or b.flag()
    intra = h["frame_type"] in (KEY, INTRA_ONLY)
    h["cdf_update_off"] = b.flag()
    h["screen_content"] = b.flag() if q["screen_content"] == 2 else bool(q["screen_content"])
    h["integer_mv"] = h["screen_content"] and (b.flag() if q["integer_mv"] == 2 else bool(q["integer_mv"]))
    h["integer_mv"] = h["integer_mv"] or intra
    if q["frame_ids"]:
        h["frame_id"] = b.u(q["id_bits"])
    h["size_override"] = h["frame_type"] == SWITCH or (not q["reduced"] and b.flag())
    h["order_hint"] = b.u(q["order_bits"])
    h["primary_ref"] = NO_PRIMARY if intra or h["error_resilient"] else b.u(3)
    if q["decoder_model"] and b.flag():
        for point in q["points"]:
            layers = point["idc"] == 0 or (point["idc"] >> temporal & 1 and point["idc"] >> spatial + 8 & 1)
            if point["decoder_model"] and layers:
                b.u(q["removal_bits"])
    h["refresh"] = 0xFF if h["frame_type"] == SWITCH or (h["frame_type"] == KEY and h["shown"]) else b.u(8)
    if h["frame_type"] == INTRA_ONLY and h["refresh"] == 0xFF:
        raise ValueError("an intra frame refreshes all slots")
    if (not intra or h["refresh"] != 0xFF) and h["error_resilient"] and q["order_bits"]:
        b.u(8 * q["order_bits"])
    h |= {"short_signalling": False, "refs": [], "intra_copy": False, "high_precision": False, "interpolation": 0, "switchable_motion": False, "ref_mvs": False}
    if intra:
        h["size"] = _size(b, q, h)
        h["reference_frames"] = []
        h["intra_copy"] = h["screen_content"] and h["size"]["width"] == h["size"]["upscaled_width"] and b.flag()
    else:
        h |= _references(b, q, h, slots)
        h["reference_frames"] = [slots[i] and {"order_hint": slots[i]["order_hint"], "width": slots[i]["size"]["upscaled_width"], "height": slots[i]["size"]["height"]} for i in h["refs"]]
        h["size"] = _size_of_reference(b, q, h, slots) if h["size_override"] and not h["error_resilient"] else _size(b, q, h)
        h["high_precision"] = not h["integer_mv"] and b.flag()
        h["interpolation"] = 4 if b.flag() else b.u(2)
        h["switchable_motion"] = b.flag()
        h["ref_mvs"] = not h["error_resilient"] and q["ref_mvs"] and b.flag()
    h["refresh_context"] = not q["reduced"] and not h["cdf_update_off"] and not b.flag()
    before = _primary(h, slots)
    h["tiling"] = _tiling(b, q, h["size"])
    h["quantiser"] = _quantiser(b, q)
    h["segmentation"] = _segmentation(b, h, before)
    h["delta"] = _deltas(b, h)
    h["coded_lossless"] = all(h["segmentation"]["lossless"])
    h["all_lossless"] = h["coded_lossless"] and h["size"]["width"] == h["size"]["upscaled_width"]
    h["filter"] = _edge_filter(b, q, h, before)
    h["cdef"] = _cdef(b, q, h)
    h["restoration"] = _restoration(b, q, h)
    h["transform_mode"] = "only_4x4" if h["coded_lossless"] else "select" if b.flag() else "largest"
    h["compound"] = not intra and b.flag()
    h |= _skip_mode(b, q, h, slots)
    h["warped"] = not intra and not h["error_resilient"] and q["warped"] and b.flag()
    h["reduced_transforms"] = b.flag()
    h["motion"] = _motion(b, h, intra, before)
    h["grain"] = _grain(b, q, h, slots)
    return h | {"header_bits": b.at}


def _primary(h: dict, slots: list[dict | None]) -> dict | None:
    """The header whose state the frame begins with; None begins anew."""
    if h["primary_ref"] == NO_PRIMARY:
        return None
    found = slots[h["refs"][h["primary_ref"]]]
    if found is None:
        raise ValueError("the primary reference is not there")
    return found


def _references(b: Bits, q: dict, h: dict, slots: list[dict | None]) -> dict:
    short = bool(q["order_bits"]) and b.flag()
    refs: list[int] = []
    if short:
        last, golden = b.u(3), b.u(3)
        if None in slots:
            raise ValueError("short references need all slots")
        refs = short_references([_distance(q, s["order_hint"], h["order_hint"]) for s in slots], last, golden)
    for i in range(7):
        if not short:
            refs.append(b.u(3))
        if q["frame_ids"]:
            own = (h["frame_id"] - b.u(q["delta_id_bits"]) - 1) % (1 << q["id_bits"])
            if slots[refs[i]] is not None and slots[refs[i]]["frame_id"] != own:
                raise ValueError("a reference has another frame id")
    return {"short_signalling": short, "refs": refs}


def _scaled(b: Bits, q: dict, size: dict) -> dict:
    denominator = b.u(3) + 9 if q["superres"] and b.flag() else 8
    return size | {"denominator": denominator, "width": (size["upscaled_width"] * 8 + denominator // 2) // denominator}


def _size(b: Bits, q: dict, h: dict) -> dict:
    size = {"upscaled_width": q["max_width"], "height": q["max_height"]}
    if h["size_override"]:
        size = {"upscaled_width": b.u(q["width_bits"]) + 1, "height": b.u(q["height_bits"]) + 1}
    size = _scaled(b, q, size)
    if b.flag():
        return size | {"render_width": b.u(16) + 1, "render_height": b.u(16) + 1}
    return size | {"render_width": size["upscaled_width"], "render_height": size["height"]}


def _size_of_reference(b: Bits, q: dict, h: dict, slots: list[dict | None]) -> dict:
    for i in h["refs"]:
        if b.flag():
            if slots[i] is None:
                raise ValueError("the reference that gives the size is not there")
            return _scaled(b, q, {k: slots[i]["size"][k] for k in ("upscaled_width", "height", "render_width", "render_height")})
    return _size(b, q, h)


def _doublings(unit: int, target: int) -> int:
    """The least k with unit << k >= target."""
    return max(0, (-(-target // unit) - 1).bit_length())


def _tiling(b: Bits, q: dict, size: dict) -> dict:
    side = 7 if q["large_blocks"] else 6
    columns, rows = (-(-(-(-size[k] // 8) * 8) // (1 << side)) for k in ("width", "height"))
    widest = TILE_WIDTH >> side
    least_columns, most_columns, most_rows = _doublings(widest, columns), _doublings(1, min(columns, MOST_TILES)), _doublings(1, min(rows, MOST_TILES))
    least = max(least_columns, _doublings(TILE_AREA >> 2 * side, rows * columns))
    uniform = b.flag()

    def even(blocks: int, low: int, high: int) -> tuple[int, list[int]]:
        while low < high and b.flag():
            low += 1
        return low, [*range(0, blocks, blocks + (1 << low) - 1 >> low), blocks]

    def listed(blocks: int, limit: int) -> tuple[int, list[int]]:
        starts = [0]
        while starts[-1] < blocks:
            if len(starts) > MOST_TILES:
                raise ValueError("too many tiles")
            starts.append(starts[-1] + b.below(min(blocks - starts[-1], limit)) + 1)
        return _doublings(1, len(starts) - 1), starts

    if uniform:
        log_columns, at_columns = even(columns, least_columns, most_columns)
        log_rows, at_rows = even(rows, max(least - log_columns, 0), most_rows)
    else:
        log_columns, at_columns = listed(columns, widest)
        area = rows * columns >> least + 1 if least else rows * columns
        log_rows, at_rows = listed(rows, max(area // max(y - x for x, y in zip(at_columns, at_columns[1:], strict=False)), 1))
    context, size_bytes = 0, 0
    if log_columns or log_rows:
        context, size_bytes = b.u(log_columns + log_rows), b.u(2) + 1
    n = (len(at_columns) - 1, len(at_rows) - 1)
    if context >= n[0] * n[1]:
        raise ValueError("the context tile is not there")
    return {"uniform": uniform, "columns": n[0], "rows": n[1], "log2_columns": log_columns, "log2_rows": log_rows, "column_starts": at_columns, "row_starts": at_rows, "context_tile": context, "size_bytes": size_bytes}


def _quantiser(b: Bits, q: dict) -> dict:
    delta = lambda: b.s(7) if b.flag() else 0
    out = {"base": b.u(8), "y_dc": delta(), "u_dc": 0, "u_ac": 0, "v_dc": 0, "v_ac": 0}
    if not q["monochrome"]:
        apart = q["separate_uv"] and b.flag()
        out |= {"u_dc": delta(), "u_ac": delta()}
        out |= {"v_dc": delta(), "v_ac": delta()} if apart else {"v_dc": out["u_dc"], "v_ac": out["u_ac"]}
    out |= {"matrices": b.flag(), "level_y": None, "level_u": None, "level_v": None}
    if out["matrices"]:
        out |= {"level_y": b.u(4), "level_u": b.u(4)}
        out["level_v"] = b.u(4) if q["separate_uv"] else out["level_u"]
    return out


def _segmentation(b: Bits, h: dict, before: dict | None) -> dict:
    out = {"enabled": b.flag(), "update_map": False, "temporal": False, "update_data": False, "features": [[None] * 8] * 8}
    if out["enabled"]:
        out |= {"update_map": True, "update_data": True}
        if before is not None:
            out["update_map"] = b.flag()
            out["temporal"] = out["update_map"] and b.flag()
            out["update_data"] = b.flag()
        if out["update_data"]:
            out["features"] = [[_feature(b, i) for i in range(8)] for _ in range(8)]
        else:
            out["features"] = before["segmentation"]["features"]
    base, quantiser = h["quantiser"]["base"], h["quantiser"]
    used = [(s, i) for s, f in enumerate(out["features"]) for i, v in enumerate(f) if v is not None]
    index = [min(max(base + (f[0] or 0), 0), 255) for f in out["features"]]
    plain = not any(quantiser[k] for k in ("y_dc", "u_dc", "u_ac", "v_dc", "v_ac"))
    return out | {"preskip": any(i >= REFERENCE_FEATURE for _, i in used), "last": max((s for s, _ in used), default=0), "index": index, "lossless": [plain and v == 0 for v in index]}


def _feature(b: Bits, i: int) -> int | None:
    if not b.flag():
        return None
    limit = FEATURE_LIMIT[i]
    if i < SIGNED_FEATURES:
        return min(max(b.s(1 + FEATURE_BITS[i]), -limit), limit)
    return min(b.u(FEATURE_BITS[i]), limit)


def _deltas(b: Bits, h: dict) -> dict:
    out = {"q": h["quantiser"]["base"] > 0 and b.flag(), "q_shift": 0, "filter": False, "filter_shift": 0, "filter_multi": False}
    if out["q"]:
        out["q_shift"] = b.u(2)
        out["filter"] = not h["intra_copy"] and b.flag()
        if out["filter"]:
            out |= {"filter_shift": b.u(2), "filter_multi": b.flag()}
    return out


def _edge_filter(b: Bits, q: dict, h: dict, before: dict | None) -> dict:
    out = {"levels": [0, 0], "u": 0, "v": 0, "sharpness": 0, "deltas": True, "update": False, "ref_deltas": list(REF_DELTAS), "mode_deltas": list(MODE_DELTAS)}
    if h["coded_lossless"] or h["intra_copy"]:
        return out
    if before is not None:
        out |= {k: list(before["filter"][k]) for k in ("ref_deltas", "mode_deltas")}
    out["levels"] = [b.u(6), b.u(6)]
    if not q["monochrome"] and any(out["levels"]):
        out |= {"u": b.u(6), "v": b.u(6)}
    out |= {"sharpness": b.u(3), "deltas": b.flag()}
    out["update"] = out["deltas"] and b.flag()
    if out["update"]:
        for k in ("ref_deltas", "mode_deltas"):
            out[k] = [b.s(7) if b.flag() else v for v in out[k]]
    return out


def _cdef(b: Bits, q: dict, h: dict) -> dict:
    if h["coded_lossless"] or h["intra_copy"] or not q["cdef"]:
        return {"damping": 3, "bits": 0, "y_primary": [0], "y_secondary": [0], "uv_primary": [0], "uv_secondary": [0]}
    out = {"damping": b.u(2) + 3, "bits": b.u(2), "y_primary": [], "y_secondary": [], "uv_primary": [], "uv_secondary": []}
    for _ in range(1 << out["bits"]):
        for plane in ("y",) if q["monochrome"] else ("y", "uv"):
            out[f"{plane}_primary"].append(b.u(4))
            secondary = b.u(2)
            out[f"{plane}_secondary"].append(4 if secondary == 3 else secondary)
    return out


def _restoration(b: Bits, q: dict, h: dict) -> dict:
    planes = 1 if q["monochrome"] else 3
    if h["all_lossless"] or h["intra_copy"] or not q["restoration"]:
        return {"kinds": ["none"] * planes, "luma_bits": None, "chroma_bits": None}
    kinds = [b.u(2) for _ in range(planes)]
    if not any(kinds):
        return {"kinds": ["none"] * planes, "luma_bits": None, "chroma_bits": None}
    luma = 6 + b.u(1)
    if q["large_blocks"]:
        luma += 1
    elif luma == 7:
        luma += b.u(1)
    chroma = luma - (b.u(1) if q["sub_x"] and q["sub_y"] and any(kinds[1:]) else 0)
    return {"kinds": [RESTORATION[k] for k in kinds], "luma_bits": luma, "chroma_bits": chroma}


def _skip_mode(b: Bits, q: dict, h: dict, slots: list[dict | None]) -> dict:
    """Skip mode joins the nearest frame behind and the nearest ahead, or the two nearest behind."""
    out = {"skip_allowed": False, "skip_mode": False, "skip_refs": None}
    if not h["compound"] or not q["order_bits"]:
        return out
    away = []
    for i, slot in enumerate(h["refs"]):
        if slots[slot] is None:
            raise ValueError("a reference is not there")
        away.append((_distance(q, slots[slot]["order_hint"], h["order_hint"]), i))
    behind, ahead = [(-d, i) for d, i in away if d < 0], [(d, i) for d, i in away if d > 0]
    if not behind:
        return out
    first = min(behind)
    second = min(ahead, default=None) or min([x for x in behind if x[0] > first[0]], default=None)
    if second is None:
        return out
    return {"skip_allowed": True, "skip_mode": b.flag(), "skip_refs": sorted((first[1], second[1]))}


def _motion(b: Bits, h: dict, intra: bool, before: dict | None) -> list[dict]:
    """A motion for each of the seven references: kind 0 still, 1 translation, 2 rotation and zoom, 3 affine."""
    out = []
    for i in range(7):
        kind = 0
        if not intra and b.flag():
            kind = 2 if b.flag() else 1 if b.flag() else 3
        old = STILL if before is None else before["motion"][i]["params"]
        params = list(STILL)

        def read(k: int, kind: int = kind, old=old) -> int:
            coarse = not h["high_precision"]
            size, point = (12, 15) if k >= 2 else (12, 6) if kind > 1 else (9 - coarse, 3 - coarse)
            one = 1 if k in (2, 5) else 0
            v = b.near(1 << size, (old[k] >> 16 - point) - (one << point))
            return (v << 16 - point) + (one << 16)

        if kind >= 2:
            params[2], params[3] = read(2), read(3)
            params[4], params[5] = (read(4), read(5)) if kind == 3 else (-params[3], params[2])
        if kind:
            params[0], params[1] = read(0), read(1)
        out.append({"kind": kind, "params": params})
    return out


def _points(b: Bits, most: int) -> list[dict]:
    n = b.u(4)
    if n > most:
        raise ValueError("too many grain points")
    out = [{"value": b.u(8), "scaling": b.u(8)} for _ in range(n)]
    if any(x["value"] >= y["value"] for x, y in zip(out, out[1:], strict=False)):
        raise ValueError("grain points don't increase")
    return out


def _grain(b: Bits, q: dict, h: dict, slots: list[dict | None]) -> dict:
    none = {"apply": False, "seed": 0, "update": False, "reference": None, "y": [], "cb": [], "cr": [], "from_luma": False}
    if not q["grain"] or not (h["shown"] or h["showable"]) or not b.flag():
        return none
    seed = b.u(16)
    if h["frame_type"] == INTER and not b.flag():
        reference = b.u(3)
        if reference not in h["refs"]:
            raise ValueError("the grain's reference is not one of the frame's")
        if slots[reference] is None:
            raise ValueError("the grain's reference is not there")
        return slots[reference]["grain"] | {"seed": seed, "update": False, "reference": reference}
    g = none | {"apply": True, "seed": seed, "update": True, "y": _points(b, 14)}
    g["from_luma"] = not q["monochrome"] and b.flag()
    both = q["sub_x"] and q["sub_y"]
    if not (q["monochrome"] or g["from_luma"] or (both and not g["y"])):
        g |= {"cb": _points(b, 10), "cr": _points(b, 10)}
        if both and bool(g["cb"]) != bool(g["cr"]):
            raise ValueError("grain points of one chroma plane only")
    g |= {"scaling_shift": b.u(2) + 8, "lag": b.u(2)}
    n = 2 * g["lag"] * (g["lag"] + 1)
    coefficients = lambda some, n: [b.u(8) - 128 for _ in range(n)] if some else []
    g["ar_y"] = coefficients(g["y"], n)
    for plane in ("cb", "cr"):
        g[f"ar_{plane}"] = coefficients(g[plane] or g["from_luma"], n + bool(g["y"]))
    g |= {"ar_shift": b.u(2) + 6, "scale_shift": b.u(2)}
    for plane in ("cb", "cr"):
        if g[plane]:
            g |= {f"{plane}_mult": b.u(8) - 128, f"{plane}_luma_mult": b.u(8) - 128, f"{plane}_offset": b.u(9) - 256}
    return g | {"overlap": b.flag(), "clip": b.flag()}


#: Rows and bytes that a task reads at a time; segments of up to STEPS records are read in step, longer ones one record after another.
ROWS, BYTES, STEPS = 1 << 15, 1 << 24, 64
#: Streams of fewer records go to a task as a whole.
SPAN = 1 << 16


class _Walk:
    """Records in order of (stream, segment, record), one by one: the state belongs to one segment."""

    def __init__(self, active: bool):
        self.active, self.own = active, None

    def row(self, stream, segment, index, unit, kind, temporal, spatial, data) -> dict:
        if self.own != (stream, segment):
            self.own, self.sequence, self.slots, self.broken = (stream, segment), None, [None] * 8, False
        row = {"stream_id": stream, "obu_index": index, "unit": unit, "type": kind, "sequence": None, "header": None, "error": None}
        try:
            if self.broken:
                raise ValueError("an earlier header of the segment is broken")
            if kind == SEQUENCE:
                self.sequence = row["sequence"] = sequence_header(data)
            else:
                if self.sequence is None:
                    raise ValueError("no sequence header")
                h = row["header"] = frame_header(data, self.sequence, self.slots, temporal or 0, spatial or 0)
                if self.active:
                    row["sequence"] = self.sequence
                if h["show_existing"] and kind == FRAME:
                    row["header"] = None
                    raise ValueError("a frame with its samples shows an old one")
                self.slots = [h if h["refresh"] >> i & 1 else s for i, s in enumerate(self.slots)]
        except ValueError as e:
            row["error"], self.broken = str(e), True
        return row


def _numbers(column: pa.Array) -> np.ndarray:
    """Integers, nulls as the least one."""
    return column.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column; true for the first."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _bytes(heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column with eight more behind, and where each value begins and how many it has."""
    heads = heads.cast(pa.binary())
    ends = np.frombuffer(heads.buffers()[1], np.int32, len(heads) + 1, heads.offset * 4).astype(np.int64) if len(heads) else np.zeros(1, np.int64)
    held = np.frombuffer(heads.buffers()[2], np.uint8) if len(heads) and heads.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.concatenate([held[ends[0] : ends[-1]], np.zeros(8, np.uint8)]), ends[:-1] - ends[0], np.diff(ends)


def _in_step(kind: np.ndarray, heads: pa.Array, order: np.ndarray, first: np.ndarray, size: np.ndarray, chosen: pa.StructType, sequences: pa.StructType, active: bool):
    """The segments that begin at ``first`` of ``order`` and have ``size`` records, read in step.

    (left, rows, sequence, header, error): which segments are not read here, the row numbers of the others, and their columns.
    """
    n = len(kind)
    h, error, held, shown = batches.columns(n), np.zeros(n, np.int16), np.zeros(n, bool), np.full(n, -1)
    data, start, length = _bytes(heads)
    texts, code = list(batches.ERRORS), np.full(n, -1)
    known: list = []
    at = np.flatnonzero(kind == SEQUENCE)
    if len(at):
        found = heads.take(pa.array(at)).dictionary_encode()
        code[at] = found.indices.to_numpy()
        for value in found.dictionary.to_pylist():
            try:
                known.append(sequence_header(value))
            except ValueError as e:
                known.append(batches.CODES[str(e)])
    left, broken, current, slots = np.zeros(len(first), bool), np.zeros(len(first), bool), np.full(len(first), -1), np.full((len(first), 8), -1)
    by_size = np.argsort(-size, kind="stable")
    for t in range(int(size.max(initial=0))):
        segments = by_size[: int(np.searchsorted(-size[by_size], -t, "left"))]
        rows = order[first[segments] + t]
        error[rows[broken[segments]]] = batches.CODES["an earlier header of the segment is broken"]
        alive = ~broken[segments] & ~left[segments]
        segments, rows = segments[alive], rows[alive]
        heading = kind[rows] == SEQUENCE
        for s, r in zip(segments[heading], rows[heading], strict=True) if len(known) > 1 else ():
            if isinstance(known[code[r]], int):
                error[r], broken[s] = known[code[r]], True
            else:
                current[s], shown[r] = code[r], code[r]
        if len(known) == 1 and heading.any():
            if isinstance(known[0], int):
                error[rows[heading]], broken[segments[heading]] = known[0], True
            else:
                current[segments[heading]], shown[rows[heading]] = 0, 0
        segments, rows = segments[~heading], rows[~heading]
        lacks = current[segments] < 0
        error[rows[lacks]], broken[segments[lacks]] = batches.CODES["no sequence header"], True
        segments, rows = segments[~lacks], rows[~lacks]
        for u in np.unique(current[segments]):
            q, under = known[u], current[segments] == u
            own, to = segments[under], rows[under]
            if not batches.suits(q):
                left[own] = True
                continue
            again = (length[to] > 0) & (data[start[to]] >> 7 == 1)
            for some, read in ((again, False), (~again, True)):
                if not some.any():
                    continue
                s, r = own[some], to[some]
                b = batches.Lanes(data, start[r], length[r])
                if read:
                    batches.read(b, q, slots[s], h, r)
                else:
                    batches.show(b, slots[s], h, r)
                    b.error[(b.error == 0) & (kind[r] == FRAME)] = batches.CODES["a frame with its samples shows an old one"]
                left[s] |= b.left
                error[r], broken[s] = b.error, b.error > 0
                good = b.error == 0
                held[r[good]] = True
                # a record that shows a stored frame under its samples has the sequence header, but no header
                if active:
                    shown[r[good | (b.error == batches.CODES["a frame with its samples shows an old one"])]] = u
                fresh = (h["refresh"][r][:, None] >> np.arange(8) & 1 > 0) & good[:, None]
                slots[s] = np.where(fresh, r[:, None], slots[s])
    taken = np.zeros(n + 1, np.int64)
    stays = ~left
    np.add.at(taken, first[stays], 1)
    np.add.at(taken, (first + size)[stays], -1)
    rows = np.sort(order[np.cumsum(taken[:n]) > 0])
    structs = pa.array([None if isinstance(q, int) else q for q in known], sequences)
    sequence = structs.take(pa.array(shown[rows], mask=shown[rows] < 0)) if len(known) else pa.nulls(len(rows), sequences)
    return left, rows, sequence, batches.arrow(h, chosen, rows, held[rows]), pa.array(texts, pa.string()).take(pa.array(error[rows]))


def _walker(schema: pa.Schema, active: bool, whole: bool):
    """Rows in order of (stream, segment, record); with ``whole``, in order of (stream, unit, record), and segments are found here."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held, rows, size = _Walk(active), [], 0, 0
        for batch in stream:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if rows >= ROWS or size >= BYTES:
                done, rest = part(walk, pa.Table.from_batches(held), False)
                yield from done
                held, rows, size = rest.to_batches(), len(rest), 0
        if rows:
            yield from part(walk, pa.Table.from_batches(held), True)[0]

    def part(walk: _Walk, table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        """What can be read of the rows, and the rows that wait for more of their segment (of their stream, with ``whole``)."""
        stream = _numbers(table.column(0).combine_chunks().dictionary_encode().indices)
        streams = _changes(stream) if whole else _changes(stream, _numbers(table.column(1).combine_chunks()))
        n = len(table) if last else int(np.flatnonzero(streams)[-1])
        if not whole and len(table) - n > STEPS:
            n = len(table)  # the rest of a long segment is read as it comes
        if not n:
            return [], table
        rest, table, stream, streams = table.slice(n), table.slice(0, n).combine_chunks(), stream[:n], streams[:n]
        column = [c.combine_chunks() for c in table.columns]
        kind, heads = _numbers(column[4]), column[7]
        order, starts = np.arange(n), streams
        if whole:
            unit, data_at = _numbers(column[3]), _bytes(heads)
            data, at, length = data_at
            units = streams | _changes(unit)
            key = (kind != SEQUENCE) & (length > 0) & (data[at] >> 4 == 1)
            begin = np.flatnonzero(units)
            begins = np.maximum.reduceat(kind == SEQUENCE, begin) & np.maximum.reduceat(key, begin)
            starts = streams.copy()
            starts[begin[begins]] = True
            order = np.lexsort((_numbers(column[2]), np.cumsum(starts)))
        first = np.flatnonzero(starts)
        size = np.diff(np.append(first, n))
        short = size <= STEPS
        if not whole and walk.own == (column[0][0].as_py(), column[1][0].as_py()):
            short[0] = False  # goes on from rows before
        if not whole and len(rest) == 0 and not last:
            short[-1] = False
        header, sequences = schema.field("header").type, schema.field("sequence").type
        left, rows, sequence, found, error = _in_step(kind, heads, order, first[short], size[short], header, sequences, active)
        at = pa.array(rows)
        out = [pa.RecordBatch.from_arrays([*(c.take(at).cast(schema.field(f).type) for c, f in zip((column[0], column[2], column[3], column[4]), ("stream_id", "obu_index", "unit", "type"), strict=True)), sequence, found, error], schema=schema)] if len(rows) else []
        slow = ~short
        slow[np.flatnonzero(short)[left]] = True
        walked = []
        for i in np.flatnonzero(slow):
            own = order[first[i] : first[i] + size[i]]
            values = [c.take(pa.array(own)).to_pylist() for c in column]
            if whole:
                values[1] = [int(first[i])] * len(own)
                walk.own = None
            walked += [walk.row(*r) for r in zip(*values, strict=True)]
            if len(walked) >= ROWS:
                out.append(pa.RecordBatch.from_pylist(walked, schema))
                walked = []
        if walked:
            out.append(pa.RecordBatch.from_pylist(walked, schema))
        return out, rest

    return run


def headers(records: DataFrame, fields: tuple[str, ...] | None = None, active: bool = False, most: int | None = None) -> DataFrame:
    """(stream_id, obu_index, unit, type, sequence, header, error) of the sequence and frame headers among ``records`` (stream_id, obu_index, unit, type, temporal_id, spatial_id, payload).

    ``sequence`` has SEQUENCE_FIELDS, ``header`` FRAME_FIELDS or those of them that ``fields`` names; with ``active``, a frame's row has the sequence header in force, too.  A row has its sequence or its header struct, or an error: a header that ends early, or needs a slot or a sequence header
    that isn't there.  Headers after a broken one have an error too, until the next unit with a sequence header and a shown key frame.  A header shown
    again has the stored fields.  Other record types give no row; a null payload ends early.

    ``most``: a number of records that no stream exceeds, if it is known; up to SPAN, streams are shuffled once, as a whole, and cut into segments by their task.
    """
    kinds = (SEQUENCE, FRAME_HEADER, FRAME)
    heads = records.where(F.col("type").isin(*kinds)).select("stream_id", "obu_index", F.coalesce("unit", F.lit(0).cast("long")).alias("unit"), "type", "temporal_id", "spatial_id", F.coalesce(F.substring("payload", 1, HEAD), F.lit(b"")).alias("head"))
    whole = StructType.fromDDL(FRAME_FIELDS)
    chosen = whole if fields is None else StructType([whole[f] for f in fields])
    out = StructType.fromDDL(f"stream_id string, obu_index long, unit long, type int, sequence struct<{SEQUENCE_FIELDS}>").add("header", chosen).add("error", "string")
    # a number of parts of its own: headers are few bytes and much work
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if most is not None and most <= SPAN:
        # records without a stream have no rows here either
        dealt = heads.where("stream_id is not null").select("stream_id", F.lit(None).cast("long").alias("segment"), "obu_index", "unit", "type", "temporal_id", "spatial_id", "head").repartition(parts, "stream_id")
        return dealt.sortWithinPartitions("stream_id", "unit", "obu_index").mapInArrow(_walker(to_arrow_schema(out), active, True), out)
    # a shown key frame begins with bits 0 00 1, or has no such bits under a reduced sequence header
    first = F.conv(F.hex(F.substring("head", 1, 1)), 16, 10).cast("int")
    sequence, key = (F.col("type") == SEQUENCE), (F.col("type") != SEQUENCE) & F.coalesce(F.shiftright(first, 4) == 1, F.lit(False))
    units = heads.groupBy("stream_id", "unit").agg((F.max(sequence) & F.max(key)).cast("int").alias("begins"))
    numbered = sum_before(units, "stream_id", "unit", "begins", "segment").select("stream_id", "unit", (F.col("segment") + F.col("begins")).alias("segment"))
    joined = heads.join(numbered, ["stream_id", "unit"]).select("stream_id", "segment", "obu_index", "unit", "type", "temporal_id", "spatial_id", "head")
    return joined.repartition(parts, "stream_id", "segment").sortWithinPartitions("stream_id", "segment", "obu_index").mapInArrow(_walker(to_arrow_schema(out), active, False), out)
