"""Frame headers of many segments in step: the syntax of ``headers.frame_header`` over arrays, one lane a frame.

The t-th records of all segments are read together, so a field costs a few array operations for thousands of headers.  Slots hold row numbers of
frames that were read before, and what a frame inherits is gathered from their columns.  A lane whose header takes a rare turn (short references, uneven
tiles, frame ids, a decoder model, reduced streams) is not read here; its segment is left to ``headers.frame_header``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FRAME = 6
KEY, INTER, INTRA_ONLY, SWITCH = range(4)
NO_PRIMARY = 7
FEATURE_BITS = (8, 6, 6, 6, 6, 3, 0, 0)
FEATURE_LIMIT = (255, 63, 63, 63, 63, 7, 0, 0)
SIGNED_FEATURES, REFERENCE_FEATURE = 5, 5
REF_DELTAS, MODE_DELTAS = (1, 0, 0, 0, -1, 0, -1, -1), (0, 0)
STILL = (0, 0, 1 << 16, 0, 0, 1 << 16)
RESTORATION = ("none", "switchable", "wiener", "self_guided")
MODES = ("only_4x4", "select", "largest")
TILE_WIDTH, TILE_AREA, MOST_TILES = 4096, 4096 * 2304, 64
#: Stands for null in a column of numbers.
NULL = -(1 << 31)
FAR = 1 << 40

#: Errors by code; 0 is none.
ERRORS = [
    None, "a header ends early", "the frame to show is not there", "an intra frame refreshes all slots", "the reference that gives the size is not there", "the primary reference is not there", "the context tile is not there",
    "a reference is not there", "the grain's reference is not one of the frame's", "the grain's reference is not there", "too many grain points", "grain points don't increase", "grain points of one chroma plane only",
    "a frame with its samples shows an old one", "no sequence header", "an earlier header of the segment is broken", "an unknown profile",
]
CODES = {text: i for i, text in enumerate(ERRORS)}

_FLAGS = "show_existing short_signalling shown showable error_resilient cdf_update_off screen_content integer_mv size_override intra_copy high_precision switchable_motion ref_mvs refresh_context coded_lossless all_lossless compound skip_allowed skip_mode warped reduced_transforms inter"
_NUMBERS = "existing_slot frame_type order_hint primary_ref refresh interpolation transform_mode header_bits"
_PARTS = {
    "size": "width upscaled_width height render_width render_height denominator", "tiling": "columns rows log2_columns log2_rows column_blocks row_blocks column_step row_step context_tile size_bytes",
    "quantiser": "base y_dc u_dc u_ac v_dc v_ac level_y level_u level_v", "segmentation": "last", "delta": "q_shift filter_shift", "filter": "u v sharpness", "cdef": "damping bits uv_count", "restoration": "luma_bits chroma_bits",
    "grain": "seed reference y_count cb_count cr_count scaling_shift lag ar_y_count ar_cb_count ar_cr_count ar_shift scale_shift cb_mult cb_luma_mult cb_offset cr_mult cr_luma_mult cr_offset",
}
_PART_FLAGS = {"quantiser": "matrices", "segmentation": "enabled update_map temporal update_data preskip", "delta": "q filter filter_multi", "filter": "deltas update", "grain": "apply update from_luma overlap clip"}
_WIDE = {"refs": (7,), "reference_frames": (7, 3), "segmentation.features": (8, 8), "segmentation.index": (8,), "filter.levels": (2,), "filter.ref_deltas": (8,), "filter.mode_deltas": (2,), "cdef.y_primary": (8,), "cdef.y_secondary": (8,), "cdef.uv_primary": (8,), "cdef.uv_secondary": (8,), "restoration.kinds": (3,), "skip_refs": (2,), "motion.kind": (7,), "motion.params": (7, 6), "grain.y": (14, 2), "grain.cb": (10, 2), "grain.cr": (10, 2), "grain.ar_y": (24,), "grain.ar_cb": (25,), "grain.ar_cr": (25,)}
GRAIN = [f"grain.{c}" for c in (_PARTS["grain"] + " " + _PART_FLAGS["grain"]).split()] + [c for c in _WIDE if c.startswith("grain.")]


def columns(n: int) -> dict[str, np.ndarray]:
    """Empty columns of ``n`` headers."""
    out = {c: np.zeros(n, bool) for c in _FLAGS.split()} | {c: np.zeros(n, np.int32) for c in _NUMBERS.split()}
    out |= {f"{p}.{c}": np.zeros(n, np.int32) for p, names in _PARTS.items() for c in names.split()}
    out |= {f"{p}.{c}": np.zeros(n, bool) for p, names in _PART_FLAGS.items() for c in names.split()}
    out |= {c: np.zeros((n, *shape), np.int32) for c, shape in _WIDE.items()}
    return out | {"planes": np.zeros(n, np.int32)}


class Lanes:
    """Cursors over the bits of many records.  A lane past its end reads anything and has the first error when errors are next looked at."""

    def __init__(self, data: np.ndarray, first: np.ndarray, size: np.ndarray):
        """``data``: bytes with eight more behind; ``first``, ``size``: where the lanes begin and how many bytes they have."""
        # the eight bytes from each byte on
        self.words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self.begin = first * 8
        self.at, self.end, self.top = self.begin.copy(), (first + size) * 8, len(data) - 8
        self.n = len(first)
        self.error, self.left = np.zeros(self.n, np.int16), np.zeros(self.n, bool)

    def _bits(self, at: np.ndarray, n) -> np.ndarray:
        word = self.words[np.minimum(at >> 3, self.top)].byteswap()
        width = n.astype(np.uint64) if isinstance(n, np.ndarray) else np.uint64(n)
        return (word << (at & 7).astype(np.uint64) >> np.uint64(1) >> (np.uint64(63) - width)).astype(np.int64)

    def read(self, i: np.ndarray, n) -> np.ndarray:
        """The next ``n`` bits of the lanes with numbers ``i``."""
        at = self.at[i]
        self.at[i] = at + n
        return self._bits(at, n)

    def u(self, n, some: np.ndarray | None = None) -> np.ndarray:
        """The next ``n`` bits of the lanes where ``some`` holds, 0 for the others."""
        if some is None:
            at = self.at
            self.at = at + n
            return self._bits(at, n)
        out = np.zeros(self.n, np.int64)
        i = np.flatnonzero(some)
        if len(i):
            out[i] = self.read(i, n[i] if isinstance(n, np.ndarray) else n)
        return out

    def flag(self, some: np.ndarray | None = None) -> np.ndarray:
        return self.u(1, some) != 0

    def delta(self, some: np.ndarray | None = None) -> np.ndarray:
        """0 or seven bits with a sign."""
        v = self.u(7, self.flag(some))
        return v - (v >> 6 << 7)

    def late(self) -> None:
        self.error[(self.at > self.end) & (self.error == 0)] = 1

    def leave(self, where: np.ndarray) -> None:
        """What lanes without an error have here is not read here."""
        self.late()
        self.left |= where & (self.error == 0)

    def fail(self, where: np.ndarray, text: str) -> None:
        if where.any():
            self.late()
            self.error[where & (self.error == 0)] = CODES[text]

    def below(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers under ``n`` (at least 1) for the lanes ``i``."""
        w = np.frexp(n.astype(np.float64))[1].astype(np.int64)
        short = (1 << w) - n
        v = self.read(i, w - 1)
        more = np.flatnonzero(v >= short)
        v[more] = 2 * v[more] - short[more] + self.read(i[more], 1)
        return v

    def near(self, i: np.ndarray, limit: np.ndarray, reference: np.ndarray) -> np.ndarray:
        """Numbers in -limit..limit, coded by their distance from ``reference``, for the lanes ``i``."""
        symbols, r = 2 * limit + 1, reference + limit
        v = np.zeros(len(i), np.int64)
        going, base, step = np.arange(len(i)), 0, 3
        while len(going):
            last = symbols[going] <= base + 3 * (1 << step)
            ends = going[last]
            if len(ends):
                v[ends] = base + self.below(i[ends], symbols[ends] - base)
            going = going[~last]
            more = self.read(i[going], 1) != 0
            ends = going[~more]
            v[ends] = base + self.read(i[ends], step)
            going = going[more]
            base += 1 << step
            step += base > 8
        mirrored = 2 * r > symbols
        c = np.where(mirrored, symbols - 1 - r, r)
        out = np.where(v > 2 * c, v, np.where(v & 1, c - (v + 1 >> 1), c + (v >> 1)))
        return np.where(mirrored, symbols - 1 - out, out) - limit


def suits(q: dict) -> bool:
    """Whether frames under a sequence header are read here."""
    return not (q["reduced"] or q["decoder_model"] or q["frame_ids"])


def _doublings(unit: int, target: np.ndarray, most: int) -> np.ndarray:
    out = np.zeros(len(target), np.int64)
    for k in range(most):
        out += (unit << k) < target
    return out


def show(b: Lanes, slots: np.ndarray, h: dict[str, np.ndarray], rows: np.ndarray) -> None:
    """Headers that show a stored frame again: its fields; a key frame refreshes all slots."""
    b.u(1)
    slot = b.u(3)
    stored = slots[np.arange(b.n), slot]
    b.fail(stored < 0, "the frame to show is not there")
    b.late()
    ok = b.error == 0
    to, from_ = rows[ok], stored[ok]
    for c in h.values():
        c[to] = c[from_]
    h["show_existing"][to], h["existing_slot"][to], h["shown"][to], h["showable"][to], h["header_bits"][to] = True, slot[ok], True, False, 4
    h["refresh"][to] = np.where(h["frame_type"][to] == KEY, 255, 0)


def read(b: Lanes, q: dict, slots: np.ndarray, h: dict[str, np.ndarray], rows: np.ndarray) -> None:
    """Headers that don't show a stored frame, into ``rows`` of the columns ``h``; ``slots``: (lane, 8) rows of stored headers, -1 for none."""
    n, lane = b.n, np.arange(b.n)
    none, everywhere = np.zeros(n, bool), np.ones(n, bool)

    def put(**values) -> None:
        for name, v in values.items():
            h[name.replace("__", ".")][rows] = v

    def of(name: str, row: np.ndarray) -> np.ndarray:
        return h[name][np.maximum(row, 0)]

    b.u(1)
    kind, shown = b.u(2), b.flag()
    showable = np.where(shown, kind != KEY, b.flag(~shown))
    whole = (kind == SWITCH) | (kind == KEY) & shown
    resilient = whole | b.flag(~whole)
    intra = (kind == KEY) | (kind == INTRA_ONLY)
    inter = ~intra
    cdf_off = b.flag()
    screen = b.flag() if q["screen_content"] == 2 else everywhere if q["screen_content"] else none
    integer = b.flag(screen) if q["integer_mv"] == 2 else screen if q["integer_mv"] else none
    integer = integer | intra
    override = (kind == SWITCH) | b.flag(kind != SWITCH)
    hint = b.u(q["order_bits"])
    anew = intra | resilient
    primary = np.where(anew, NO_PRIMARY, b.u(3, ~anew))
    refresh = np.where(whole, 0xFF, b.u(8, ~whole))
    b.fail((kind == INTRA_ONLY) & (refresh == 0xFF), "an intra frame refreshes all slots")
    b.at += np.where((inter | (refresh != 0xFF)) & resilient, 8 * q["order_bits"], 0)
    put(show_existing=False, existing_slot=NULL, frame_type=kind, shown=shown, showable=showable, error_resilient=resilient, cdf_update_off=cdf_off, screen_content=screen, integer_mv=integer, size_override=override, order_hint=hint, primary_ref=primary, refresh=refresh, inter=inter)

    up, height = np.full(n, q["max_width"], np.int64), np.full(n, q["max_height"], np.int64)
    render_w, render_h, denominator = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 8, np.int64)

    def scaled(some: np.ndarray) -> None:
        if q["superres"]:
            i = np.flatnonzero(some & b.flag(some))
            denominator[i] = b.read(i, 3) + 9

    def size(some: np.ndarray) -> None:
        i = np.flatnonzero(some & override)
        up[i] = b.read(i, q["width_bits"]) + 1
        height[i] = b.read(i, q["height_bits"]) + 1
        scaled(some)
        given = b.flag(some)
        render_w[some], render_h[some] = up[some], height[some]
        i = np.flatnonzero(given)
        render_w[i] = b.read(i, 16) + 1
        render_h[i] = b.read(i, 16) + 1

    width = lambda: (up * 8 + denominator // 2) // denominator
    size(intra)
    copies = screen & intra & (width() == up)
    copies = b.flag(copies)
    if q["order_bits"]:
        b.leave(b.flag(inter))  # short references
    refs = b.u(21, inter)[:, None] >> np.arange(18, -1, -3) & 7
    behind_refs = np.where(inter[:, None], np.take_along_axis(slots, refs, 1), -1)
    known = behind_refs >= 0
    put(refs=refs, reference_frames=np.where(known[:, :, None], np.stack([of(c, behind_refs) for c in ("order_hint", "size.upscaled_width", "size.height")], 2), NULL))
    looking, found = inter & override & ~resilient, none.copy()
    for i in range(7):
        if not looking.any():
            break
        here = b.flag(looking)
        row = behind_refs[:, i]
        b.fail(here & (row < 0), "the reference that gives the size is not there")
        for v, c in ((up, "upscaled_width"), (height, "height"), (render_w, "render_width"), (render_h, "render_height")):
            v[here] = of(f"size.{c}", row[here])
        found |= here
        looking &= ~here
    scaled(found)
    size(inter & ~found)
    up, height = np.maximum(up, 1), np.maximum(height, 1)
    w = width()
    put(size__width=w, size__upscaled_width=up, size__height=height, size__render_width=render_w, size__render_height=render_h, size__denominator=denominator, intra_copy=copies)
    precise = b.flag(inter & ~integer)
    filtered = b.flag(inter)
    put(high_precision=precise, interpolation=np.where(filtered, 4, b.u(2, inter & ~filtered)))
    put(switchable_motion=b.flag(inter), ref_mvs=b.flag(inter & ~resilient) if q["ref_mvs"] else none)
    put(refresh_context=~cdf_off & ~b.flag(~cdf_off))
    before = np.where(primary == NO_PRIMARY, -1, behind_refs[lane, np.minimum(primary, 6)])
    b.fail((primary != NO_PRIMARY) & (before < 0), "the primary reference is not there")
    has = before >= 0

    # tiles
    side = 7 if q["large_blocks"] else 6
    across, down = ((v + 7 >> 3 << 3) + (1 << side) - 1 >> side for v in (w, height))
    least_across, most_across, most_down = _doublings(TILE_WIDTH >> side, across, 12), _doublings(1, np.minimum(across, MOST_TILES), 7), _doublings(1, np.minimum(down, MOST_TILES), 7)
    least = np.maximum(least_across, _doublings(TILE_AREA >> 2 * side, across * down, 24))
    b.leave(~b.flag())

    def even(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        going = low < high
        while going.any():
            going = b.flag(going)
            low = low + going
            going &= low < high
        return low

    log_across = even(least_across, most_across)
    log_down = even(np.maximum(least - log_across, 0), most_down)
    step_across, step_down = (across + (1 << log_across) - 1 >> log_across), (down + (1 << log_down) - 1 >> log_down)
    tiles_across, tiles_down = -(-across // step_across), -(-down // step_down)
    many = log_across + log_down > 0
    context = b.u(log_across + log_down, many)
    put(tiling__size_bytes=np.where(many, b.u(2, many) + 1, 0))
    b.fail(context >= tiles_across * tiles_down, "the context tile is not there")
    put(tiling__columns=tiles_across, tiling__rows=tiles_down, tiling__log2_columns=log_across, tiling__log2_rows=log_down, tiling__column_blocks=across, tiling__row_blocks=down, tiling__column_step=step_across, tiling__row_step=step_down, tiling__context_tile=context)

    # quantiser
    zero = np.zeros(n, np.int64)
    base, y_dc = b.u(8), b.delta()
    u_dc = u_ac = v_dc = v_ac = zero
    if not q["monochrome"]:
        apart = b.flag() if q["separate_uv"] else none
        u_dc, u_ac = b.delta(), b.delta()
        v_dc, v_ac = (np.where(apart, b.delta(apart), u_dc), np.where(apart, b.delta(apart), u_ac)) if q["separate_uv"] else (u_dc, u_ac)
    matrices = b.flag()
    level_y, level_u = b.u(4, matrices), b.u(4, matrices)
    level_v = b.u(4, matrices) if q["separate_uv"] else level_u
    put(quantiser__base=base, quantiser__y_dc=y_dc, quantiser__u_dc=u_dc, quantiser__u_ac=u_ac, quantiser__v_dc=v_dc, quantiser__v_ac=v_ac, quantiser__matrices=matrices, quantiser__level_y=level_y, quantiser__level_u=level_u, quantiser__level_v=level_v)

    # segments
    enabled = b.flag()
    inherits = enabled & has
    mapped = b.flag(inherits)
    temporal = b.flag(mapped)
    data = b.flag(inherits)
    update_map, update_data = enabled & (~has | mapped), enabled & (~has | data)
    features = np.full((n, 8, 8), NULL, np.int64)
    kept = np.flatnonzero(inherits & ~data)
    features[kept] = of("segmentation.features", before[kept])
    i = np.flatnonzero(update_data)
    for s in range(8):
        for f in range(8):
            j = i[b.read(i, 1) != 0]
            if len(j):
                bits, limit = FEATURE_BITS[f], FEATURE_LIMIT[f]
                if f < SIGNED_FEATURES:
                    v = b.read(j, 1 + bits)
                    v = np.clip(v - (v >> bits << bits + 1), -limit, limit)
                else:
                    v = np.minimum(b.read(j, bits), limit)
                features[j, s, f] = v
    used = features != NULL
    index = np.clip(base[:, None] + np.where(used[:, :, 0], features[:, :, 0], 0), 0, 255)
    plain = (y_dc == 0) & (u_dc == 0) & (u_ac == 0) & (v_dc == 0) & (v_ac == 0)
    coded = plain & (index == 0).all(1)
    put(segmentation__enabled=enabled, segmentation__update_map=update_map, segmentation__temporal=temporal, segmentation__update_data=update_data, segmentation__features=features, segmentation__preskip=used[:, :, REFERENCE_FEATURE:].any((1, 2)), segmentation__last=(used.any(2) * np.arange(8)).max(1), segmentation__index=index)

    varies = b.flag(base > 0)
    put(delta__q=varies, delta__q_shift=b.u(2, varies))
    edges = b.flag(varies & ~copies)
    put(delta__filter=edges, delta__filter_shift=b.u(2, edges), delta__filter_multi=b.flag(edges))
    lossless = coded & (w == up)
    put(coded_lossless=coded, all_lossless=lossless)

    # edge filter
    some = ~(coded | copies)
    ref_deltas, mode_deltas = np.tile(np.array(REF_DELTAS, np.int64), (n, 1)), np.tile(np.array(MODE_DELTAS, np.int64), (n, 1))
    i = np.flatnonzero(some & has)
    ref_deltas[i], mode_deltas[i] = of("filter.ref_deltas", before[i]), of("filter.mode_deltas", before[i])
    levels = b.u(12, some)
    chroma = some & (levels > 0) if not q["monochrome"] else none
    put(filter__levels=np.stack([levels >> 6, levels & 63], 1), filter__u=b.u(6, chroma), filter__v=b.u(6, chroma), filter__sharpness=b.u(3, some))
    deltas = b.flag(some)
    update = b.flag(deltas)
    i = np.flatnonzero(update)
    if len(i):
        for out in (ref_deltas, mode_deltas):
            for k in range(out.shape[1]):
                j = i[b.read(i, 1) != 0]
                v = b.read(j, 7)
                out[j, k] = v - (v >> 6 << 7)
    put(filter__deltas=deltas | ~some, filter__update=update, filter__ref_deltas=ref_deltas, filter__mode_deltas=mode_deltas)

    # directional filter
    some = ~(coded | copies) if q["cdef"] else none
    put(cdef__damping=np.where(some, b.u(2, some) + 3, 3))
    bits = b.u(2, some)
    strengths = {c: np.zeros((n, 8), np.int64) for c in ("y_primary", "y_secondary", "uv_primary", "uv_secondary")}
    for k in range(8):
        i = np.flatnonzero(some & (k < 1 << bits))
        if not len(i):
            break
        for plane in ("y",) if q["monochrome"] else ("y", "uv"):
            v = b.read(i, 6)
            strengths[f"{plane}_primary"][i, k], strengths[f"{plane}_secondary"][i, k] = v >> 2, np.where(v & 3 == 3, 4, v & 3)
    put(cdef__bits=bits, cdef__uv_count=np.where(some & q["monochrome"], 0, 1 << bits), **{f"cdef__{c}": v for c, v in strengths.items()})

    # restoration
    planes = 1 if q["monochrome"] else 3
    some = ~(lossless | copies) if q["restoration"] else none
    v = b.u(2 * planes, some)
    kinds = v[:, None] >> np.arange(2 * planes - 2, -1, -2) & 3
    some = v > 0
    luma = 6 + b.u(1, some)
    luma = luma + 1 if q["large_blocks"] else luma + b.u(1, some & (luma == 7))
    smaller = b.u(1, some & (kinds[:, 1:] > 0).any(1)) if q["sub_x"] and q["sub_y"] else zero
    put(restoration__kinds=np.pad(kinds, ((0, 0), (0, 3 - planes))), restoration__luma_bits=np.where(some, luma, NULL), restoration__chroma_bits=np.where(some, luma - smaller, NULL), planes=planes)
    put(transform_mode=np.where(coded, 0, np.where(b.flag(~coded), 1, 2)))
    compound = b.flag(inter)

    # skip mode
    some = compound if q["order_bits"] else none
    b.fail(some & ~known.all(1), "a reference is not there")
    half = 1 << q["order_bits"] - 1 if q["order_bits"] else 1
    away = (of("order_hint", behind_refs) - hint[:, None] + half & 2 * half - 1) - half
    behind = np.where(away < 0, -away * 8 + np.arange(7), FAR)
    ahead = np.where(away > 0, away * 8 + np.arange(7), FAR).min(1)
    first = behind.min(1)
    second = np.where(ahead < FAR, ahead, np.where(behind >> 3 > (first >> 3)[:, None], behind, FAR).min(1))
    allowed = some & (first < FAR) & (second < FAR)
    put(compound=compound, skip_allowed=allowed, skip_mode=b.flag(allowed), skip_refs=np.sort(np.stack([first & 7, second & 7], 1), 1))
    put(warped=b.flag(inter & ~resilient) if q["warped"] else none, reduced_transforms=b.flag())

    # motion
    kinds, params = np.zeros((n, 7), np.int64), np.tile(np.array(STILL, np.int64), (n, 7, 1))
    i = np.flatnonzero(inter)
    for r in range(7):
        j = i[b.read(i, 1) != 0]
        if not len(j):
            continue
        more = b.read(j, 1) != 0
        k = np.where(more, 2, 0)
        k[~more] = np.where(b.read(j[~more], 1) != 0, 1, 3)
        kinds[j, r] = k
        old = np.where(has[j][:, None], h["motion.params"][np.maximum(before[j], 0), r], np.array(STILL))

        def entry(at: np.ndarray, c: int, j=j, k=k, old=old, r=r) -> None:
            """Entry ``c`` of the lanes j[at]."""
            if not len(at):
                return
            coarse = ~precise[j[at]]
            bits, point = (np.full(len(at), 12), np.full(len(at), 15)) if c >= 2 else (np.where(k[at] > 1, 12, 9 - coarse), np.where(k[at] > 1, 6, 3 - coarse))
            one = 1 if c in (2, 5) else 0
            v = b.near(j[at], 1 << bits, (old[at, c] >> 16 - point) - (one << point))
            params[j[at], r, c] = (v << 16 - point) + (one << 16)

        turned, affine, all_ = np.flatnonzero(k >= 2), np.flatnonzero(k == 3), np.arange(len(j))
        entry(turned, 2)
        entry(turned, 3)
        entry(affine, 4)
        entry(affine, 5)
        zoom = j[k == 2]
        params[zoom, r, 4], params[zoom, r, 5] = -params[zoom, r, 3], params[zoom, r, 2]
        entry(all_, 0)
        entry(all_, 1)
    put(**{"motion__kind": kinds, "motion__params": params})
    _grain(b, q, h, rows, kind, shown | showable, refs, slots)
    b.late()
    put(header_bits=b.at - b.begin)


def _points(b: Lanes, i: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    count = b.read(i, 4)
    lanes = np.zeros(b.n, bool)
    lanes[i[count > most]] = True
    b.fail(lanes, "too many grain points")
    out = np.zeros((len(i), most, 2), np.int64)
    for p in range(most):
        j = np.flatnonzero(count > p)
        if not len(j):
            break
        v = b.read(i[j], 16)
        out[j, p, 0], out[j, p, 1] = v >> 8, v & 255
    falls = (out[:, :-1, 0] >= out[:, 1:, 0]) & (np.arange(1, most) < count[:, None])
    lanes[:] = False
    lanes[i[falls.any(1)]] = True
    b.fail(lanes, "grain points don't increase")
    return np.minimum(count, most), out


def _grain(b: Lanes, q: dict, h: dict[str, np.ndarray], rows: np.ndarray, kind: np.ndarray, visible: np.ndarray, refs: np.ndarray, slots: np.ndarray) -> None:
    for c in GRAIN:
        h[c][rows] = 0
    h["grain.reference"][rows] = NULL
    if not q["grain"]:
        return
    some = b.flag(visible)
    seed = b.u(16, some)
    inter = some & (kind == INTER)
    same = inter & ~b.flag(inter)
    reference = b.u(3, same)
    b.fail(same & (refs != reference[:, None]).all(1), "the grain's reference is not one of the frame's")
    stored = slots[np.arange(b.n), reference]
    b.fail(same & (stored < 0), "the grain's reference is not there")
    to, from_ = rows[same], np.maximum(stored[same], 0)
    for c in GRAIN:
        h[c][to] = h[c][from_]
    h["grain.seed"][to], h["grain.update"][to], h["grain.reference"][to] = seed[same], False, reference[same]
    i = np.flatnonzero(some & ~same)
    if not len(i):
        return
    to = rows[i]

    def put(name: str, v) -> None:
        h[f"grain.{name}"][to] = v

    put("apply", True)
    put("update", True)
    put("seed", seed[i])
    count, points = _points(b, i, 14)
    put("y_count", count)
    put("y", points)
    luma = b.read(i, 1) != 0 if not q["monochrome"] else np.zeros(len(i), bool)
    put("from_luma", luma)
    both = bool(q["sub_x"] and q["sub_y"])
    own = ~(luma | (both & (count == 0))) & (not q["monochrome"])
    counts = {"cb": np.zeros(len(i), np.int64), "cr": np.zeros(len(i), np.int64)}
    j = np.flatnonzero(own)
    for plane in ("cb", "cr"):
        counts[plane][j], points = _points(b, i[j], 10)
        put(f"{plane}_count", counts[plane])
        h[f"grain.{plane}"][to[j]] = points
    if both:
        lanes = np.zeros(b.n, bool)
        lanes[i[(counts["cb"] > 0) != (counts["cr"] > 0)]] = True
        b.fail(lanes, "grain points of one chroma plane only")
    put("scaling_shift", b.read(i, 2) + 8)
    lag = b.read(i, 2)
    put("lag", lag)
    terms = 2 * lag * (lag + 1)
    for plane, some, terms_ in (("y", count > 0, terms), *[(p, (counts[p] > 0) | luma, terms + (count > 0)) for p in ("cb", "cr")]):
        own = np.where(some, terms_, 0)
        put(f"ar_{plane}_count", own)
        for t in range(int(own.max(initial=0))):
            j = np.flatnonzero(own > t)
            h[f"grain.ar_{plane}"][to[j], t] = b.read(i[j], 8) - 128
    put("ar_shift", b.read(i, 2) + 6)
    put("scale_shift", b.read(i, 2))
    for plane in ("cb", "cr"):
        j = np.flatnonzero(counts[plane] > 0)
        for c, bits in (("mult", 8), ("luma_mult", 8), ("offset", 9)):
            put(f"{plane}_{c}", NULL)
            h[f"grain.{plane}_{c}"][to[j]] = b.read(i[j], bits) - (1 << bits - 1)
    put("overlap", b.read(i, 1) != 0)
    put("clip", b.read(i, 1) != 0)


# ---- columns to Arrow


def _lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType, inner=None, mask: np.ndarray | None = None) -> pa.Array:
    """Lists of the first ``count`` of each row's values."""
    count = np.where(mask, 0, count) if mask is not None else count
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    flat = values[np.arange(values.shape[1]) < count[:, None]]
    return pa.ListArray.from_arrays(pa.array(ends), inner(flat) if inner else _plain(flat, kind.value_type), type=kind, mask=None if mask is None else pa.array(mask))


def _plain(v: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.Array:
    if pa.types.is_boolean(kind):
        return pa.array(v.astype(bool), kind, mask=mask)
    empty = v == NULL
    return pa.array(v, kind, mask=empty if mask is None else mask | empty)


def _struct(kind: pa.StructType, made: dict, mask: np.ndarray | None = None) -> pa.Array:
    return pa.StructArray.from_arrays([made[f.name] for f in kind], fields=list(kind), mask=None if mask is None else pa.array(mask))


def _field(h: dict[str, np.ndarray], name: str, kind: pa.DataType, n: int) -> pa.Array:
    whole = lambda k: np.full(n, k)
    seven = np.where(h["inter"], 7, 0)
    if name in ("frame_id", "presentation_time"):
        return pa.nulls(n, kind)
    if name == "transform_mode":
        return pa.array(MODES).cast(kind).take(pa.array(h[name]))
    if name == "refs":
        return _lists(h[name], seven, kind)
    if name == "reference_frames":
        inner = lambda v: _struct(kind.value_type, {c: _plain(v[:, i], pa.int32()) for i, c in enumerate(("order_hint", "width", "height"))}, v[:, 0] == NULL)
        return _lists(h[name], seven, kind, inner)
    if name == "skip_refs":
        return _lists(h[name], whole(2), kind, mask=~h["skip_allowed"])
    if name == "motion":
        kinds = kind.value_type
        params = _lists(h["motion.params"].reshape(-1, 6), np.full(7 * n, 6), kinds.field("params").type)
        each = _struct(kinds, {"kind": _plain(h["motion.kind"].reshape(-1), pa.int32()), "params": params})
        return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * 7).astype(np.int32)), each, type=kind)
    if not pa.types.is_struct(kind):
        return _plain(h[name], kind)
    made = {}
    for f in kind:
        c, k = f"{name}.{f.name}", f.type
        if name == "tiling" and f.name == "uniform":
            made[f.name] = pa.array(np.ones(n, bool))
        elif name == "tiling" and f.name.endswith("_starts"):
            way = f.name.removesuffix("_starts")
            count = h[f"tiling.{way}s"]
            starts = np.minimum(np.arange(int(count.max(initial=0)) + 1) * h[f"tiling.{way}_step"][:, None], h[f"tiling.{way}_blocks"][:, None])
            made[f.name] = _lists(starts, count + 1, k)
        elif c == "segmentation.features":
            rows = _lists(h[c].reshape(-1, 8), np.full(8 * n, 8), k.value_type)
            made[f.name] = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * 8).astype(np.int32)), rows, type=k)
        elif c == "segmentation.lossless":
            plain = ~np.stack([h[f"quantiser.{x}"] != 0 for x in ("y_dc", "u_dc", "u_ac", "v_dc", "v_ac")]).any(0)
            made[f.name] = _lists(plain[:, None] & (h["segmentation.index"] == 0), whole(8), k)
        elif name == "quantiser" and f.name.startswith("level_"):
            made[f.name] = _plain(h[c], k, ~h["quantiser.matrices"])
        elif name == "cdef" and f.name not in ("damping", "bits"):
            made[f.name] = _lists(h[c], h["cdef.uv_count"] if f.name.startswith("uv") else 1 << h["cdef.bits"], k)
        elif c == "restoration.kinds":
            made[f.name] = _lists(h[c], h["planes"], k, lambda v: pa.array(RESTORATION).cast(k.value_type).take(pa.array(v)))  # noqa: B023
        elif name == "grain" and f.name in ("y", "cb", "cr"):
            made[f.name] = _lists(h[c], h[f"{c}_count"], k, lambda v: _struct(k.value_type, {"value": _plain(v[:, 0], pa.int32()), "scaling": _plain(v[:, 1], pa.int32())}))  # noqa: B023
        elif name == "grain" and f.name.startswith("ar_") and f.name != "ar_shift":
            made[f.name] = _lists(h[c], h[f"{c}_count"], k, mask=~h["grain.apply"])
        elif name == "grain" and f.name not in ("apply", "seed", "update", "reference", "from_luma"):
            absent = ~h["grain.apply"]
            if f.name[:3] in ("cb_", "cr_"):
                absent = absent | (h[f"grain.{f.name[:2]}_count"] == 0)
            made[f.name] = _plain(h[c], k, absent)
        elif c in _WIDE:
            made[f.name] = _lists(h[c], whole(h[c].shape[1]), k)
        else:
            made[f.name] = _plain(h[c], k)
    return _struct(kind, made)


def arrow(h: dict[str, np.ndarray], kind: pa.StructType, rows: np.ndarray, held: np.ndarray) -> pa.Array:
    """The headers in ``rows`` as structs of the fields of ``kind``, null where ``held`` is false."""
    roots = {f.name for f in kind} | {"inter", "planes", "quantiser", "skip_allowed"}
    taken = {c: v[rows] for c, v in h.items() if c.split(".")[0] in roots}
    return _struct(kind, {f.name: _field(taken, f.name, f.type, len(rows)) for f in kind}, ~held)
