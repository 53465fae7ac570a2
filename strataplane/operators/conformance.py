"""Rules that frame headers have to keep, as a catalogue: each violation is a row with its rule, found in one scan.

A rule is a condition over a row of ``headers.headers`` with ``active`` set: its frame header, the sequence header in force, and what the frame's
references are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the frame header that the rules read.
FIELDS = ("show_existing", "order_hint", "short_signalling", "reference_frames", "size", "tiling", "delta", "coded_lossless", "refs", "frame_type", "error_resilient", "cdf_update_off", "refresh_context", "size_override", "refresh", "ref_mvs", "segmentation", "compound", "filter", "shown")

# Fixed values of the format: level numbers with samples, width and height of a picture, tiles and tile columns, at most.
LEVELS = {
    (0,): (147456, 2048, 1152, 8, 4),
    (1,): (278784, 2816, 1584, 8, 4),
    (4,): (665856, 4352, 2448, 16, 6),
    (5,): (1065024, 5504, 3096, 16, 6),
    (8, 9): (2359296, 6144, 3456, 32, 8),
    (12, 13, 14, 15): (8912896, 8192, 4352, 64, 8),
    (16, 17, 18, 19): (35651584, 16384, 8704, 128, 16),
}
LEAST_SIDE, LEAST_TILE = 16, 8
_LIMITS = ("samples", "width", "height", "tiles", "columns")

_q = lambda c: F.col(f"sequence.{c}")


def _layer(point: Column) -> Column:
    """Whether an operating point takes the row's layers (temporal_id and spatial_id 0 where the row has none)."""
    idc = point["idc"]
    return (idc == 0) | ((idc.bitwiseAND(1) != 0) & (idc.bitwiseAND(256) != 0))


def level_limit(which: str) -> Column:
    """Least limit of the levels of the operating points that hold the frame; null if none of them is known."""
    i = _LIMITS.index(which)
    table = F.create_map(*[F.lit(x) for numbers, limits in LEVELS.items() for n in numbers for x in (n, limits[i])])
    own = F.transform(F.filter(_q("points"), _layer), lambda p: F.try_element_at(table, p["level"]))
    return F.array_min(F.filter(own, lambda v: v.isNotNull()))


def _tile_sides(starts: str, size: Column) -> Column:
    """Cropped sides of the tiles along one direction."""
    side = F.when(_q("large_blocks"), 128).otherwise(64)
    at = F.transform(F.col(f"header.tiling.{starts}"), lambda s: F.least(s * side, size))
    return F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: b - a)


def _behind(reference: int) -> Column:
    """Whether a reference's order hint is earlier than the frame's, on the circle of hints."""
    half = F.call_function("shiftleft", F.lit(1), F.greatest(_q("order_bits") - 1, F.lit(0)))
    away = F.get("header.reference_frames", F.lit(reference))["order_hint"] - F.col("header.order_hint")
    return F.pmod(away + half, 2 * half) - half < 0


def _references(condition) -> Column:
    return F.exists(F.filter("header.reference_frames", lambda r: r.isNotNull()), condition)


def rules() -> dict[str, Column]:
    """The rules of every frame: name and condition of its violation."""
    size, tiling = "header.size.", "header.tiling."
    width, height, upscaled = F.col(size + "width"), F.col(size + "height"), F.col(size + "upscaled_width")
    known = level_limit("samples").isNotNull()
    short = F.col("header.short_signalling")
    return {
        "lossless frames keep one quantiser": F.col("header.coded_lossless") & F.col("header.delta.q"),
        "width within the sequence": upscaled > _q("max_width"),
        "height within the sequence": height > _q("max_height"),
        "last reference is earlier": short & ~_behind(0),
        "golden reference is earlier": short & ~_behind(3),
        "tiles of eight columns": known & F.exists(_tile_sides("column_starts", width), lambda v: v < LEAST_TILE),
        "tiles of eight rows": known & F.exists(_tile_sides("row_starts", height), lambda v: v < LEAST_TILE),
        "least width of levels": known & (upscaled < LEAST_SIDE),
        "least height of levels": known & (height < LEAST_SIDE),
        "level samples": upscaled.cast("long") * height > level_limit("samples"),
        "level width": upscaled > level_limit("width"),
        "level height": height > level_limit("height"),
        "level tiles": F.col(tiling + "columns") * F.col(tiling + "rows") > level_limit("tiles"),
        "level tile columns": F.col(tiling + "columns") > level_limit("columns"),
        "references up to twice the frame": _references(lambda r: (r["width"] > 2 * width) | (r["height"] > 2 * height)),
        "references from a sixteenth of the frame": _references(lambda r: (width > 16 * r["width"]) | (height > 16 * r["height"])),
    }


def tile_mode_rules() -> dict[str, Column]:
    """The rules of frames that large-scale tile lists cut tiles from."""
    h = lambda c: F.col(f"header.{c}")
    starts, rows = F.col("header.tiling.column_starts"), F.col("header.tiling.row_starts")
    widths = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 2, F.lit(0))), F.slice(starts, 1, F.greatest(F.size(starts) - 2, F.lit(0))), lambda b, a: b - a)
    heights = F.zip_with(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), lambda b, a: b - a)
    return {
        **{f"no {name} in the sequence": _q(c) for name, c in (("super-resolution", "superres"), ("still picture", "still_picture"), ("grain", "grain"), ("decoder model", "decoder_model"), ("restoration", "restoration"), ("directional filter", "cdef"), ("monochrome", "monochrome"))},
        "no order hints in the sequence": _q("order_bits") > 0,
        "no timing in the sequence": _q("timing_scale").isNotNull(),
        "an inter frame": h("show_existing") | (h("frame_type") != 1),
        "a shown frame": ~h("shown"),
        "no error resilience": h("error_resilient"),
        "no context updates": ~h("cdf_update_off") | h("refresh_context"),
        "no quantiser updates": h("delta.q") | h("delta.filter"),
        "no size of its own": h("size_override") | (h("size.width") != h("size.upscaled_width")),
        "no refreshed slots": h("refresh") != 0,
        "no motion of references": h("ref_mvs"),
        "no temporal segmentation": h("segmentation.temporal"),
        "no compound references": h("compound"),
        "no edge filter": (F.get(h("filter.levels"), F.lit(0)) > 0) | (F.get(h("filter.levels"), F.lit(1)) > 0),
        "tiles one block high": F.exists(heights, lambda v: v != 1),
        "tiles of one width": F.size(F.array_distinct(widths)) > 1,
    }


def violations(frames: DataFrame, catalogue: dict[str, Column]) -> DataFrame:
    """(stream_id, obu_index, rule) for each rule that a frame of ``headers.headers(.., active=True)`` breaks; rows without a frame header keep all rules."""
    broken = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in catalogue.items()]
    own = frames.where("header is not null").select("stream_id", "obu_index", F.array_compact(F.array(*broken)).alias("rule"))
    return own.select("stream_id", "obu_index", F.explode("rule").alias("rule"))


def conforms(frames: DataFrame, catalogue: dict[str, Column]) -> DataFrame:
    """``frames`` that break no rule of the catalogue."""
    return frames.where(reduce(lambda a, b: a & b, [~F.coalesce(c, F.lit(False)) for c in catalogue.values()]))
