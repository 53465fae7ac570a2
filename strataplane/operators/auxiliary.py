"""Auxiliary images (alpha, depth) of items and of grids.

An image takes the auxiliary item that names it.  A grid takes its own auxiliary item or grid; without one, each of its cells must have an auxiliary
item, all or none: a division over the grid's cells, decided by the first cell that lacks one or has a wrong one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODED, GRID = "av01", "grid"
#: Columns of an item; configured: has a decoder configuration, usable: has no unknown essential property, is_cell: is part of a derived image.
ITEM = ("type", "width", "height", "configured", "usable", "is_cell", "transforms")


def _chain(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for condition, text in reversed(checks):
        out = F.when(F.coalesce(condition, F.lit(False)), text).otherwise(out)
    return out


def problems(image: Column, aux: Column, alpha: bool, place: str) -> Column:
    """What is wrong with ``aux`` for ``image`` (structs of ITEM), null if nothing; place: item, grid or cell."""
    unsized = (aux["width"].isNull(), "the auxiliary item has no size")
    other_size = (aux["width"] != image["width"]) | (aux["height"] != image["height"])
    unusable, unconfigured = (~aux["usable"], "the auxiliary item is not usable"), (~aux["configured"], "the auxiliary item has no configuration")
    turned = (~aux["transforms"].eqNullSafe(image["transforms"]), "the auxiliary item has other transforms")
    own = GRID if place == "grid" else CODED
    kind = (~aux["type"].isin(CODED, own), "the auxiliary item is of another type")
    size = (other_size, "the auxiliary item differs in size")
    if not alpha:
        sized = [unsized, unconfigured] + ([size] if place == "cell" else [])
        # an auxiliary grid brings its own size and cells
        sized = [(c & (aux["type"] == CODED), t) for c, t in sized]
        turned = (F.lit(False), "")
    else:
        sized = [size, (unconfigured[0] & (aux["type"] == CODED), unconfigured[1])]
    if place == "item":
        return _chain(unusable, kind, *sized, turned)
    if place == "grid":
        return _chain(unusable, turned, kind, *sized)
    return _chain(kind, (aux["is_cell"], "the auxiliary item is a cell of another image"), unusable, *sized, turned)


def resolve(items: DataFrame, links: DataFrame, cells: DataFrame, alpha: bool) -> DataFrame:
    """(file, item, source, aux, cells, width, height, error) for each image of ``items``.

    ``items``: (file, item, ITEM columns); ``links``: (file, aux, item) of the wanted kind, of which the smallest aux counts; ``cells``: (file, grid, place, item).
    source is item, grid or cells, null where there is no auxiliary image or it is wrong; cells has (place, aux) in order.  width and height are those
    of the image for alpha, else of the auxiliary item; a grid of cells has the grid's.  Auxiliary items are images as well, and have rows of their own.
    No side is broadcast: all have a row a file at least, and what files are scanned from is far smaller than its rows.
    """
    facts = F.struct(*ITEM)
    known = items.select("file", "item", facts.alias("f"))
    first = links.groupBy("file", "item").agg(F.min("aux").alias("aux"))
    named = first.join(known.select("file", F.col("item").alias("aux"), F.col("f").alias("a")).hint("merge"), ["file", "aux"])
    images = known.join(named.hint("merge"), ["file", "item"], "left")
    # cells with what they have; the first that lacks or breaks something decides
    each = cells.select("file", "grid", "place", "item").join(images.hint("merge"), ["file", "item"], "left")
    wrong = F.when(F.col("aux").isNotNull(), problems(F.col("f"), F.col("a"), alpha, "cell"))
    event = F.when(F.col("aux").isNull() | wrong.isNotNull(), F.struct("place", wrong.alias("error")))
    whole = each.groupBy("file", F.col("grid").alias("item")).agg(F.min(event).alias("event"), F.sort_array(F.collect_list(F.when(F.col("aux").isNotNull(), F.struct("place", "aux")))).alias("own"))
    found = images.join(whole.hint("merge"), ["file", "item"], "left")
    is_grid, direct = F.col("f.type") == GRID, F.col("aux").isNotNull()
    error = F.when(direct, F.when(is_grid, problems(F.col("f"), F.col("a"), alpha, "grid")).otherwise(problems(F.col("f"), F.col("a"), alpha, "item"))).when(is_grid, F.col("event.error"))
    by_cells = ~direct & is_grid & F.col("own").isNotNull() & F.col("event").isNull()
    source = F.when(error.isNull(), F.when(direct, F.when(is_grid & (F.col("a.type") == GRID), GRID).otherwise("item")).when(by_cells, "cells"))
    side = lambda s: F.when(F.col("source").isNotNull(), F.col(f"f.{s}") if alpha else F.when(F.col("source") == "cells", F.col(f"f.{s}")).otherwise(F.col(f"a.{s}")))
    return (
        found.withColumns({"error": error, "source": source})
        .withColumns({"width": side("width"), "height": side("height")})
        .select("file", "item", "source", F.when(F.col("source").isin("item", GRID), F.col("aux")).alias("aux"), F.when(F.col("source") == "cells", F.col("own")).alias("cells"), "width", "height", "error")
    )
