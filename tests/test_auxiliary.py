"""Auxiliary images of items, grids and cells."""

import pytest

from strataplane.operators import auxiliary
from strataplane.plans import catalog

ITEMS = "file long, item long, type string, width long, height long, configured boolean, usable boolean, is_cell boolean, transforms string"
LINKS, CELLS = "file long, aux long, item long", "file long, grid long, place long, item long"


def run(spark, items, links, cells, alpha=True):
    frames = [spark.createDataFrame(r, s) for r, s in ((items, ITEMS), (links, LINKS), (cells, CELLS))]
    return {(r.file, r.item): r for r in auxiliary.resolve(*frames, alpha).collect()}


def item(f, i, kind="av01", w=64, h=64, configured=True, usable=True, is_cell=False, transforms="t"):
    return (f, i, kind, w, h, configured, usable, is_cell, transforms)


def test_plain_images(spark):
    items = [item(1, 1), item(1, 2), item(1, 3), item(2, 1), item(2, 2, w=32), item(3, 1, transforms="r"), item(3, 2), item(4, 1), item(4, 2, w=None, h=None), item(5, 1)]
    links = [(1, 3, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 9, 1)]
    got = run(spark, items, links, [])
    assert (got[1, 1].source, got[1, 1].aux, got[1, 1].width) == ("item", 2, 64) and got[1, 2].source is None and got[1, 2].error is None
    assert got[2, 1].error == "the auxiliary item differs in size" and got[3, 1].error == "the auxiliary item has other transforms" and got[4, 1].source == "item" and got[5, 1].source is None
    depth = run(spark, items, links, [], alpha=False)
    assert (depth[2, 1].source, depth[2, 1].width) == ("item", 32) and depth[3, 1].source == "item" and depth[4, 1].error == "the auxiliary item has no size"


def test_grids(spark):
    def cells(f):
        return [item(f, 1, "grid", 128, 64), item(f, 2, is_cell=True), item(f, 3, is_cell=True)], [(f, 1, 0, 2), (f, 1, 1, 3)]

    items, parts, links = [], [], []
    for f in range(1, 8):
        i, c = cells(f)
        items += i
        parts += c
    items += [item(1, 12), item(1, 13)]
    links += [(1, 12, 2), (1, 13, 3)]  # each cell has one
    items += [item(2, 12)]
    links += [(2, 12, 2)]  # the second cell has none
    items += [item(3, 12, w=1), item(3, 13)]
    links += [(3, 12, 2)]  # the first is wrong, the second has none: wrong
    items += [item(4, 13, w=1)]
    links += [(4, 13, 3)]  # the first has none, the second is wrong: none
    items += [item(5, 12, is_cell=True), item(5, 13)]
    links += [(5, 12, 2), (5, 13, 3)]
    items += [item(6, 20, "grid", 128, 64)]
    links += [(6, 20, 1)]
    items += [item(7, 20, "av01", 128, 64, configured=False)]
    links += [(7, 20, 1), (7, 12, 2)]
    got = run(spark, items, links, parts)
    assert got[1, 1].source == "cells" and [tuple(c) for c in got[1, 1].cells] == [(0, 12), (1, 13)] and got[1, 1].width == 128
    assert got[2, 1].source is None and got[2, 1].error is None and got[3, 1].error == "the auxiliary item differs in size" and got[4, 1].source is None and got[4, 1].error is None
    assert got[5, 1].error == "the auxiliary item is a cell of another image" and (got[6, 1].source, got[6, 1].aux) == ("grid", 20) and got[7, 1].error == "the auxiliary item has no configuration"
    assert run(spark, [], [], []) == {}


@pytest.mark.parametrize("name", ["auxiliary_alpha", "auxiliary_depth"])
def test_no_side_is_broadcast(spark, name):
    """Rows of a small table may be too many for the driver: however small the estimate, the joins are shuffles, also in the plan that ran."""
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
