"""Components against union-find, with the edges of hot centres dealt to parts and without."""

import random

import pytest

from strataplane.llm import components
from strataplane.llm.common import Scratch


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("hot", [3, 10_000])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT", hot)
    rng = random.Random(hot)
    chain = [(i, i + 1) for i in range(100, 130)]
    star = [(500, 501 + i) for i in range(40)]
    loose = [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    edges = chain + star + loose + [(7, 7), (500, 501), (501, 500)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    want = plain(edges)
    assert len(got) == len(want) and {r.id: r.component for r in got} == want
