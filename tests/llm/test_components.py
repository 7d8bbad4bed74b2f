"""Connected components against a plain union of nodes."""

import random

import pytest

from scorewatch.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(root)}


def random_edges():
    rnd = random.Random(2)
    return [(rnd.randrange(-400, 400), rnd.randrange(-400, 400)) for _ in range(350)]


GRAPHS = {"chain": [(i + 1, i) for i in range(300)], "star": [(0, i) for i in range(1, 400)], "late centre": [(999, i) for i in range(400)], "random": random_edges(),
          "repeated": [(1, 2), (2, 1), (1, 2), (5, 5), (7, 8)], "none": [], "loops": [(3, 3)]}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = GRAPHS[name]
    out = components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert {tuple(r) for r in out} == plain(edges) and len(out) == len(plain(edges))
