import random

import pytest

from lectern.operators.components import components


def check(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for link in links for x in link if None not in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    assert got == {x: root(x) for x in parent}


def test_shapes(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(1, 40)]
    check(spark, path + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)])
    check(spark, [(0, i) for i in range(1, 200)])
    check(spark, [(rng.randrange(120), rng.randrange(120)) for _ in range(90)])
    check(spark, [])


def test_too_few_rounds_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"), most_rounds=2)
