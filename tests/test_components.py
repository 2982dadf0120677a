import random

import pytest

from tamarack.operators.components import components


def brute(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("limit", [500_000, 10])
@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape, limit):
    rng = random.Random(5)
    if shape == "chain":
        links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(80)]
    elif shape == "star":
        links = [("n000", f"n{i:03}") for i in range(80)] + [("z", "z")]
    else:
        links = [(f"n{rng.randint(0, 120):03}", f"n{rng.randint(0, 120):03}") for _ in range(70)]
    df = spark.createDataFrame([*links, links[0], (None, "n001")], "a string, b string").repartition(4)
    assert {r.node: r.root for r in components(df, limit).collect()} == brute(links)
    assert components(df.limit(0)).count() == 0


def test_giant_component_is_not_brought_together(spark):
    rng = random.Random(6)
    links = [(f"n{rng.randint(0, 300):03}", f"n{rng.randint(0, 300):03}") for _ in range(420)] + [(f"m{i}", f"m{i + 1}") for i in range(0, 60, 2)]
    df = spark.createDataFrame(links, "a string, b string").repartition(5)
    assert {r.node: r.root for r in components(df, 20, hot_rows=5).collect()} == brute(links)
