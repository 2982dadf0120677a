import random

import pytest

from tamarack.operators.hierarchy import closure, resolve_hierarchy


def brute(parents):
    out = {}
    for x in parents:
        seen, at = [x], x
        while parents.get(at) is not None and parents[at] in parents:
            at = parents[at]
            if at in seen:
                break
            seen.append(at)
        else:
            out[x] = (seen[-1], len(seen) - 1, "in_tree", seen)
            continue
        out[x] = (None, None, "on_loop" if at == x else "below_loop", None)
    return out


def solved(spark, pairs, **kw):
    df = spark.createDataFrame([(a, b, f"n{a}", 0) for a, b in pairs], "k int, p int, name string, v int")
    return {r.id: (r.root, r.depth, r.place, r.path and [s.id for s in r.path]) for r in resolve_hierarchy(df, "k", "p", "name", "v", **kw).collect()}


@pytest.mark.parametrize("seed,shape", [(1, "random"), (2, "chain"), (3, "star"), (4, "loops"), (5, "many"), (6, "many"), (7, "many")])
def test_against_brute_force(spark, seed, shape):
    rng = random.Random(seed)
    ids = list(range(60))
    if shape == "chain":
        parents = {i: i - 1 if i else None for i in ids}
    elif shape == "star":
        parents = {i: 0 if i else None for i in ids}
    elif shape == "loops":
        parents = {i: (i + 1) % 40 if i < 40 else rng.choice([45, 46, i, 3, 999]) for i in ids}
    elif shape == "many":  # trees and loops of all sizes with long tails
        ids = list(range(400))
        parents = {i: rng.choice([i - 1, i - 1, i - 7, i // 2]) if i % 40 else rng.choice([None, i, i + 3, i + 20]) for i in ids}
    else:
        parents = {i: rng.choice([None, 999, *ids]) for i in ids}
    assert solved(spark, parents.items(), fragment_rows=25 if shape == "many" else 12) == brute(parents)


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "k int, p int, name string, v int")
    assert resolve_hierarchy(empty, "k", "p", "name", "v").count() == 0
    rows = spark.createDataFrame([(1, 2, None, 1, "x"), (1, None, "new", 5, "y"), (1, None, "new", 5, "y"), (None, 1, "none", 1, "z"), (2, 1, "", 1, "w")], "k int, p int, name string, v int, id string")
    got = {r.id: (r.depth, [s.name for s in r.path]) for r in resolve_hierarchy(rows, "k", "p", "name", "v").collect()}
    assert got == {1: (0, ["new"]), 2: (1, ["", "new"])}


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "k int, p int")
    pairs = {tuple(r) for r in closure(resolve_hierarchy(df, "k", "p", fragment_rows=1)).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_hot_parent_over_many_fragments(spark):
    rng = random.Random(9)
    parents = {i: 7 if rng.random() < 0.3 else rng.choice([None, i // 2, i - 1]) for i in range(600)} | {7: 3, 3: 2, 2: None}
    assert solved(spark, parents.items(), fragment_rows=15, hot_rows=4) == brute(parents)
    looped = parents | {2: 7}
    assert solved(spark, looped.items(), fragment_rows=15, hot_rows=4) == brute(looped)
