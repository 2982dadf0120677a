import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tamarack.llm.splits import SPLITS, _Dealer, assign_groups, grouped_splits, same_names, split_report, template_splits


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ["m011", "M-11", "m０１１", " m011", "m012", "e011", None, "", "--", "m011"]], "t string")
    pairs = {tuple(r) for r in same_names(df, "t").collect()}
    same = sorted(["m011", "M-11", "m０１１", " m011"])
    assert pairs == {(a, b) for a in same for b in same if a < b}


def test_groups_stay_together_and_shares_hold(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", rng.choice([None, "m1", *(f"e{rng.randint(2, 90)}" for _ in range(4))]), rng.choice(["Easy", "hard ", None]), i, "x") for i in range(3000)]
    rows += [(r[0], r[1] and r[1].upper().replace("E", "E-0"), r[2], r[3], r[4]) for r in rows[:100]] + [(None, "m1", "easy", 0, "x")]
    df = spark.createDataFrame(rows, "example_id string, template_id string, difficulty string, scored_at long, grp string")
    out = template_splits(df)
    got = {r.id: (r.grp, r.split, r.stratum) for r in out.collect()}
    assert len(got) == 3000
    by = defaultdict(set)
    for grp, split, _ in got.values():
        by[grp].add(split)
    assert all(len(v) == 1 for v in by.values())
    for stratum in ("easy", "hard", ""):
        n = Counter(s for _, s, t in got.values() if t == stratum)
        assert abs(n["train"] / sum(n.values()) - 0.8) < 0.04
    assert {r.split for r in split_report(out).collect()} == {"train", "validation", "test"}


def test_links_through_several_keys(spark):
    rows = [("1", "a", None), ("2", "a", "s"), ("3", None, "s"), ("4", "b", "t"), ("5", None, None), ("6", None, "u")]
    df = spark.createDataFrame(rows, "id string, author string, source string")
    got = {r.id: r.grp for r in grouped_splits(df, "id", {"author": F.col("author"), "source": F.col("source")}).collect()}
    assert len(got) == 6 and got["1"] == got["2"] == got["3"] and len(set(got.values())) == 4


def test_dealing_at_once_equals_one_by_one():
    rng = random.Random(5)
    for _ in range(150):
        strata = ["a", "b", "c"][: rng.randint(1, 3)]
        splits = rng.choice([SPLITS, (("x", 0.5), ("y", 0.5)), (("x", 0.7), ("y", 0.15), ("z", 0.15), ("none", 0.0)), (("x", 1 / 3), ("y", 0.61), ("z", 0.01))])
        vectors = [({s: rng.randint(0, 40) for s in strata} | {strata[0]: rng.randint(1, 40)}, rng.choice([1, 2, 7, 40, 900])) for _ in range(rng.randint(1, 12))]
        vectors = [({s: k for s, k in v.items() if k} | {"*": sum(v.values())}, n) for v, n in vectors]
        vectors.sort(key=lambda x: -x[0]["*"])
        totals = {s: sum(v.get(s, 0) * n for v, n in vectors) for s in [*strata, "*"]}
        fast, slow = _Dealer(splits, totals), _Dealer(splits, totals)
        assert [fast.deal(v, n) for v, n in vectors] == [slow.deal(v, n, bulk=False) for v, n in vectors]


def test_vectors_over_several_tasks_and_forests_over_several_levels(spark):
    rng = random.Random(3)
    rows = [(str(i), rng.choice([None, f"A{i % 7}", f"a-0{i % 211}"]), rng.choice(["easy", "hard"]), 0) for i in range(2500)]
    df = spark.createDataFrame(rows, "example_id string, template_id string, difficulty string, scored_at long")
    whole = {tuple(r) for r in template_splits(df).collect()}
    assert len(whole) == 2500 and {tuple(r) for r in template_splits(df, task_vectors=7, task_links=20).collect()} == whole


def test_one_huge_group_and_zero_share(spark):
    members = spark.createDataFrame([(str(i), "big" if i < 500 else str(i), "x") for i in range(1000)], "id string, grp string, stratum string")
    n = Counter(r.split for r in assign_groups(members, [("train", 0.5), ("test", 0.5), ("none", 0.0)]).collect())
    assert n == {"train": 500, "test": 500}


def test_empty(spark):
    df = spark.createDataFrame([], "example_id string, template_id string, difficulty string, scored_at long")
    assert template_splits(df).count() == 0 and same_names(df, "template_id").count() == 0
