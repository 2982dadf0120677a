from collections import Counter
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tamarack.llm.sampling import Cell, calibrate, sample_report, target_sampler, tilt

TARGETS = "plan_id int, difficulty string, domain string, target_share decimal(6,4), min_rows int, sample_rows int"


def test_newton_meets_overlapping_targets():
    rng = np.random.default_rng(1)
    features = np.array([[a == i for i in range(3)] + [b == j for j in range(2)] for a in range(3) for b in range(2)], float)
    design = rng.integers(5, 500, 6).astype(float)
    targets = features.T @ (design * np.exp(features @ rng.normal(size=5)))
    assert np.allclose(features.T @ tilt(design, features, targets), targets, rtol=1e-6)


def test_margins_hold_where_a_cell_is_short():
    share = Decimal("0.25")
    have = {("easy", "sales"): 900, ("easy", "hr"): 900, ("hard", "sales"): 900, ("hard", "hr"): 10}
    cells = calibrate([Cell(1, k, "/".join(k), share, 0, 400, n) for k, n in have.items()])
    got = {c.names: c.expected for c in cells}
    assert [c.names for c in cells if c.gap] == [("hard", "hr")] and abs(sum(got.values()) - 400) < 1e-6
    # every margin has a target of 200; the short cell's ninety go to its row and column, and its opposite gives them up only as far as its need lets it
    assert got["hard", "hr"] == 10 and got["easy", "sales"] >= 100 - 1e-6
    alike = got["hard", "sales"], got["easy", "hr"]
    assert abs(alike[0] - alike[1]) < 1e-6 and alike[0] > 1.3 * got["easy", "sales"] >= 130 - 1e-4


def test_newton_reaches_the_optimum_between_bounds():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(2, 6), rng.integers(2, 7)
        names, n = [(i, j) for i in range(a) for j in range(b)], rng.integers(50, 5000)
        want, high = n * rng.dirichlet(np.full(a * b, 0.5)), rng.integers(0, 2 * n // (a * b) + 2, a * b).astype(float)
        low = np.minimum(high, rng.integers(0, 20, a * b))
        if not low.sum() < n < high.sum():
            continue
        features = np.array([[1] + [i == k for k in range(a)] + [j == k for k in range(b)] for i, j in names], float)
        targets = features.T @ want
        slack = np.concatenate([[0], 1e-3 * np.maximum(targets[1:], 1)])
        w = tilt(want, features, targets, low=low, high=high, slack=slack)
        assert abs(w.sum() - n) < 1e-4 and (w >= low).all() and (w <= high).all()
        # the multipliers follow from the misses; what they leave unexplained is the whole's, the same for all free cells
        rest = np.log(np.maximum(w, 1e-300) / want) - features[:, 1:] @ ((targets - features.T @ w)[1:] / slack[1:])
        free = (w > low + 1e-9) & (w < high - 1e-9)
        assert not free.any() or np.ptp(rest[free]) < 1e-4


def test_bounds_and_whole_hold_for_any_plan():
    rng = np.random.default_rng(4)
    for _ in range(200):
        names = [(f"d{i}", f"m{j}") for i in range(rng.integers(1, 5)) for j in range(rng.integers(1, 5))]
        shares = rng.dirichlet(np.full(len(names), 0.5))
        whole = int(rng.integers(1, 500))
        cells = [Cell(1, n, "/".join(n), Decimal(str(round(float(s), 4))), int(rng.integers(0, 9)), whole, int(rng.integers(0, 300))) for n, s in dict(zip(names, shares)).items()]
        out = calibrate(cells)
        floors = sum(min(c.least, c.available) for c in out)
        room = sum(c.available if c.share > 0 else min(c.least, c.available) for c in out)
        total = sum(c.expected for c in out)
        assert abs(total - min(max(whole, floors), max(room, floors))) < 1e-3
        fits = sum(min(c.needed, c.available) for c in out) <= whole
        for c in out:
            assert min(c.needed if fits else c.least, c.available) - 1e-6 <= c.expected <= c.available + 1e-6
            assert c.gap == (c.available < c.needed)


def test_every_short_cell_is_named(spark):
    records, targets = data(spark)
    sampler = target_sampler(records, targets)
    for r in sample_report(sampler, sampler.draw()).collect():
        assert (r.unmet is not None) == (r.sampled < r.needed) and (r.unmet == "too_few_records") == r.gap


def data(spark):
    rows = [(f"a{i:04}", "Easy", "SALES ", i) for i in range(2000)] + [(f"b{i:04}", "very hard", "sales", i) for i in range(30)] + [(f"c{i}", "hard", "hr", i) for i in range(3)]
    rows += [("a0001", "Easy", "SALES ", 5), ("x", None, "sales", 1), ("y", "unknown", "sales", 1), (None, "easy", "sales", 1)]
    plans = [(1, "easy", "sales", Decimal("0.5"), 1, 100), (1, "very_hard", "sales", Decimal("0.3"), 1, 100), (1, "hard", "hr", Decimal("0.2"), 1, 100)]
    plans += [(2, "easy", "sales", Decimal("0.99"), 1, 50), (2, "very_hard", "sales", Decimal("0.01"), 20, 50), (2, "hard", "hr", Decimal("0"), 0, 50)]
    return spark.createDataFrame(rows, "example_id string, difficulty string, domain string, scored_at long"), spark.createDataFrame([(p, d, m, s.quantize(Decimal("0.0001")), f, n) for p, d, m, s, f, n in plans], TARGETS)


def test_sample(spark):
    records, targets = data(spark)
    sampler = target_sampler(records, targets)
    for buckets in (50_000, 100):
        drawn = sampler.draw(seed=3, bucket_rows=buckets)
        rows = drawn.collect()
        assert len(rows) == len(set(rows))
        got = Counter((r.plan_id, r.cell) for r in rows)
        # plan 1: hard/hr has only 3 of its 20, the rest is shared 5 to 3 up to the 30 that there are
        assert got == {(1, "easy/sales"): 67, (1, "veryhard/sales"): 30, (1, "hard/hr"): 3, (2, "easy/sales"): 30, (2, "veryhard/sales"): 20}
        assert sorted(map(tuple, sampler.draw(seed=3, bucket_rows=buckets).collect())) == sorted(map(tuple, rows))
    report = {(r.plan_id, r.difficulty): (r.needed, r.available, r.gap) for r in sample_report(sampler, drawn).collect()}
    assert report[1, "hard"] == (20, 3, True) and report[2, "very_hard"] == (20, 30, False) and report[1, "very_hard"] == (30, 30, False)


def test_every_record_has_its_chance(spark):
    records, targets = data(spark)
    sampler = target_sampler(records.where("difficulty = 'Easy'"), targets.where("plan_id = 2"))
    seen = Counter(r.id for seed in range(12) for r in sampler.draw(seed).where("cell = 'easy/sales'").collect())
    assert len(seen) > 12 * 50 * 0.75


def test_empty(spark):
    records, targets = data(spark)
    sampler = target_sampler(records.limit(0), targets)
    assert sampler.draw().count() == 0 and sampler.report().where("gap").count() == 5
    assert target_sampler(records, targets.limit(0)).draw().count() == 0
    assert records.where(F.col("example_id").isNull()).count() == 1
