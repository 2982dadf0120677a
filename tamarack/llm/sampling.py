"""Samples whose shares of each category match given targets.

The category counts of the population are aggregated once, distributedly. A plan's expected
sample is calibrated over them: nearest to the target shares by exponential tilting, with
the margins of both labels held to theirs, every cell between its floor and all it has, and
the whole sample at its size. Newton steps on the dual solve that; where a cell has too few
records, the multipliers of its two margins raise the other cells of its row and column.
Every record then has an inclusion probability, and the pivotal method draws the sample:
within hash buckets of a cell, then among the buckets' undecided records, then among the
cells'. Cell sizes come out as their expectation rounded down or up, and the whole sample
has its size.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import ROUND_CEILING, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import letters
from tamarack.storage import materialize


@dataclass(frozen=True)
class Cell:
    """A category of a plan with what is asked of it, what there is, and what to expect in the sample."""

    plan: int
    names: tuple[str, ...]
    key: str
    share: Decimal
    least: int
    whole: int
    available: int
    expected: float = 0.0
    #: Whether calibration gives less than needed even where the sample may grow to hold all that is needed.
    gap: bool = False

    @property
    def needed(self) -> int:
        return max(self.least, int((self.share * self.whole).to_integral_value(ROUND_CEILING)))

    @property
    def probability(self) -> float:
        return self.expected / self.available if self.available else 0.0


def tilt(design: np.ndarray, features: np.ndarray, targets: np.ndarray, steps: int = 300, low: np.ndarray | None = None, high: np.ndarray | None = None, slack: np.ndarray | None = None) -> np.ndarray:
    """Weights clip(design * exp(features @ lam), low, high) whose moments features.T @ weights meet the targets: Newton on the dual with damped steps.

    These are the weights nearest to ``design`` in relative entropy. A target with a ``slack``
    above 0 may be missed at the price of the squared miss over twice the slack, so that
    targets that contradict the bounds or one another still have a solution. Features whose
    target is 0 or that no unit has are met by the lowest weight.
    """
    floor = np.zeros(len(design)) if low is None else np.asarray(low, float)
    roof = np.full(len(design), np.inf) if high is None else np.asarray(high, float)
    give = np.zeros(len(targets)) if slack is None else np.asarray(slack, float)
    live = (targets > 0) & (features.T @ design > 0)
    units = (features[:, ~live & (targets <= 0)].sum(axis=1) == 0) & (design > 0)
    out = floor.copy()
    x, d, lo, hi, s = features[np.ix_(units, live)], design[units], floor[units], roof[units], give[live]
    t = (targets - features[~units].T @ floor[~units])[live]
    if not x.size:
        return out
    lam = np.zeros(x.shape[1])

    def at(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = x @ v
        return u, np.clip(d * np.exp(np.clip(u, -700, 700)), lo, hi)

    def dual(v: np.ndarray) -> float:
        u, w = at(v)
        grown = np.where(w > 0, w * (1 + u - np.log(np.maximum(w, 1e-300) / d)), 0.0)
        return float(grown.sum() - t @ v + 0.5 * s @ v**2)

    damp = 0.0
    for _ in range(steps):
        _, w = at(lam)
        slope = x.T @ w + s * lam - t
        if np.abs(slope).max() <= 1e-10 * max(1.0, np.abs(t).max()):
            break
        inside = np.where((w > lo) & (w < hi), w, 0.0)  # weights at a bound do not move
        curve, stiff, now = (x * inside[:, None]).T @ x + np.diag(s), (x * w[:, None]).T @ x + np.diag(s), dual(lam)
        while damp < 1e12:  # a bound met on the way bends the dual: a step that does not lower it is damped
            step = np.linalg.lstsq(curve + max(damp, 1e-9) * stiff, slope, rcond=None)[0]
            if dual(lam - step) <= now - 1e-4 * float(slope @ step):
                break
            damp = max(10 * damp, 1e-6)
        else:
            break
        lam, damp = lam - step, damp / 10
    out[units] = at(lam)[1]
    return out


#: A margin may miss its target by about this share of it in exchange for cells nearer to theirs.
MARGIN_SLACK = 1e-3


def _expected(cells: list[Cell], low: np.ndarray, whole: float) -> np.ndarray:
    """Expected sizes that sum to ``whole``, or as near as floors and records allow: the cells' targets tilted so that both margins hold, nothing below ``low`` or above what there is."""
    have = np.array([c.available for c in cells], float)
    share = np.array([float(c.share) for c in cells])
    low = np.minimum(low, have)
    high = np.where(share > 0, have, low)
    if whole <= low.sum() or not (share > 0).any():
        return low
    if whole >= high.sum():
        return high
    want = whole * share / share.sum()
    margins = [np.array([c.names[k] == v for c in cells], float) for k in range(len(cells[0].names)) for v in sorted({c.names[k] for c in cells})]
    features = np.stack([np.ones(len(cells)), *margins], axis=1)
    targets = features.T @ want
    weight = tilt(want, features, targets, low=low, high=high, slack=np.concatenate([[0.0], MARGIN_SLACK * np.maximum(targets[1:], 1.0)]))
    # the whole to the last digit: one factor for all cells, found by halving
    a, b = -60.0, 60.0
    base = np.where(weight > 0, weight, 0.0)
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if np.clip(base * np.exp(m), low, high).sum() < whole else (a, m)
    return np.clip(base * np.exp(b), low, high)


def calibrate(cells: list[Cell]) -> list[Cell]:
    """The cells of one plan with the expected sample of each, and whether what it needs cannot be had.

    Every cell is calibrated to at least what it needs, where all that is needed fits the
    sample; otherwise floors win over shares. A ``gap`` is a cell that stays below its need
    even in a sample that may grow to hold all needs.
    """
    n = cells[0].whole
    have = np.array([c.available for c in cells], float)
    needed = np.array([c.needed for c in cells], float)
    low = np.minimum(needed, have)
    grown = _expected(cells, low, max(n, low.sum()))
    sample = grown if low.sum() <= n else _expected(cells, np.array([c.least for c in cells], float), n)
    return [replace(c, expected=float(sample[i]), gap=bool(grown[i] < needed[i] - 1e-6)) for i, c in enumerate(cells)]


def _pivot(ids: list[str], probs: list[float], rng: np.random.Generator) -> tuple[list[str], tuple[str, float] | None]:
    """The sequential pivotal method: what is drawn, and the one record that stays undecided, if any."""
    drawn, held, a = [], None, 0.0
    dice = rng.random(len(ids))
    for x, b, u in zip(ids, probs, dice, strict=True):
        if b >= 1 - 1e-9:
            drawn.append(x)
        elif b <= 1e-12:
            continue
        elif held is None or a <= 1e-12:
            held, a = x, b
        elif a + b < 1:
            if u * (a + b) >= a:
                held = x
            a += b
        else:
            if u * (2 - a - b) < 1 - b:
                drawn.append(held)
                held = x
            else:
                drawn.append(x)
            a = a + b - 1
        if held is not None and a >= 1 - 1e-9:
            drawn.append(held)
            held, a = None, 0.0
    return drawn, (held, a) if held is not None and a > 1e-9 else None


_UNIT = pa.schema([("plan_id", pa.int64()), ("cell", pa.string()), ("id", pa.string()), ("p", pa.float64())])
_UNIT_DDL = "plan_id bigint, cell string, id string, p double"


def _seed(*parts: object) -> np.random.Generator:
    from hashlib import blake2b

    return np.random.default_rng(int.from_bytes(blake2b(repr(parts).encode(), digest_size=8).digest(), "little"))


def _first_round(chances: dict[tuple[int, str], float], seed: int):
    def run(key: tuple, units: pa.Table) -> pa.Table:
        cell, bucket = key[0].as_py(), key[1].as_py()
        ids = sorted(units.column("id").to_pylist())
        rows: list[tuple] = []
        for (plan, c), p in chances.items():
            if c == cell and p > 0:
                rng = _seed(seed, plan, cell, bucket)
                drawn, rest = _pivot([ids[i] for i in rng.permutation(len(ids))], [p] * len(ids), rng)
                rows += [(plan, cell, x, 1.0) for x in drawn] + ([(plan, cell, *rest)] if rest else [])
        return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []], schema=_UNIT)

    return run


def _next_round(seed: int, last: bool):
    def run(key: tuple, units: pa.Table) -> pa.Table:
        rows = sorted(units.to_pylist(), key=lambda r: (r["cell"], r["id"]))
        cell_of = {r["id"]: r["cell"] for r in rows}
        plan = rows[0]["plan_id"]
        rng = _seed(seed, "then", *(k.as_py() for k in key))
        drawn, rest = _pivot([r["id"] for r in rows], [r["p"] for r in rows], rng)
        out = [(plan, cell_of[x], x, 1.0) for x in drawn]
        if rest and (not last or rng.random() < rest[1]):
            out.append((plan, cell_of[rest[0]], rest[0], 1.0 if last else rest[1]))
        return pa.table([list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []], schema=_UNIT)

    return run


@dataclass
class Sampler:
    """A population with the plans to draw from it."""

    population: DataFrame  # id, cell
    cells: list[Cell]

    def report(self) -> DataFrame:
        """One row a cell of a plan: what it needs, what there is, whether the target can be met."""
        rows = [(c.plan, *c.names, c.share, c.least, c.whole, c.needed, c.available, c.expected, c.gap) for c in self.cells]
        return self.population.sparkSession.createDataFrame(rows, "plan_id int, difficulty string, domain string, target_share decimal(6,4), min_rows int, sample_rows int, needed int, available bigint, expected double, gap boolean")

    def draw(self, seed: int = 0, bucket_rows: int = 50_000) -> DataFrame:
        """(plan_id, cell, id): a sample for each plan, the same on every run with the same seed."""
        buckets = max(1, -(-sum({c.key: c.available for c in self.cells}.values()) // bucket_rows))
        chances = {(c.plan, c.key): c.probability for c in self.cells}
        spread = self.population.where("cell is not null").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
        first = materialize(spread.groupBy("cell", "bucket").applyInArrow(_first_round(chances, seed), _UNIT_DDL))
        second = materialize(first.where("p < 1").groupBy("plan_id", "cell").applyInArrow(_next_round(seed, False), _UNIT_DDL))
        third = second.where("p < 1").groupBy("plan_id").applyInArrow(_next_round(seed, True), _UNIT_DDL)
        return first.where("p = 1").unionByName(second.where("p = 1")).unionByName(third).select(F.col("plan_id").cast("int").alias("plan_id"), "cell", "id")


def target_sampler(records: DataFrame, targets: DataFrame, record_id: str = "example_id", labels: tuple[str, str] = ("difficulty", "domain"), version: str | None = "scored_at") -> Sampler:
    """A sampler of ``records`` by the plans of ``targets`` (plan_id, the two labels, target_share, min_rows, sample_rows; a small table).

    A record id that is there repeatedly counts once, with its latest ``version``; null ids
    are left out. A record belongs to the cell that its labels name, however typed; with a
    missing or unknown label to none.
    """
    a, b = labels
    cell = F.concat(letters(F.col(a)), F.lit("/"), letters(F.col(b)))
    plans = targets.select("plan_id", a, b, "target_share", "min_rows", "sample_rows", cell.alias("key")).distinct().collect()  # a small table of plans
    known = sorted({r["key"] for r in plans})
    rows = records.select(F.col(record_id).cast("string").alias("id"), cell.alias("cell"), (F.col(version) if version else F.lit(0)).alias("version")).where("id is not null")
    once = rows.groupBy("id").agg(F.max(F.struct("version", "cell")).alias("r"))
    population = materialize(once.select("id", F.col("r.cell").alias("cell")).where(F.col("cell").isin(known)) if known else once.select("id", F.col("r.cell").alias("cell")).where("false"))
    counts = {r["cell"]: r["n"] for r in population.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
    by_plan: dict[int, list[Cell]] = {}
    for r in sorted(plans, key=lambda r: (r["plan_id"], r["key"])):
        by_plan.setdefault(r["plan_id"], []).append(Cell(r["plan_id"], (r[a], r[b]), r["key"], Decimal(r["target_share"]), r["min_rows"], r["sample_rows"], counts.get(r["key"], 0)))
    return Sampler(population, [c for cells in by_plan.values() for c in calibrate(cells)])


def sample_report(sampler: Sampler, drawn: DataFrame) -> DataFrame:
    """The report with the records drawn, their share of the plan's sample, and ``unmet``.

    ``unmet`` says why fewer than needed were drawn: ``too_few_records`` (a gap), or
    ``sample_full`` where all that is needed does not fit the sample; null where the need is met.
    """
    got = drawn.groupBy("plan_id", "cell").agg(F.count("*").alias("sampled"))
    spark = drawn.sparkSession
    keys = spark.createDataFrame([(c.plan, *c.names, c.key) for c in sampler.cells], "plan_id int, difficulty string, domain string, cell string")
    joined = sampler.report().join(F.broadcast(keys), ["plan_id", "difficulty", "domain"]).join(got, ["plan_id", "cell"], "left").drop("cell").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    whole = joined.groupBy("plan_id").agg(F.sum("sampled").alias("drawn"))
    share: Column = F.when(F.col("drawn") > 0, F.col("sampled") / F.col("drawn"))
    unmet = F.when(F.col("sampled") < F.col("needed"), F.when(F.col("gap"), "too_few_records").otherwise("sample_full"))
    return joined.join(whole, "plan_id").select("plan_id", "difficulty", "domain", "target_share", "needed", "available", F.round("expected", 6).alias("expected"), "sampled", share.alias("sampled_share"), "gap", unmet.alias("unmet"))
