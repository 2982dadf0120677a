"""Train, validation and test splits that keep related records together.

Keys of one record are linked; linked keys are found by union-find: each partition turns
its links into a forest, forests are merged partition by partition, and while they are too
many for one task every node hooks onto its smallest neighbour and the forest of hooks is
contracted. Whole groups are then assigned largest first to the split furthest below its
target, in all and within each stratum. Groups of equal size vectors are interchangeable,
so the assignment runs over size vectors, however many groups share one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import letters, name_key
from tamarack.operators.components import components
from tamarack.operators.ranking import bucket_rank
from tamarack.operators.skew import hot_aware_join
from tamarack.storage import materialize

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def _parts(splits: list[tuple[str, float]]) -> list[int]:
    """The shares as whole numbers in the same proportions."""
    exact = [Fraction(str(p)) for _, p in splits]
    common = lcm(*(f.denominator for f in exact))
    return [int(f * common) for f in exact]


class _Dealer:
    """Gives groups to splits, each to the split furthest below its target, in whole numbers throughout.

    How far a split is below target for a group is the sum over the group's strata of its
    records there times the share of the split's target in that stratum that is still open,
    the whole counting as one more stratum.
    """

    def __init__(self, splits: list[tuple[str, float]], totals: dict[str, int], given: dict[str, list[int]] | None = None):
        self.part, self.totals = _parts(splits), totals
        self.usable = [i for i, p in enumerate(self.part) if p > 0]
        self.given = given or {s: [0] * len(splits) for s in totals}
        self.whole = sum(self.part)
        self.scale = lcm(*(n for n in totals.values() if n), 1)
        self.times = {i: lcm(*(self.part[j] for j in self.usable)) // self.part[i] for i in self.usable}

    def below(self, i: int, size: dict[str, int]) -> int:
        return self.times[i] * sum(k * (self.totals[s] * self.part[i] - self.whole * self.given[s][i]) * (self.scale // self.totals[s]) for s, k in size.items())

    def deal(self, size: dict[str, int], groups: int, bulk: bool = True) -> list[int]:
        """How many of ``groups`` groups of one size vector each split gets: the same as one by one, most of them at once.

        Each group lowers its split's distance by the same step, so one by one takes the
        ``groups`` largest terms of as many falling sequences. All but a few of each sequence
        lie above the level at which their real-valued numbers add up to ``groups``; those go
        at once, the last few one by one.
        """
        got = [0] * len(self.part)

        def give(i: int, n: int) -> None:
            got[i] += n
            for s, k in size.items():
                self.given[s][i] += k * n

        spare = len(self.usable) + 2
        if bulk and groups > spare * len(self.usable):
            far = {i: self.below(i, size) for i in self.usable}
            step = {i: self.times[i] * sum(k * k * self.whole * (self.scale // self.totals[s]) for s, k in size.items()) for i in self.usable}
            at = sorted(self.usable, key=lambda i: -far[i])
            for m in range(len(at), 0, -1):
                level = (sum(Fraction(far[i], step[i]) for i in at[:m]) - groups) / sum(Fraction(1, step[i]) for i in at[:m])
                if far[at[m - 1]] >= level:
                    break
            for i in at[:m]:
                give(i, max(0, int((far[i] - level) / step[i]) - spare))
        while sum(got) < groups:
            give(max(self.usable, key=lambda i: self.below(i, size)), 1)
        return got


def _deal_vectors(splits: list[tuple[str, float]], totals: dict[str, int], given: dict[str, list[int]]):
    """Over size vectors, largest first; a last row without a vector tells what the splits hold then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(splits, totals, {s: list(n) for s, n in given.items()})
        for batch in batches:
            out = []
            for vector, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = {k: int(n) for k, n in json.loads(vector)}
                size["*"] = sum(size.values())
                out.append(dealer.deal(size, groups))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["vector", "n", "got"])
        held = [n for s in sorted(totals) for n in dealer.given[s]]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([held], pa.list_(pa.int64()))], ["vector", "n", "got"])

    return run


def _deal_all(kinds: DataFrame, splits: list[tuple[str, float]], totals: dict[str, int], task_vectors: int) -> DataFrame:
    """(vector, n, got) for kinds (vector, n, size): range partitions of at most about ``task_vectors`` vectors, one after the other, each going on from what the last one gave."""
    kinds = materialize(kinds)
    parts = max(1, -(-kinds.count() // task_vectors))
    order = [F.desc("size"), F.col("vector")]
    ranged = materialize(kinds.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)) if parts > 1 else kinds.withColumn("part", F.lit(0))
    given = {s: [0] * len(splits) for s in totals}
    out = None
    for part in range(parts):
        chunk = ranged.where(F.col("part") == part).repartition(1).sortWithinPartitions(*order).select("vector", "n")
        dealt = materialize(chunk.mapInArrow(_deal_vectors(splits, totals, given), "vector string, n bigint, got array<bigint>"))
        if part + 1 < parts:
            held = iter(dealt.where("vector is null").first()["got"])
            given = {s: [next(held) for _ in splits] for s in sorted(totals)}
        dealt = dealt.where("vector is not null")
        out = dealt if out is None else out.unionByName(dealt)
    return out


def assign_groups(members: DataFrame, splits: list[tuple[str, float]] = SPLITS, task_vectors: int = 200_000) -> DataFrame:
    """(id, grp, stratum, split) for members (id, grp, stratum): whole groups in one split each.

    ``stratum`` null counts as a stratum of its own; there must be few strata. The result is
    the same on every run. A task holds about ``task_vectors`` different size vectors, which
    changes nothing about the result.
    """
    members = materialize(members.select("id", "grp", F.coalesce(F.col("stratum"), F.lit("")).alias("stratum")))
    total = members.count()
    cells = members.groupBy("grp", "stratum").agg(F.count("*").alias("n"))
    groups = materialize(cells.groupBy("grp").agg(F.sum("n").alias("size"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("stratum", "n"))), lambda x: F.array(x["stratum"], x["n"].cast("string")))).alias("vector")))
    totals = {r["stratum"]: r["n"] for r in members.groupBy("stratum").agg(F.count("*").alias("n")).collect()}  # few strata
    totals["*"] = total
    kinds = groups.groupBy("vector").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    given = _deal_all(kinds, list(splits), totals, task_vectors)
    n_groups = groups.count()
    ranked = materialize(bucket_rank(groups, ["vector"], ["grp"], total_rows=n_groups))
    dealt = hot_aware_join(ranked, given, ["vector"], "n", n_groups)
    split: Column | None = None
    end = F.lit(0)
    for i, (name, _) in enumerate(splits):
        end = end + F.col("got")[i]
        split = F.when(F.col("rank") < end, name) if split is None else split.when(F.col("rank") < end, name)
    placed = materialize(dealt.select("grp", "size", split.alias("split")))
    return hot_aware_join(members, placed, ["grp"], "size", total).select("id", "grp", "stratum", "split")


def typed_links(values: DataFrame, column: str, key: Column) -> DataFrame:
    """Links (a, b) between each value of ``column`` as stored and the key that it names."""
    return values.select(F.concat(F.lit("v:"), F.col(column)).alias("a"), F.concat(F.lit("k:"), key).alias("b")).distinct()


def same_names(rows: DataFrame, column: str, key: Column | None = None) -> DataFrame:
    """(a, b): pairs of different stored values of ``column`` that are linked through the key that they name; nulls and values that name nothing are in no pair."""
    found = components(typed_links(rows.where(F.col(column).isNotNull()), column, name_key(F.col(column)) if key is None else key))
    values = found.where("node like 'v:%'").select(F.substring("node", 3, 1 << 30).alias("value"), "root")
    return values.select(F.col("value").alias("a"), "root").join(values.select(F.col("value").alias("b"), "root"), "root").where("a < b").select("a", "b")


def grouped_splits(records: DataFrame, record_id: str, keys: dict[str, Column], stratum: Column | None = None, version: str | None = None, splits: list[tuple[str, float]] = SPLITS, task_links: int = 500_000, task_vectors: int = 200_000) -> DataFrame:
    """(id, grp, stratum, split): records that share any key, directly or through others, are in one split.

    ``keys`` maps a name to the expression of a key; a record whose keys are all null stands
    alone. A record id that is there repeatedly counts once, with its latest ``version``;
    null ids are left out. Other columns of ``records`` are ignored.
    """
    names = list(keys)
    raw = records.select(F.col(record_id).cast("string").alias("id"), (F.col(version) if version else F.lit(0)).alias("version"), *(F.concat(F.lit(f"{n}:"), keys[n]).alias(f"k{i}") for i, n in enumerate(names)), (stratum if stratum is not None else F.lit("")).alias("stratum")).where("id is not null")
    payload = F.struct("version", *(f"k{i}" for i in range(len(names))), "stratum")
    once = materialize(raw.groupBy("id").agg(F.max(payload).alias("r")).select("id", F.array_compact(F.array(*(f"r.k{i}" for i in range(len(names))))).alias("ks"), "r.stratum"))
    own = F.concat(F.lit("record:"), F.col("id"))
    pairs = once.where("size(ks) > 0").select(F.explode(F.transform("ks", lambda k: F.struct(F.get("ks", F.lit(0)).alias("a"), k.alias("b")))).alias("e")).select("e.a", "e.b")
    roots = components(pairs, task_links)
    first = once.withColumn("key", F.get("ks", F.lit(0)))
    sizes = first.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    sized = materialize(roots.select(F.col("node").alias("key"), "root").join(sizes, "key"))
    linked = hot_aware_join(first.where("key is not null"), sized, ["key"], "n", once.count()).select("id", F.col("root").alias("grp"), "stratum")
    return assign_groups(linked.unionByName(first.where("key is null").select("id", own.alias("grp"), "stratum")), splits, task_vectors)


def split_report(assigned: DataFrame, splits: list[tuple[str, float]] = SPLITS) -> DataFrame:
    """(stratum, split, records, share, target, deviation, largest): what each split holds of each stratum.

    ``deviation`` is the share less the target, ``largest`` the share of the stratum's records
    that its largest group holds: where that is above a target, no split of whole groups can
    meet it.
    """
    cells = assigned.groupBy("stratum", "split", "grp").agg(F.count("*").alias("n"))
    counted = cells.groupBy("stratum", "split").agg(F.sum("n").alias("records"), F.max("n").alias("top"))
    total = counted.groupBy("stratum").agg(F.sum("records").alias("all"), F.max("top").alias("top"))
    parts = _parts(splits)
    target = F.create_map(*(x for (name, _), p in zip(splits, parts, strict=True) for x in (F.lit(name), F.lit(p / sum(parts)))))[F.col("split")]
    share = F.col("records") / F.col("all")
    return counted.drop("top").join(total, "stratum").select("stratum", "split", "records", share.alias("share"), target.alias("target"), (share - target).alias("deviation"), (F.col("top") / F.col("all")).alias("largest"))


def template_splits(results: DataFrame, **bounds: int) -> DataFrame:
    """Splits of scored answers: templates, however typed, are kept together; difficulty is the stratum.

    Each value as stored is linked with the template that it names, so that values become one
    group through union-find; a value that names nothing is none.
    """
    named = name_key(F.col("template_id"))
    return grouped_splits(results, "example_id", {"typed": F.when(named.isNotNull(), F.col("template_id")), "template": named}, letters(F.col("difficulty")), "scored_at", **bounds)
