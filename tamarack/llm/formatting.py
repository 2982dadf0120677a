"""Records that differ only in how they are typed, collapsed by commutative multiset hashing.

Every normalized (field, value) pair is hashed by itself and the hashes are added modulo
2^128, so the order of fields and of list entries cannot matter and nothing is sorted.
Only ids and fingerprints are shuffled to find groups; the fields themselves are looked at
again for the members of groups alone, each compared with the group's first record.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.sqltext import statement_parts
from tamarack.operators.parallel import spread
from tamarack.operators.skew import hot_aware_join, side
from tamarack.storage import materialize

_MASK = (1 << 128) - 1
Normalize = Callable[[str | None], tuple[list[str], str] | None]


def fingerprint(parts: list[tuple[list[str], str] | None]) -> int:
    """The sum of the hashes of all (field, value) pairs; a null field is a pair of its own."""
    total = 0
    for k, part in enumerate(parts):
        if part is None:
            pairs = [b"%d|null" % k]
        else:
            pairs = [b"%d|item|" % k + c.encode("utf-8", "surrogatepass") for c in part[0]]
            pairs.append(b"%d|rest|" % k + part[1].encode("utf-8", "surrogatepass"))
        for p in pairs:
            total += int.from_bytes(blake2b(p, digest_size=16).digest(), "little")
    return total & _MASK


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashes(n: int, normalize: Normalize):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = [], []
            for row in zip(*(batch.column(2 + k).to_pylist() for k in range(n)), strict=True):
                h = fingerprint([normalize(v) for v in row])
                hi.append(_signed(h >> 64))
                lo.append(_signed(h & 0xFFFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["id", "version", "hi", "lo"])

    return run


def _fields(n: int, normalize: Normalize):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, rest = [], []
            for row in zip(*(batch.column(3 + k).to_pylist() for k in range(n)), strict=True):
                parts = [normalize(v) for v in row]
                seen: Counter[tuple[int, str]] = Counter()
                mine = []
                for k, p in enumerate(parts):
                    for c in p[0] if p else ():
                        seen[k, c] += 1
                        mine.append(f"{k}|{seen[k, c]}|{c}")  # numbered, so that equal multisets are equal sets
                items.append(mine)
                rest.append([None if p is None else p[1] for p in parts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(items, pa.list_(pa.string())), pa.array(rest, pa.list_(pa.string()))], ["id", "version", "first_id", "items", "rest"])

    return run


def formatting_classes(records: DataFrame, record_id: str, fields: list[str], version: str | None = None, normalize: Normalize = statement_parts, bits: Callable[[F.Column], F.Column] = lambda c: c) -> DataFrame:
    """(id, first_id): for every distinct record id the smallest id that says the same.

    Of rows with one id the one with the latest ``version`` counts (ties: any fixed one).
    Two null fields agree; a null and an empty field do not. Rows with a null id are left
    out; other columns are ignored; an empty table gives an empty result. ``normalize`` gives
    a field's (multiset of parts, rest), by default those of a SQL statement. ``bits`` maps a
    half of the fingerprint, for tests of what happens when fingerprints collide.
    """
    rows = records.select(
        F.col(record_id).cast("string").alias("id"),
        (F.col(version).cast("string") if version else F.lit("")).alias("version"),
        *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)),
    ).where("id is not null")
    n = len(fields)
    hashed = spread(rows).mapInArrow(_hashes(n, normalize), "id string, version string, hi bigint, lo bigint").withColumn("hi", bits(F.col("hi"))).withColumn("lo", bits(F.col("lo")))
    one = materialize(hashed.groupBy("id").agg(F.max(F.struct("version", "hi", "lo")).alias("m")).select("id", "m.hi", "m.lo"))
    total = one.count()
    groups = materialize(one.groupBy("hi", "lo").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    members = materialize(hot_aware_join(one, groups, ["hi", "lo"], "n", total).select("id", "first_id"))
    texts = rows.join(side(members), "id").select("id", "version", "first_id", *(f"f{k}" for k in range(n)))
    said = texts.mapInArrow(_fields(n, normalize), "id string, version string, first_id string, items array<string>, rest array<string>")
    latest = materialize(said.groupBy("id").agg(F.max(F.struct("version", "first_id", "items", "rest")).alias("m")).select("id", "m.first_id", "m.items", "m.rest"))
    heads = materialize(latest.where("id = first_id").select("first_id", F.col("items").alias("items0"), F.col("rest").alias("rest0")).join(side(groups.select("first_id", "n")), "first_id"))
    checked = hot_aware_join(latest, heads, ["first_id"], "n", total)
    agree = (F.col("rest") == F.col("rest0")) & (F.size("items") == F.size("items0")) & (F.size(F.array_except("items", "items0")) == 0)  # by hashing, nothing is sorted
    canonical = F.to_json(F.struct("rest", F.array_sort("items").alias("items")))
    verified = materialize(checked.select("id", "first_id", agree.alias("same"), F.when(~agree, F.md5(canonical)).alias("other"), F.when(~agree, canonical).alias("text")))
    # members whose fingerprint only collides with the first record's, which is all but never, are grouped by what they say in full
    apart = verified.where("not same")
    regrouped = apart.join(apart.groupBy("other", "text").agg(F.min("id").alias("own_first")), ["other", "text"]).select("id", F.col("own_first").alias("first_id"))
    alone = one.join(members, "id", "left_anti").select("id", F.col("id").alias("first_id"))
    return verified.where("same").select("id", "first_id").unionByName(regrouped).unionByName(alone)


def copies(classes: DataFrame) -> DataFrame:
    """(first_id, copy_id) of every record that is not the first of its class."""
    return classes.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def collapsed(classes: DataFrame) -> DataFrame:
    """(id, copies): one row a class, with the number of records it had."""
    return classes.groupBy(F.col("first_id").alias("id")).agg(F.count("*").alias("copies"))
