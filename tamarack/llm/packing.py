"""Texts into containers of fixed capacity by histogram packing.

Only the histogram of lengths is packed: it has at most as many bins as the capacity, so
it fits the driver however many texts there are. Lengths are placed longest first into
patterns (multisets of lengths with a count); the patterns then say which ranks of each
length go to which containers, and texts join them by their rank among equal lengths.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.tokenize import VOCABULARY, count_tokens
from tamarack.operators.ranking import bucket_rank
from tamarack.storage import materialize

Pattern = tuple[int, tuple[tuple[int, int], ...]]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Shortest pack first: (count, ((length, items), ...)) patterns; lengths go, longest first, to the open patterns with the most room left."""
    open_: dict[int, list[Pattern]] = {}
    heap: list[int] = []  # the rooms of the open patterns, the largest first

    def put(room: int, pattern: Pattern) -> None:
        if room not in open_:
            open_[room] = []
            heapq.heappush(heap, -room)
        open_[room].append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or -heap[0] < length:
                most = capacity // length
                full, rest = divmod(left, most)
                if full:
                    put(capacity - most * length, (full, ((length, most),)))
                if rest:
                    put(capacity - rest * length, (1, ((length, rest),)))
                break
            room = -heap[0]
            count, items = open_[room].pop()
            if not open_[room]:
                del open_[room]
                heapq.heappop(heap)
            used = min(count, left)
            if used < count:
                put(room, (count - used, items))
            same = items[-1][0] == length
            put(room - length, (used, (*items[:-1], (length, items[-1][1] + 1)) if same else (*items, (length, 1))))
            left -= used
    return [p for patterns in open_.values() for p in patterns]


def _intervals(patterns: list[Pattern]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first container, items of the length in a container), containers numbered from 0."""
    rows, base, rank = [], 0, {}
    for count, items in patterns:
        for length, k in items:
            rows.append((length, rank.get(length, 0), base, k))
            rank[length] = rank.get(length, 0) + count * k
        base += count
    return rows


def _last_at_most(lo: np.ndarray, hi: np.ndarray, ranks: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each row the last place in [lo, hi) of ``ranks``, ascending there, whose rank is at most the row's; all rows step together."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        right = open_ & (ranks[np.minimum(mid, len(ranks) - 1)] <= rank)
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo - 1


def pack_items(items: DataFrame, packs: list[tuple[str, int]], item_id: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(pack_name, capacity, container_id, item_id, piece, start, length): every item in containers of each capacity.

    An item larger than the capacity is cut into pieces of the capacity and one remainder;
    nothing else is split. An item of size null or 0 takes no room: one row, container null.
    Repeated items are packed as often as they are there. ``packs`` lists names and
    capacities (at least 1).
    """
    spark = items.sparkSession
    capacities = dict(packs)
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be at least 1")
    size_of = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    sized = items.select(F.col(item_id).alias("item_id"), size_of.alias("size"))
    kinds = F.array(*(F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for n, c in capacities.items()))
    every = sized.select("item_id", "size", F.explode(kinds).alias("k")).select("item_id", "size", "k.*")
    last = F.greatest(F.expr("(size + capacity - 1) div capacity") - 1, F.lit(0))
    cut = every.select("item_id", "size", "pack_name", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    pieces = cut.select("pack_name", "capacity", "item_id", "piece", start.alias("start"), F.least(F.col("capacity"), F.col("size") - start).alias("length"))
    bins = pieces.groupBy("pack_name", "length").count().collect()  # at most capacity rows a pack
    table: list[tuple[int, int, int, int, int]] = []
    index = {name: i for i, name in enumerate(sorted(capacities))}
    for name, capacity in capacities.items():
        histogram = {r["length"]: r["count"] for r in bins if r["pack_name"] == name and r["length"]}
        table += [(index[name], *row) for row in _intervals(pack_histogram(histogram, capacity))]
    table.sort()
    shift = max([*capacities.values(), 1]) + 1
    code = np.array([p * shift + length for p, length, *_ in table], np.int64)
    rank = np.array([r for _, _, r, _, _ in table], np.int64)
    base = np.array([b for *_, b, _ in table], np.int64)
    each = np.array([k for *_, k in table], np.int64)
    shared = spark.sparkContext.broadcast((index, shift, code, rank, base, each))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shift, code, rank, base, each = shared.value
        for batch in batches:
            names = batch.column("pack_name").to_pylist()
            length = batch.column("length").to_numpy()
            r = batch.column("rank").to_numpy()
            mine = np.array([index[n] for n in names], np.int64) * shift + length
            if len(code):
                at = np.maximum(_last_at_most(np.searchsorted(code, mine), np.searchsorted(code, mine, side="right"), rank, r), 0)
                container = base[at] + (r - rank[at]) // each[at]
            else:
                container = np.zeros(len(names), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("pack_name"), batch.column("capacity"), pa.array(container, pa.int64(), mask=length == 0), *(batch.column(c) for c in ("item_id", "piece", "start", "length"))], ["pack_name", "capacity", "container_id", "item_id", "piece", "start", "length"])

    kind = sized.schema["item_id"].dataType.simpleString()
    total = sum(r["count"] for r in bins)
    ranked = bucket_rank(pieces, ["pack_name", "length"], ["item_id", "piece"], total_rows=total)
    return ranked.mapInArrow(place, f"pack_name string, capacity bigint, container_id bigint, item_id {kind}, piece bigint, start bigint, length bigint")


def pack_documents(docs: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text) by their tokens into each row of ``packs`` (pack_name, capacity_tokens)."""
    sizes = materialize(count_tokens(docs, ["doc_id"], vocabulary=vocabulary))
    kinds = [(r.pack_name, r.capacity_tokens) for r in packs.select("pack_name", "capacity_tokens").distinct().collect()]  # a fixed table
    return pack_items(sizes, kinds).withColumnRenamed("item_id", "doc_id")


def packing_report(packed: DataFrame) -> DataFrame:
    """For each pack its containers, tokens, unused tokens, share of room used, and the fewest containers that could do."""
    used = packed.where("length > 0").groupBy("pack_name", "capacity", "container_id").agg(F.sum("length").alias("tokens"))
    total = used.groupBy("pack_name", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    room = F.col("containers") * F.col("capacity")
    return total.select("pack_name", "capacity", "containers", "tokens", (room - F.col("tokens")).alias("unused_tokens"), (F.col("tokens") / room).alias("fill"), F.expr("(tokens + capacity - 1) div capacity").alias("lower_bound"), "fullest")
