from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm.packing import _last_at_most, pack_documents, pack_histogram, pack_items, packing_report


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=25))
def test_histogram_is_kept_whole(histogram):
    patterns = pack_histogram(histogram, 40)
    placed = Counter()
    for count, items in patterns:
        assert sum(length * k for length, k in items) <= 40
        for length, k in items:
            placed[length] += count * k
    assert placed == Counter(histogram)
    bound = -(-sum(length * n for length, n in histogram.items()) // 40)
    assert sum(c for c, _ in patterns) <= 2 * bound + 1  # all but one are over half full


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_equals_placing_items_one_by_one(sizes):
    rooms = []
    for size in sorted(sizes, reverse=True):
        if not rooms or max(rooms) < size:
            rooms.append(30)
        at = rooms.index(max(rooms)) if rooms[-1] != 30 else len(rooms) - 1
        rooms[at] -= size
    # equal lengths fill one new container after the other, which leaves as many containers
    assert sum(c for c, _ in pack_histogram(dict(Counter(sizes)), 30)) <= len(rooms) + 1


def test_ranks_beyond_any_packed_key():
    ranks = np.array([0, 1 << 61, 0, 5], np.int64)
    lo, hi = np.array([0, 0, 2, 2]), np.array([2, 2, 4, 4])
    assert _last_at_most(lo, hi, ranks, np.array([(1 << 61) - 1, 1 << 61, 4, 1 << 62], np.int64)).tolist() == [0, 1, 2, 3]


def test_items(spark):
    sizes = [(i, s) for i, s in enumerate([*range(0, 60), *[7] * 300, 95, 20, 20, None])]
    items = spark.createDataFrame(sizes, "item long, n int")
    rows = pack_items(items, [("a", 20), ("b", 50)], "item", "n").collect()
    for pack, capacity in (("a", 20), ("b", 50)):
        mine = [r for r in rows if r.pack_name == pack]
        load, whole = defaultdict(int), defaultdict(list)
        for r in mine:
            load[r.container_id] += r.length
            whole[r.item_id].append((r.piece, r.start, r.length))
        assert all(v <= capacity for k, v in load.items() if k is not None) and load[None] == 0
        assert sorted(k for k in load if k is not None) == list(range(len([k for k in load if k is not None])))
        for i, s in sizes:
            cut = sorted(whole[i])
            assert sum(x[2] for x in cut) == (s or 0) and len(cut) == max(1, -(-(s or 0) // capacity))
            assert all(x[1] == x[0] * capacity for x in cut)
    again = pack_items(items, [("a", 20), ("b", 50)], "item", "n").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "x " * 500)], "doc_id long, text string")
    packs = spark.createDataFrame([("p", 64), ("p", 64)], "pack_name string, capacity_tokens int")
    report = packing_report(pack_documents(docs, packs)).collect()
    assert len(report) == 1 and report[0].containers == report[0].lower_bound
    empty = pack_documents(docs.limit(0), packs)
    assert empty.count() == 0
