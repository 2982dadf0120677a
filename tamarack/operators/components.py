"""Connected components by union-find over partitions.

Each partition turns its links into a forest, forests are merged partition by partition,
and while they are too many for one task every node hooks onto its smallest neighbour and
the forest of hooks is contracted, which at least halves the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.hierarchy import resolve_hierarchy
from tamarack.operators.skew import hot_aware_join
from tamarack.storage import materialize


def _forest(star: bool, most: int):
    """Union-find over the partition's links; gives (node, smallest node) rows if ``star``, else chains, in which no node has more than two links, and a node alone is linked to itself.

    Chains are given out whenever ``most`` nodes are held, so that a task's memory is bounded whatever its partition holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[str, str] = {}

        def find(x: str) -> str:
            root = x
            while up.setdefault(root, root) != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        def rows() -> Iterator[pa.RecordBatch]:
            last: dict[str, str] = {}
            left, right = [], []
            for x in list(up):
                root = find(x)
                if star:
                    left.append(x)
                    right.append(root)
                elif x != root:
                    left.append(last.get(root, root))
                    right.append(x)
                    last[root] = x
            for x in up:  # a node linked to itself alone stays in sight
                if not star and up[x] == x and x not in last:
                    left.append(x)
                    right.append(x)
            for i in range(0, len(left), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(left[i : i + 10_000], pa.string()), pa.array(right[i : i + 10_000], pa.string())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if not star and len(up) >= most:
                yield from rows()
                up.clear()
        yield from rows()

    return run


def components(links: DataFrame, task_links: int = 500_000, hot_rows: int = 50_000) -> DataFrame:
    """(node, root) for every node of the links (a string, b string): root is the smallest node that it is linked with, however far.

    Links with a null end are left out. A task holds about ``task_links`` nodes at most;
    a component of over ``hot_rows`` nodes is not brought together.
    """
    reduced = materialize(links.where("a is not null and b is not null").select(F.col("a").cast("string"), F.col("b").cast("string")).distinct().mapInArrow(_forest(False, task_links), "a string, b string"))
    left, parts, levels = reduced.count(), reduced.rdd.getNumPartitions(), []
    while left > task_links:
        parts = max(2, parts // 8)
        merged = materialize(reduced.repartition(parts).mapInArrow(_forest(False, task_links), "a string, b string")) if parts * task_links >= left else reduced
        after = merged.count()
        if after <= task_links or after < 0.5 * left:
            reduced, left = merged, after
            continue
        both = merged.select("a", "b").unionByName(merged.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.when(F.col("low") < F.col("a"), F.col("low")).alias("low"))
        roots = materialize(resolve_hierarchy(hooks, "a", "low", paths=False).select(F.col("id").alias("node"), "root"))
        levels.append(roots)
        ends = merged.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        reduced = materialize(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct().mapInArrow(_forest(False, task_links), "a string, b string"))
        left = reduced.count()
    solved = reduced.repartition(1).mapInArrow(_forest(True, task_links), "node string, root string")
    for roots in reversed(levels):
        # a root may stand for a large part of all nodes: one row a root, joined with regard to that
        counted = materialize(roots.groupBy("root").agg(F.count("*").alias("n")))
        far = materialize(counted.join(solved.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left"))
        solved = hot_aware_join(roots, far, ["root"], "n", roots.count(), hot_rows).select("node", F.coalesce("far", "root").alias("root"))
    return solved
