"""Parent-child rows to full hierarchies by fragment contraction.

Each level splits the forest into fragments of bounded size, follows the parent chains
inside every fragment to where they leave it, and keeps only the nodes at which chains
of other fragments arrive: the quotient forest. Leaves never survive a level, and a node
whose parent has no other child may be moved next to that parent, so chains shrink too;
the number of levels is logarithmic in the number of nodes. A quotient that fits one
fragment is solved there. On the way back the answers for a fragment's exits (one row for
each fragment and exit, however many children point at it) are brought to the fragment,
which completes roots, depths, paths and loops of its own nodes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.operators.skew import salted_join
from tamarack.storage import materialize

TREE, ON_LOOP, BELOW_LOOP = "in_tree", "on_loop", "below_loop"


def latest_rows(rows: DataFrame, node: str, parent: str, name: str | None, version: str | None) -> DataFrame:
    """One row (id, parent, name) for each node: the one with the latest version, ties by smallest parent, then name."""
    picked = rows.select(
        F.col(node).alias("id"),
        F.col(parent).alias("parent"),
        (F.col(name).cast("string") if name else F.lit(None).cast("string")).alias("name"),
        (F.col(version) if version else F.lit(0)).alias("version"),
    ).where("id is not null")
    newest = F.max_by(F.struct("parent", "name"), F.struct("version", "parent", "name")).alias("r")
    return picked.groupBy("id").agg(newest).select("id", "r.parent", "r.name")


def _follow(ids: list, parents: list, present: dict) -> tuple[list, list, list, list]:
    """For each node the index at which its chain inside the fragment stops, the nodes passed,
    and whether it runs into a loop (1 on it, 2 below it)."""
    n = len(ids)
    last, hops, loop, state = [0] * n, [0] * n, [0] * n, [0] * n
    for start in range(n):
        walk, i = [], start
        while state[i] == 0:
            state[i] = 1
            walk.append(i)
            j = present.get(parents[i], -1) if parents[i] is not None else -1
            if j < 0:
                last[i], hops[i], state[i] = i, 1, 2
                walk.pop()
                break
            i = j
        else:
            if state[i] == 1:  # the walk met itself
                at = walk.index(i)
                for k in walk[at:]:
                    loop[k], state[k] = 1, 2
                walk = walk[:at]
        for k in reversed(walk):
            j = present[parents[k]]
            if loop[j]:
                loop[k] = 2
            else:
                last[k], hops[k] = last[j], hops[j] + 1
            state[k] = 2
    return last, hops, loop, state


def _path(i: int, parents: list, present: dict, segs: list) -> list:
    out = []
    while True:
        out.extend(segs[i])
        j = present.get(parents[i], -1) if parents[i] is not None else -1
        if j < 0:
            return out
        i = j


def _length(i: int, parents: list, present: dict, weights: list, memo: dict) -> int:
    walk = []
    while i not in memo:
        walk.append(i)
        j = present.get(parents[i], -1) if parents[i] is not None else -1
        if j < 0:
            break
        i = j
    total = memo.get(i, 0)
    for k in reversed(walk):
        total += weights[k]
        memo[k] = total
    return total


def _contract(paths: bool, schema: pa.Schema):
    def contract(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_pylist() for c in group.column_names}
        ids, parents, segs, weights = col["id"], col["parent"], col["seg"], col["weight"]
        present = {x: i for i, x in enumerate(ids)}
        last, _, loop, _ = _follow(ids, parents, present)
        memo: dict[int, int] = {}
        rows = {
            "part": col["part"],
            "id": ids,
            "parent": parents,
            "exit": [None if loop[i] else parents[last[i]] for i in range(len(ids))],
            "tail": [None if loop[i] else col["tail"][last[i]] for i in range(len(ids))],
            "weight": [0 if loop[i] else _length(i, parents, present, weights, memo) for i in range(len(ids))],
            "seg": [_path(i, parents, present, segs) if paths and not loop[i] else [] for i in range(len(ids))],
            "loop": loop,
        }
        return pa.table(rows, schema=schema)

    return contract


def _expand(paths: bool, schema: pa.Schema):
    def expand(key: tuple, frag: pa.Table, known: pa.Table) -> pa.Table:
        f = {c: frag.column(c).to_pylist() for c in frag.column_names}
        # paths of answers stay in Arrow until a node needs one, and rows go back to it by the thousand
        far_path = known.column("path").combine_chunks() if known.num_rows else None
        answers = {r["id"]: r | {"at": k} for k, r in enumerate(known.select(["id", "root", "depth", "place"]).to_pylist())}
        present = {x: i for i, x in enumerate(f["id"])}
        circle: set[int] = set()
        for u, r in answers.items():  # a loop passes through the fragment from each of its entries to the exit
            i = present.get(u, -1) if r["place"] == ON_LOOP else -1
            while i >= 0 and i not in circle:
                circle.add(i)
                i = present.get(f["parent"][i], -1)
        done: list[pa.RecordBatch] = []
        out: dict[str, list] = {k: [] for k in ("id", "root", "depth", "place", "path")}
        for i, node in enumerate(f["id"]):
            if len(out["id"]) == 1000:
                done.append(pa.RecordBatch.from_pydict(out, schema=schema))
                out = {k: [] for k in out}
            far = answers.get(f["exit"][i]) if f["exit"][i] is not None else None
            if f["loop"][i]:
                row = (None, None, ON_LOOP if f["loop"][i] == 1 else BELOW_LOOP, None)
            elif far is None:
                row = (f["tail"][i], f["weight"][i] - 1, TREE, f["seg"][i])
            elif far["place"] != TREE:
                row = (None, None, ON_LOOP if i in circle else BELOW_LOOP, None)
            else:
                row = (far["root"], f["weight"][i] + far["depth"], TREE, f["seg"][i] + far_path[far["at"]].as_py() if paths else [])
            for k, v in zip(out, (node, *row), strict=True):
                out[k].append(v)
        return pa.Table.from_batches([*done, pa.RecordBatch.from_pydict(out, schema=schema)], schema)

    return expand


def _coin(node: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(level)), F.lit(2)) == 0


def _placed(level_rows: DataFrame, parts: int, level: int) -> DataFrame:
    """Give each row its fragment: its own id's, or its parent's where it is the only child (so that no hot parent draws a crowd)."""
    only = (
        level_rows.where("parent is not null")
        .groupBy("parent")
        .agg(F.count("*").alias("n"), F.min("id").alias("id"))
        .where("n = 1 and parent <> id")
        .select("id", F.col("parent").alias("sole_parent"))
        .where(_coin(F.col("id"), level) & ~_coin(F.col("sole_parent"), level))
    )
    home = F.coalesce(F.col("sole_parent"), F.col("id"))
    return level_rows.join(only, "id", "left").select(F.pmod(F.xxhash64(home, F.lit(level)), F.lit(parts)).cast("int").alias("part"), *level_rows.columns)


def _solve(rows: DataFrame, fragment_rows: int, paths: bool, level: int, hot_rows: int) -> DataFrame:
    kind = rows.schema["id"].dataType
    seg = T.ArrayType(T.StructType([T.StructField("id", kind), T.StructField("name", T.StringType())]))
    frag_schema = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(c, kind) for c in ("id", "parent", "exit", "tail")), T.StructField("weight", T.LongType()), T.StructField("seg", seg), T.StructField("loop", T.IntegerType())])
    out_schema = T.StructType([T.StructField("id", kind), T.StructField("root", kind), T.StructField("depth", T.LongType()), T.StructField("place", T.StringType()), T.StructField("path", seg)])
    from pyspark.sql.pandas.types import to_arrow_schema

    parts = max(1, -(-rows.count() // fragment_rows))
    placed = _placed(rows, parts, level) if parts > 1 else rows.select(F.lit(0).alias("part"), *rows.columns)
    frags = placed.groupBy("part").applyInArrow(_contract(paths, to_arrow_schema(frag_schema)), frag_schema)
    expand = _expand(paths, to_arrow_schema(out_schema))
    if parts == 1:
        none = rows.sparkSession.createDataFrame([], T.StructType([T.StructField("part", T.IntegerType()), *out_schema.fields]))
        return frags.groupBy("part").cogroup(none.groupBy("part")).applyInArrow(expand, out_schema)
    frags = materialize(frags)
    exits = frags.where("exit is not null").select("part", F.col("exit").alias("id")).distinct()
    arrived = exits.select("id").distinct()
    entries = materialize(frags.join(arrived, "id", "left_semi").select("part", "id", F.col("exit").alias("parent"), "tail", "weight", "seg", "loop"))
    # a node that runs into a loop inside its fragment enters the quotient as a loop of one node, so that chains that arrive there never end
    quotient = entries.select("id", F.when(F.col("loop") > 0, F.col("id")).otherwise(F.col("parent")).alias("parent"), "tail", "weight", "seg")
    known = materialize(_solve(quotient, fragment_rows, paths, level + 1, hot_rows))
    wanted = exits.unionByName(entries.select("part", "id")).distinct()
    if parts > hot_rows:  # a node may be wanted by every fragment
        wanted = materialize(wanted)
        sized = materialize(known.join(wanted.groupBy("id").agg(F.count("*").alias("wanted_by")), "id"))
        back = salted_join(wanted, sized, ["id"], "wanted_by", wanted.count(), hot_rows)
    else:
        back = wanted.join(known, "id")
    back = back.select(F.col("part").alias("fragment"), *out_schema.names)
    return frags.groupBy("part").cogroup(back.groupBy("fragment")).applyInArrow(expand, out_schema)


def resolve_hierarchy(rows: DataFrame, node: str, parent: str, name: str | None = None, version: str | None = None, paths: bool = True, fragment_rows: int = 20_000, hot_rows: int = 50_000) -> DataFrame:
    """Root, depth, place and path of every node of a forest of unknown depth.

    Returns (id, root, depth, place, path): ``place`` is ``in_tree``, or ``on_loop`` /
    ``below_loop`` for a node whose chain of parents never ends, with root, depth and path
    null. ``path`` is an array of (id, name) from the node up to its root (empty without
    ``paths``). A chain ends at a null parent or at a parent without a row. Rows with a
    null node id are left out; of several rows of a node the latest ``version`` counts.
    An empty table gives an empty result; other columns of ``rows`` are ignored.
    ``fragment_rows`` bounds the nodes that one task holds; the answer for a node that over
    ``hot_rows`` fragments ask for is sent out in copies.
    """
    nodes = latest_rows(rows, node, parent, name, version)
    first = nodes.select("id", "parent", F.col("id").alias("tail"), F.lit(1).cast("long").alias("weight"), (F.array(F.struct("id", "name")) if paths else F.array().cast(T.ArrayType(T.StructType([T.StructField("id", nodes.schema["id"].dataType), T.StructField("name", T.StringType())])))).alias("seg"))
    return _solve(materialize(first), fragment_rows, paths, 0, hot_rows)


def closure(resolved: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs, distance 0 left out: the descendants of every node as rows, so that no root's list must fit a task."""
    steps = resolved.where("place = 'in_tree'").select(F.col("id").alias("descendant"), F.posexplode("path").alias("distance", "step"))
    return steps.where("distance > 0").select(F.col("step.id").alias("ancestor"), "descendant", "distance")
