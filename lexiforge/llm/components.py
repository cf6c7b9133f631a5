"""Connected components of an edge table, by alternating large and small stars.

Each round is two grouped minima with map-side partial aggregation, joined
back to the edges (a join that Spark splits where a node has very many
neighbours). Rounds are written to the folder in spark.checkpoint.dir
(no local checkpoint); the number of rounds grows with the logarithm of the
graph's size, not with the diameter.

Before each round tasks replace their edges by a spanning forest of them. Once
at most ``SMALL`` edges are left (a few megabytes, whatever the graph was), that
same step in one task ends the work; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.session import materialize


SMALL = 200_000


def _forest(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the least node that they connect it to;
    with ``roots`` also that node with itself."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [(x, r) for x, r in pairs if roots or x != r]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i:i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in part], kind), pa.array([r for _, r in part], kind)], ["src", "dst"])


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Large star: link every larger neighbour of u to the least of u and its
    neighbours. Small star: link u and its smaller neighbours to that least."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select(
        "src", F.least("src", "m").alias("m"))
    joined = both.join(least, "src")
    if larger_only:
        out = joined.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.explode(F.array("src", "dst")).alias("src"), F.col("m").alias("dst"))
    return out.where("src != dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL,
                         python: bool = True) -> DataFrame | None:
    """(node, component): the least node that edges (src, dst) reach from each
    node. None if there is no edge. Works for any ordered type. ``python=False``
    leaves out the forests and uses DataFrame operations only."""
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)
    cur = materialize(edges.mapInArrow(_forest, schema) if python else edges, "cc-edges")
    size = cur.count()
    if not size:
        return None
    before = None
    for _ in range(max_rounds):
        if python and size <= small:
            whole = cur.coalesce(1).mapInArrow(lambda batches: _forest(batches, True), schema)
            return materialize(whole, "cc-small").select(F.col("src").alias("node"), F.col("dst").alias("component"))
        cur = materialize(_star(_star(cur, True), False), "cc-round")
        # Done when every node hangs on a root and a round changes nothing.
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, size = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.groupBy("src").agg(F.min("dst").alias("component")).select(
        F.col("src").alias("node"), "component").unionByName(
        cur.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
