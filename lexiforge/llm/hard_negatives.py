"""Hard-negative mining with score bounds along spanning trees of anchors.

A component ``x`` counts as ``floor(scale * x)``; a score is the integer inner product
of two rows. An anchor's positives are the ``positives`` best other rows of its label; for
each positive the ``negatives`` best rows of other labels whose score lies between
``low`` and ``high`` per cent of the positive's are its hard negatives. Higher scores come
first, ties by the smaller id.

**Bounds.** Anchors of one label are put in groups of at most ``GROUP`` that are near
each other (sorted by the signs of random projections), and a minimum spanning tree is
made of each group. For a candidate c, a parent anchor p and its child a,
``|<a, c> - <p, c>| <= |a - p| * |c|``. So from the root, whose scores are computed, each
child's score is bounded by its parent's score or bounds, and the inner product is
computed only where the bounds overlap a window that can still matter: scores
above the running k-th best (positives), or inside ``low``..``high`` of a positive and
above the running k-th best there (negatives). No candidate is left out unless
its bounds prove that it cannot be in the result.

**How it runs.** Anchors go out in slices of at most ``SLICE_BYTES`` (counted, and split
until they fit); each slice takes two passes over all rows, one for positives and one for
negatives. A task keeps a running best list per anchor, and starts from lower limits
known beforehand (scores within the tree's group, or against ``SEEDS`` anchors of the
slice), so it emits few rows that are not results. Work is that of a stated query
set against all rows in blocks; memory is bounded by a slice and a batch.

Defined results: rows with a null id, label or vector or a null, infinite or NaN
component take no part; vectors of unlike lengths are scored as if the shorter ended
in zeros; an id that repeats is one row in a result, at its best score, and never its
own positive or negative (of equal anchor ids the least label and vector is the
anchor); fewer rows than asked are all returned; other columns are not read; an empty
table gives an empty result. Scores that do not fit 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import place, release_memory
from lexiforge.session import materialize

GROUP = 256
BATCH = 8192
SLICE_BYTES = 32 << 20
SEEDS = 1024
SIGNS = 16


def integer_rows(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(usable, matrix): which vectors have finite components only, and floor(scale *
    component) of those, short ones padded by zeros."""
    lists = column.cast(pa.large_list(pa.float64()))
    values = lists.flatten()       # of rows that are not null
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(length)), length)
    ok = column.is_valid().to_numpy(zero_copy_only=False).copy()
    ok[row[~np.isfinite(flat)]] = False
    width = int(length[ok].max()) if ok.any() else 0
    place_in = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros((int(ok.sum()), width))
    new = np.cumsum(ok) - 1
    keep = ok[row]
    out[new[row[keep]], place_in[keep]] = flat[keep]
    return ok, out


def widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def products(c: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows ``c`` with the row(s) ``a``."""
    most = np.sqrt((c * c).sum(axis=1).max(initial=0)) * np.sqrt((a * a).sum(axis=-1).max(initial=0))
    if most < 2 ** 52:
        return (c @ a.T).astype(np.int64)
    if most < 2 ** 62:
        return c.astype(np.int64) @ a.astype(np.int64).T
    raise ValueError("scores do not fit 64 bits: choose a smaller scale")


def spanning_tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, distance) of a minimum spanning tree of the rows: ``order``
    starts at the root, parents are places in it and come first."""
    n = len(a)
    left = np.ones(n, bool)
    near = np.zeros(n, np.int64)
    dist = np.full(n, np.inf)
    order, parent, edge = [], [], []
    at, squares = 0, (a * a).sum(axis=1)
    for k in range(n):
        order.append(at)
        parent.append(near[at] if k else 0)
        edge.append(dist[at] if k else 0.0)
        left[at] = False
        d = np.maximum(squares + squares[at] - 2 * (a @ a[at]), 0)
        closer = left & (d < dist)
        dist[closer], near[closer] = d[closer], k
        if k + 1 < n:
            at = int(np.where(left, dist, np.inf).argmin())
    order = np.array(order)
    parent = np.array(parent, np.int64)
    edge = np.array([0.0, *np.linalg.norm(a[order[1:]] - a[order[parent[1:]]], axis=1)]) if n > 1 else np.zeros(1)
    return order, parent, edge


class Tree:
    """Anchors of one group and label, in tree order."""

    def __init__(self, label: str, ids: np.ndarray, a: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.label, self.ids, self.a, self.parent, self.edge = label, ids, a, parent, edge
        self.norm = np.sqrt((a * a).sum(axis=1))
        #: per anchor the lowest score that still matters, and its windows (low, high)
        self.floor = np.full(len(ids), -np.inf)
        self.windows: list[np.ndarray] = []


class Best:
    """A running list of the best ``k`` (score, id) of distinct ids."""

    def __init__(self, k: int, floor: float = -np.inf):
        self.k, self.floor = k, floor
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor
        if not keep.any():
            return
        score, ids = np.concatenate([self.score, score[keep]]), np.concatenate([self.id, ids[keep]])
        order = np.lexsort((ids, -score))
        score, ids = score[order], ids[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:self.k]
        self.score, self.id = score[first], ids[first]
        if len(first) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def scan(tree: Tree, c: np.ndarray, norms: np.ndarray, ids: np.ndarray, wanted) -> int:
    """Go down the tree over candidates ``c``; ``wanted(j)`` gives the windows [(low,
    high, list)] of anchor j. Returns how many inner products were computed."""
    g, m = len(tree.ids), len(c)
    low, high = np.empty((g, m)), np.empty((g, m))
    computed = 0
    for j in range(g):
        if j:
            p = tree.parent[j]
            # the slack covers rounding; scores are whole numbers
            reach = tree.edge[j] * norms * (1 + 1e-9) + 1e-12 * (tree.norm[j] + tree.norm[p]) * norms + 1
            low[j], high[j] = low[p] - reach, high[p] + reach
            need = np.zeros(m, bool)
            for a, b, best in wanted(j):
                need |= (high[j] >= max(a, best.floor)) & (low[j] <= b)
            some = np.flatnonzero(need)
        else:
            some = np.arange(m)
        if not len(some):
            continue
        score = products(c[some] if len(some) < m else c, tree.a[j])
        computed += len(some)
        low[j, some] = high[j, some] = score
        own = ids[some]
        for a, b, best in wanted(j):
            hit = (score >= max(a, best.floor)) & (score <= b) & (own != tree.ids[j])
            if hit.any():
                best.add(score[hit], own[hit])
    return computed


def _batches(batches: Iterator[pa.RecordBatch], scale: float, width: int):
    """(ids, labels, matrix) of usable rows (id, label, vector), in runs of ``BATCH``."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            b = batch.slice(start, BATCH)
            ok, c = integer_rows(b.column(2), scale)
            if len(c):
                ids = b.column(0).to_numpy(zero_copy_only=False)[ok]
                labels = np.array(b.column(1).to_pylist(), object)[ok]
                yield ids.astype(np.int64), labels, widen(c, width)
        release_memory()


def _usable(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                       F.col(f"`{vector}`").alias("vector")).where(
        "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")


def plant(anchors: DataFrame, scale: float, positives: int) -> DataFrame:
    """One row per group of anchors (id, label, vector): label, bytes, and the tree."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, c in _batches(batches, scale, 0):
            plane = np.random.default_rng(5).standard_normal((4096, SIGNS))
            if c.shape[1] > 4096:
                plane = np.random.default_rng(5).standard_normal((c.shape[1], SIGNS))
            code = ((c @ plane[:c.shape[1]] > 0) @ (1 << np.arange(SIGNS - 1, -1, -1))).astype(np.int64)
            vectors = [np.trim_zeros(v, "b").astype("<f8").tobytes() for v in c]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(labels.tolist(), pa.string()), pa.array(code), pa.array(vectors, pa.binary())],
                ["id", "label", "code", "vec"])

    packed = anchors.mapInArrow(pack, "id long, label string, code long, vec binary")
    # of anchors with one id the least counts
    packed = packed.groupBy("id").agg(F.min(F.struct("label", "code", "vec")).alias("r")).select("id", "r.*")
    placed = place(packed, "label", ["code", "id"], "negatives-anchors")

    def grow(group: pa.Table) -> pa.Table:
        vectors = [np.frombuffer(v, "<f8") for v in group.column("vec").to_pylist()]
        width = max(1, max(map(len, vectors)))
        a = np.stack([np.pad(v, (0, width - len(v))) for v in vectors])
        ids = group.column("id").to_numpy()
        order, parent, edge = spanning_tree(a)
        a, ids = a[order], ids[order]
        # a lower limit for the positives: the k-th best in the group
        floor = np.full(len(ids), -np.inf)
        if len(ids) > positives:
            s = products(a, a).astype(np.float64)
            np.fill_diagonal(s, -np.inf)
            floor = np.sort(s, axis=1)[:, -positives]
        raw = [x.tobytes() for x in (ids.astype("<i8"), a.astype("<f8"), parent.astype("<i8"), edge.astype("<f8"), floor.astype("<f8"))]
        return pa.table({"label": group.column("label").slice(0, 1), "bytes": pa.array([sum(map(len, raw))]),
                         **{n: pa.array([x], pa.binary()) for n, x in zip(("ids", "a", "parent", "edge", "floor"), raw)}})

    return placed.select("label", F.floor(F.col("pos") / GROUP).alias("grp"), "id", "vec").groupBy("label", "grp").applyInArrow(
        grow, "label string, bytes long, ids binary, a binary, parent binary, edge binary, floor binary")


def _trees(rows: list) -> tuple[list[Tree], int]:
    trees = []
    for r in rows:
        ids = np.frombuffer(r["ids"], "<i8")
        t = Tree(r["label"], ids, np.frombuffer(r["a"], "<f8").reshape(len(ids), -1), np.frombuffer(r["parent"], "<i8"),
                 np.frombuffer(r["edge"], "<f8"))
        t.floor = np.frombuffer(r["floor"], "<f8")
        trees.append(t)
    width = max(t.a.shape[1] for t in trees)
    for t in trees:
        t.a = widen(t.a, width)
    return trees, width


def _pass(rows: DataFrame, trees: list[Tree], width: int, scale: float, k: int, same: bool) -> DataFrame:
    """(anchor, window, cand, score): the best ``k`` candidates of each task, per anchor
    and window, of the anchor's label (``same``) or of other labels."""
    shared = rows.sparkSession.sparkContext.broadcast((trees, width))      # one slice: SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, width = shared.value
        lists = []
        for t in forest:
            if same:
                lists.append([[(-np.inf, np.inf, Best(k, f))] for f in t.floor])
            else:
                lists.append([[(a, b, Best(k, f)) for _, a, b, f in w] for w in t.windows])
        for ids, labels, c in _batches(batches, scale, width):
            w = max(width, c.shape[1])
            norms = np.sqrt((c * c).sum(axis=1))
            for label in {t.label for t in forest}:
                at = np.flatnonzero((labels == label) if same else (labels != label))
                if not len(at):
                    continue
                cc, nn, ii = c[at], norms[at], ids[at]
                for t, best in zip(forest, lists):
                    if t.label == label:
                        if t.a.shape[1] < w:
                            t.a = widen(t.a, w)
                        scan(t, cc, nn, ii, best.__getitem__)
        out = [(int(t.ids[j]), i, x, s) for t, per in zip(forest, lists) for j in range(len(t.ids))
               for i, (_, _, b) in enumerate(per[j]) for s, x in zip(b.score.tolist(), b.id.tolist())]
        for i in range(0, len(out), 50_000):
            a, win, x, s = zip(*out[i:i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(win, pa.int32()), pa.array(x, pa.int64()),
                                              pa.array(s, pa.int64())], ["anchor", "window", "cand", "score"])

    found = rows.mapInArrow(run, "anchor long, window int, cand long, score long")
    once = found.groupBy("anchor", "window", "cand").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "cand")
    return once.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _windows(trees: list[Tree], found: list, low: int, high: int, negatives: int) -> None:
    """Set the windows of all anchors from their positives' scores, with lower limits
    from scores against at most ``SEEDS`` anchors of other labels in the slice."""
    scores: dict[int, list[tuple[int, int]]] = {}
    for r in found:
        scores.setdefault(r["anchor"], []).append((r["rank"], r["score"]))
    ids = np.concatenate([t.ids for t in trees])
    labels = np.concatenate([np.full(len(t.ids), i) for i, t in enumerate(trees)])
    pick = np.argsort((ids * 2654435761) % (1 << 32), kind="stable")[:SEEDS]
    seeds = np.concatenate([t.a for t in trees])[pick]
    names = np.array([t.label for t in trees], object)[labels[pick]]
    for t in trees:
        other = seeds[names != t.label]
        s = np.sort(products(t.a, other), axis=1) if len(other) else np.zeros((len(t.ids), 0), np.int64)
        t.windows = []
        for j, i in enumerate(t.ids.tolist()):
            wins = []
            for rank, p in sorted(scores.get(i, [])):
                a, b = -(-low * p // 100), high * p // 100
                lo, hi = np.searchsorted(s[j], a), np.searchsorted(s[j], b, side="right")
                wins.append((rank, a, b, float(s[j][hi - negatives]) if hi - lo >= negatives else -np.inf))
            t.windows.append(wins)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: float = 1, key: str = "vec_id", label: str = "label", vector: str = "embedding",
         slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score):
    see the module's text. ``anchors`` says which rows are anchors."""
    spark = rows.sparkSession
    usable = _usable(rows, key, label, vector)
    groups = materialize(plant(_usable(rows.where(anchors), key, label, vector), scale, positives), "negatives-trees")
    total = groups.agg(F.sum("bytes"), F.count("*")).first()
    out = []
    if total[0]:
        slices = max(1, -(-total[0] // slice_bytes))
        while slices < total[1]:     # split until every slice fits (or holds one group)
            number = F.pmod(F.xxhash64("ids"), F.lit(slices))
            if groups.groupBy(number.alias("s")).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] <= slice_bytes:
                break
            slices *= 2
        # A task emits its best rows per anchor: few large tasks rather than many small ones.
        tasks = max(2 * spark.sparkContext.defaultParallelism, usable.rdd.getNumPartitions() // 16) if slices else 1
        usable = usable.coalesce(tasks)
        for i in range(slices):
            part = groups.where(F.pmod(F.xxhash64("ids"), F.lit(slices)) == i).collect()
            if not part:
                continue
            trees, width = _trees(part)
            found = materialize(_pass(usable, trees, width, scale, positives, True), "negatives-positives")
            _windows(trees, found.select("anchor", "rank", "score").collect(), low, high, negatives)
            best = _pass(usable, trees, width, scale, negatives, False)
            pos = found.select(F.col("anchor").alias("a"), F.col("rank").alias("w"), F.col("cand").alias("positive_id"),
                               F.col("score").alias("positive_score"))
            # windows are numbered from 0 in the order of the positives' ranks
            out.append(materialize(best.join(pos, (F.col("anchor") == F.col("a")) & (F.col("window") + 1 == F.col("w"))).select(
                F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                F.col("cand").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-found"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                                         "negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
