"""Merkle manifest of a dataset: one digest for all rows, and a witness for each.

Leaves are digests of rows; the leaves of a group ascend by key. While more than
one node of a group is left, every ``ARITY`` consecutive ones (the last run may hold
fewer, even one) become the digest of their hex texts. The groups' roots, in the
groups' order (null first, then bytewise), become one root in the same way. A leaf's
witness holds the siblings in its run at every level up to that root.

**How it runs.** ``place`` sorts leaves over all tasks by ranges of (group, key, leaf),
so a group that holds a third of all rows is spread over as many tasks as its share,
and numbers each leaf within its group from counts by task. Leaves are then cut into
aligned blocks of ``BLOCK`` = 16^3 of one group; a task appends those of a block one by
one to a ``Witnesses`` accumulator. An open subtree keeps the partial witnesses of its
leaves; whenever a later sibling completes a run, each subtree in the run is
extended by its siblings. Block roots are further appends: they are placed in blocks
again, level by level, until every group has one root; the groups' roots go the same way.

Only block roots move up (one row for 4,096), and only their witnesses come
down again, one row a block, which stands before the block's leaves in the sorted
partition. So no task holds more than one block, whatever a group's size, and nothing
but digests is shuffled.

Defined results: null values hash as ``-``; a null key counts as the least, a null
group as a group of its own that comes first; rows of one key are ordered by their leaf
digests, equal rows are leaves of their own; columns outside ``fields`` do not count; an
empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import place
from lexiforge.operators.broadcast import bounded_broadcast
from lexiforge.session import materialize

ARITY = 16
LEVELS = 3
BLOCK = ARITY ** LEVELS


def leaf_digest(values: list[Column]) -> Column:
    """sha256 (hex) of the values: ``-`` for null, else byte count, ``:``, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in values]
    return F.sha2(F.concat(*parts), 256)


def node_digest(hexes: list[bytes]) -> bytes:
    """The digest of a run of nodes, given and returned as lowercase hex."""
    return hashlib.sha256(b"".join(hexes)).hexdigest().encode()


def levels_of(count: int) -> int:
    """Levels above ``count`` nodes until one is left."""
    n = 0
    while count > 1:
        count = -(-count // ARITY)
        n += 1
    return n


class Witnesses:
    """An append-only tree of up to ``levels`` levels that keeps a witness for each
    appended node.

    A subtree is (digest, first, last + 1 of the appended nodes below it). The partial
    witness of a node is what its subtrees have gathered so far: when a run is
    completed, each subtree in it gets its siblings left and right, once for all
    nodes below it.
    """

    def __init__(self, levels: int):
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]
        self.levels = levels
        self.count = 0
        #: by level, of each closed subtree: its first node, its last + 1, and its siblings
        self.steps: list[list[tuple[int, int, bytes, bytes]]] = [[] for _ in range(levels)]

    def append(self, digest: bytes) -> None:
        self.open[0].append((digest, self.count, self.count + 1))
        self.count += 1
        level = 0
        while level < self.levels and len(self.open[level]) == ARITY:
            self._close(level)
            level += 1

    def _close(self, level: int) -> None:
        run = self.open[level]
        hexes = [d for d, _, _ in run]
        for i, (_, first, last) in enumerate(run):
            self.steps[level].append((first, last, b"".join(hexes[:i]), b"".join(hexes[i + 1:])))
        self.open[level + 1].append((node_digest(hexes), run[0][1], run[-1][2]))
        self.open[level] = []

    def finish(self) -> bytes:
        """Close all runs, short ones too; the root."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]

    def witness(self) -> Iterator[list[tuple[bytes, bytes]]]:
        """After ``finish``, of each appended node its (left, right) siblings by level."""
        at = [0] * self.levels
        for k in range(self.count):
            out = []
            for level in range(self.levels):
                while self.steps[level][at[level]][1] <= k:
                    at[level] += 1
                out.append(self.steps[level][at[level]][2:])
            yield out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        digest = hashlib.sha256(left + digest + right).hexdigest().encode()
    return digest


def path_digest(path: list[tuple[bytes, bytes]]) -> bytes:
    """sha256 (hex) of all siblings, level by level, left to right."""
    h = hashlib.sha256()
    for left, right in path:
        h.update(left)
        h.update(right)
    return h.hexdigest().encode()


def pack_path(path: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: by level the two counts of siblings, then their digests."""
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpack_path(raw: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(raw):
        a, b = raw[at], raw[at + 1]
        text = raw[at + 2:at + 2 + 32 * (a + b)].hex().encode()
        out.append((text[:64 * a], text[64 * a:]))
        at += 2 + 32 * (a + b)
    return out


def _blocks(placed: DataFrame, group: str, digest: str) -> DataFrame:
    """(grp, n, block, pos, digest) in tasks that hold whole blocks, sorted."""
    return placed.select(F.col(group).alias("grp"), "n", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"),
                         "pos", F.unhex(digest).alias("digest"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of the sorted rows of one block, with (group, block)."""
    for batch in batches:
        group, block = batch.column(0).to_pylist(), batch.column(2).to_numpy()
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or block[i] != block[start] or group[i] != group[start]:
                yield (group[start], int(block[start])), batch.slice(start, i - start)
                start = i


def block_levels(n: int) -> int:
    """Levels that a block of a group of ``n`` nodes is raised."""
    return min(LEVELS, levels_of(n))


def block_roots(placed: DataFrame, group: str, digest: str) -> DataFrame:
    """(grp, pos, digest, n): the root of each block, as the next level's nodes."""
    kind = placed.schema[group].dataType.simpleString()
    rows = _in_blocks(_blocks(placed, group, digest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, tree, now, kind_ = [], None, None, pa.string()

        def closed():
            out.append((*now, tree.finish().decode()))

        def sent():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind_), pa.array(cols[1], pa.int64()),
                                               pa.array(cols[2], pa.string())], ["grp", "pos", "digest"])
        for key, piece in _runs(batches):
            kind_ = piece.column(0).type
            if key != now:
                if tree is not None:
                    closed()
                now, tree = key, Witnesses(block_levels(piece.column(1)[0].as_py()))
            for d in piece.column(4).to_pylist():
                tree.append(d.hex().encode())
            if len(out) > 10_000:
                yield sent()
        if tree is not None:
            closed()
        if out:
            yield sent()

    roots = rows.mapInArrow(run, f"grp {kind}, pos long, digest string")
    counts = placed.select(F.col(group).alias("g"), "n").groupBy("g").agg(
        F.ceil(F.max("n") / BLOCK).cast("long").alias("n"))
    small, _ = bounded_broadcast(counts)
    return roots.join(small, F.col("grp").eqNullSafe(F.col("g"))).drop("g")


def witnessed(placed: DataFrame, group: str, digest: str, above: DataFrame | None, extra: list[str],
              each: Callable, schema: str) -> DataFrame:
    """Append the leaves of every block again, extend their witnesses by that of the
    block (``above``: grp, block, path), and give ``each(group, positions, digests,
    extras, paths, above)`` of a block's leaves to make rows of ``schema``."""
    rows = placed.select(F.col(group).alias("grp"), "n", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "pos",
                         F.unhex(digest).alias("digest"), *[F.col(c) for c in extra], F.lit(None).cast("binary").alias("path"))
    if above is not None:
        nulls = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in extra]
        rows = rows.unionByName(above.select("grp", F.lit(0).cast("long").alias("n"), "block", F.lit(-1).cast("long").alias("pos"),
                                             F.lit(None).cast("binary").alias("digest"), *nulls, "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def whole():
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            first = table.column(3)[0].as_py() == -1
            up = unpack_path(table.column(table.num_columns - 1)[0].as_py()) if first else []
            t = table.slice(1) if first else table
            digests = [d.hex().encode() for d in t.column(4).to_pylist()]
            tree = Witnesses(block_levels(t.column(1)[0].as_py()))
            for d in digests:
                tree.append(d)
            tree.finish()
            return each(t, digests, tree.witness(), up)

        for key, piece in _runs(batches):
            if key != now:
                if held:
                    yield whole()
                now, held = key, []
            held.append(piece)
        if held:
            yield whole()

    return _in_blocks(rows).mapInArrow(run, schema)


def _raise(placed: DataFrame, group: str, digest: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Roots (grp, root) of all groups, and the witness (grp, block, path) of each
    block of ``placed`` below its group's root (None if no group has two blocks)."""
    roots = materialize(block_roots(placed, group, digest), name + "-roots")
    whole = roots.where("n = 1").select("grp", F.col("digest").alias("root"))
    rest = roots.where("n > 1")
    if rest.isEmpty():
        return whole, None
    kind = roots.schema["grp"].dataType.simpleString()
    upper, higher = _raise(rest, "grp", "digest", name)

    def each(t, digests, paths, up):
        return pa.RecordBatch.from_arrays(
            [t.column(0), t.column(3), pa.array([pack_path(p + up) for p in paths], pa.binary())], ["grp", "block", "path"])

    below = materialize(witnessed(rest, "grp", "digest", higher, [], each, f"grp {kind}, block long, path binary"), name + "-above")
    return whole.unionByName(upper), below


class Manifest:
    """The leaves, the groups' roots and the root of a dataset."""

    def __init__(self, leaves: DataFrame, groups: DataFrame, above: DataFrame | None, root: str | None):
        #: grp, key, leaf and carried columns, with pos and n
        self.leaves = leaves
        #: grp, subroot, path (from the subroot to the root)
        self.groups = groups
        self.above = above
        self.root = root


def build(rows: DataFrame, key: str, leaf: str, group: str, name: str = "merkle") -> Manifest:
    """A manifest over rows that carry their leaf digest (other columns are kept)."""
    keyed = materialize(rows, name + "-leaves")
    rest = [c for c in keyed.columns if c not in (group, key, leaf)]
    placed = place(keyed, group, [key, leaf, *rest], name + "-placed")
    roots, above = _raise(placed, group, leaf, name)
    tops = place(roots.withColumn("all", F.lit(0)), "all", ["grp"], name + "-groups")
    top, over = _raise(tops, "all", "root", name + "-top")
    first = top.first()
    kind = roots.schema["grp"].dataType.simpleString()

    def each(t, digests, paths, up):
        return pa.RecordBatch.from_arrays(
            [t.column(5), pa.array(digests).cast(pa.string()), pa.array([pack_path(p + up) for p in paths], pa.binary())],
            ["grp", "subroot", "path"])

    # the group's own value rides along, as the tree over groups has one group of its own
    carried = tops.withColumnRenamed("grp", "of")
    groups = materialize(witnessed(carried, "all", "root", over, ["of"], each, f"grp {kind}, subroot string, path binary"),
                         name + "-subroots")
    return Manifest(placed, groups, above, first["root"] if first else None)


def verify(manifest: Manifest, key: str, leaf: str, group: str, claimed: str) -> DataFrame:
    """(key, grp, leaf, subroot, root, proof_sha256, folded_root, verified) per leaf:
    the digest of its witness, and the root that its ``claimed`` digest (null: its
    own) leads to along its witness."""
    paths = manifest.groups.select("grp", F.col("path").alias("top"), "subroot")
    blocks = manifest.leaves.select(F.col(group).alias("grp"), F.floor(F.col("pos") / BLOCK).cast("long").alias("block")).distinct()
    above = manifest.above
    if above is None:
        whole = blocks.withColumn("path", F.lit(b""))
    else:
        whole = blocks.join(above.select(F.col("grp").alias("g"), F.col("block").alias("b"), "path"),
                            F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")), "left").select(
            "grp", "block", F.coalesce("path", F.lit(b"")).alias("path"))
    small, _ = bounded_broadcast(paths.select(F.col("grp").alias("g"), "top"), 100_000)
    whole = whole.join(small, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "block", F.concat("path", "top").alias("path"))
    root = manifest.root
    kind, id_kind = (manifest.leaves.schema[c].dataType.simpleString() for c in (group, key))

    def each(t, digests, paths, up):
        proof, folded, ok = [], [], []
        asked = t.column(6).to_pylist()
        for d, c, p in zip(digests, asked, paths):
            path = p + up
            proof.append(path_digest(path).decode())
            got = fold(c.encode() if c is not None else d, path).decode()
            folded.append(got)
            ok.append(got == root)
        return pa.RecordBatch.from_arrays(
            [t.column(5), t.column(0), pa.array(digests).cast(pa.string()), pa.array(proof, pa.string()),
             pa.array(folded, pa.string()), pa.array(ok, pa.bool_())],
            ["key", "grp", "leaf", "proof_sha256", "folded_root", "verified"])

    placed = manifest.leaves.withColumnRenamed(key, "key_").withColumnRenamed(claimed, "claimed_")
    out = witnessed(placed, group, leaf, whole, ["key_", "claimed_"], each,
                    f"key {id_kind}, grp {kind}, leaf string, proof_sha256 string, folded_root string, verified boolean")
    subs, _ = bounded_broadcast(manifest.groups.select(F.col("grp").alias("g"), "subroot"), 1_000_000)
    return out.join(subs, F.col("grp").eqNullSafe(F.col("g"))).select(
        F.col("key").alias(key), F.col("grp").alias(group), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256",
        "folded_root", "verified")


def document_leaves(docs: DataFrame, fields: list[str], key: str, group: str, text: str, tampered: Column) -> DataFrame:
    """(group, key, leaf, claimed): ``claimed`` is the digest of a row whose text was
    lower-cased (A-Z) where ``tampered`` holds, else null."""
    cols = [F.col(f"`{f}`") for f in fields]
    lowered = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = [lowered if f == text else F.col(f"`{f}`") for f in fields]
    return docs.select(F.col(f"`{group}`").alias(group), F.col(f"`{key}`").alias(key), leaf_digest(cols).alias("leaf"),
                       F.when(tampered, leaf_digest(other)).alias("claimed"))
