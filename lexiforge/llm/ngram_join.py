"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's set is its distinct five-word shingles (as 64-bit hashes). Two
sets with Jaccard similarity t or more share a token among the first
``n - ceil(t n) + 1`` of each, under *any* global order of tokens. Work runs in
these steps, none of which drops a pair that may link:

1. One pass gives each document its set's digest, size, a parity bitmap and
   small signatures of its prefixes under two further orders, and counts tokens in a
   sketch of fixed size. Documents with equal sets are one node from here on.
2. First order: tokens that the sketch calls frequent come last (by powers of
   two), the rest by a hash. A second pass emits the prefix tokens of each
   node, one row each. Nodes of one token are a cell; a token held by thousands is
   dealt into blocks of about ``BLOCK`` nodes, by another hash for each token.
   Cells with the same members are kept once.
3. In a cell a pair must pass the bounds of sizes and bitmaps and share, by their
   signatures, a prefix token under the second and the third order as well. Of the pairs
   that pass, the first round makes a spanning forest candidates, nearest pairs
   first. The second round takes every pair that passes and is not yet in one
   component, so each pair that passes is either tested or connected otherwise.
4. Candidates are compared whole; connected components over the links follow.
5. Of a token dealt into blocks, only members that are still in unlike components
   meet across blocks (those outside its largest component with all others), in the
   same two rounds. A group of m near copies is connected by its blocks, which differ
   from token to token, and so costs about m rows a token, not m * m.

Everything shuffled is narrow except the sets of nodes that have a candidate.

Node ids are 64 bits of a 128-bit digest. Sets that share them are found (their digests
differ) and take the other 64 bits; only if those clash too is an error raised. Equal
token hashes of different shingles are as likely as 2^-64 each.

Defined results: null texts and texts without words have an empty set and
link with nothing (the component is the own id); fewer than five words are
one shingle; repeated rows are documents of their own that link (equal sets);
a null id never becomes a component unless all of its component are null;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import mix64, slices, span_hashes, text_bytes, word_spans
from lexiforge.llm.components import connected_components
from lexiforge.operators.broadcast import bounded_broadcast
from lexiforge.session import materialize

WORDS = 5
SKETCH = 1 << 21
BLOCK = 1024
#: Classes of tokens beyond this one (4,096 documents) are dealt into blocks.
WIDE = 12
#: Rows of one group's cells that go to one task, about.
HEAVY = 4096
SLICE = 1 << 20
#: Orders beside the first.
ORDERS = (31, 32)


def shingle_sets(column: pa.Array, seed: int = 0, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    buf, offsets = text_bytes(pc.fill_null(column, ""))
    buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    starts, ends, row = word_spans(buf, offsets)
    w = span_hashes(buf, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    with np.errstate(over="ignore"):
        many = max(0, len(w) - words + 1)
        g = np.zeros(many, np.uint64)
        for k in range(words):
            g = g * np.uint64(0x9FB21C651E98DF25) + w[k:k + many]
        g = mix64(g, 100 + seed)
        for i in range(n):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= words:
                yield np.unique(g[a:b - words + 1])
            elif b > a:
                h = np.uint64(b - a)
                for x in w[a:b]:
                    h = h * np.uint64(0xC2B2AE3D27D4EB4F) + x
                yield mix64(np.array([h], np.uint64), 200 + seed)
            else:
                yield np.zeros(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bit j: whether an odd number of tokens falls on j. Four times as many bits
    as the power of two at or above the set's size (64 at least), so that few
    pairs below the threshold pass; sets over 8,192 tokens get that power alone,
    sets between get no fewer bits than smaller ones."""
    size = 1 << (len(s) - 1).bit_length()
    bits = max(64, min(4 * size, 8192), size)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def prefix_signature(s: np.ndarray, percent: int) -> bytes:
    """For each further order a bitmap of the prefix tokens (one bit a token): sets
    that share a prefix token share a bit. Bits grow with the prefix, 64 to 1,024."""
    p = prefix_size(len(s), percent)
    bits = min(1024, max(64, 1 << (2 * p * p - 1).bit_length()))
    out = []
    for order in ORDERS:
        r = mix64(s, order)
        top = np.partition(r, p - 1)[:p]
        on = np.zeros(bits, np.uint8)
        on[(mix64(top, 9) & np.uint64(bits - 1)).astype(np.int64)] = 1
        out.append(np.packbits(on, bitorder="little").tobytes())
    return b"".join(out)


def node_id(digest: bytes, clashes: frozenset, bits: int = 64) -> int:
    """The first 64 bits of a set's digest, or the others if sets share those."""
    node = int.from_bytes(digest[:8], "little", signed=True) >> (64 - bits)
    return int.from_bytes(digest[8:], "little", signed=True) if node in clashes else node


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def profile(docs: DataFrame, key: str, text: str, seed: int, percent: int = 75, bits: int = 64) -> DataFrame:
    """Rows (id, th, node, other, digest, n, bitmap, sig), and rows (part, counts) of the sketch."""
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("id"),
                    F.xxhash64(f"`{text}`").alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib
        counts, held = np.zeros(SKETCH, np.int64), []

        def count():
            if held:
                counts[:] += np.bincount((np.concatenate(held) & np.uint64(SKETCH - 1)).astype(np.int64),
                                         minlength=SKETCH)
                held.clear()

        names = ["id", "th", "node", "other", "digest", "n", "bitmap", "sig", "part", "counts"]
        id_type = pa.int64()
        for batch in slices(batches, max_bytes=SLICE):
            id_type = batch.column(1).type
            node, other, digest, n, bitmap, sig, tokens = [], [], [], [], [], [], []
            for s in shingle_sets(batch.column(0), seed):
                n.append(len(s))
                if len(s):
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    digest.append(d)
                    node.append(node_id(d, frozenset(), bits))
                    other.append(int.from_bytes(d[8:], "little", signed=True))
                    bitmap.append(parity_bitmap(s))
                    sig.append(prefix_signature(s, percent))
                    tokens.append(s)
                else:
                    for column in (node, other, digest, bitmap, sig):
                        column.append(None)
            held += tokens
            if sum(map(len, held)) > SKETCH // 2:
                count()
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(node, pa.int64()), pa.array(other, pa.int64()),
                 pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(bitmap, pa.binary()),
                 pa.array(sig, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        count()
        step = SKETCH // 32
        for i in range(32):
            part = counts[i * step:(i + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, id_type), *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(),
                                                                      pa.int64(), pa.binary(), pa.binary())],
                     pa.array([i], pa.int32()), pa.array([zlib.compress(part.astype("<u4").tobytes(), 1)])], names)

    return d.mapInArrow(run, f"id {kind}, th long, node long, other long, digest binary, n long, bitmap binary, "
                             "sig binary, part int, counts binary")


def token_classes(parts: DataFrame) -> tuple[np.ndarray, float]:
    """The class of each slot of the sketch: 0 for what noise may explain, else
    the power of two of its count. Summed by Spark; SKETCH bytes reach the driver."""
    def add(group: pa.Table) -> pa.Table:
        import zlib
        total = np.zeros(SKETCH // 32, np.int64)
        for x in group.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u4")
        return pa.table({"part": group.column("part").slice(0, 1),
                         "counts": pa.array([total.astype("<i8").tobytes()])})

    counts = np.zeros(SKETCH, np.int64)
    step = SKETCH // 32
    # Partial sums first, so that no group is as long as there are tasks.
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(zlib.decompress(x), "<u4").astype(np.uint32)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()),
                 pa.array([zlib.compress(x.astype("<u4").tobytes(), 1) for x in held.values()])], ["part", "counts"])

    halved = parts.select("part", "counts").coalesce(64).mapInArrow(combine, "part int, counts binary")
    for r in halved.groupBy("part").applyInArrow(add, "part int, counts binary").toLocalIterator():
        counts[r["part"] * step:(r["part"] + 1) * step] = np.frombuffer(r["counts"], "<i8")
    mean = counts.mean()
    extra = np.maximum(counts - 2 * mean, 0)
    return np.where(counts <= 3 * mean + 64, 0, np.log2(np.maximum(extra, 1)).astype(np.int64) + 1).astype(np.uint8), mean


def prefix_tokens(docs: DataFrame, text: str, classes, seed: int, percent: int, clashes: frozenset = frozenset(),
                  bits: int = 64) -> DataFrame:
    """(token, node, wide): the prefix of each node under the first order, one row a
    token. A task emits a node once, however many copies it reads. A token that the
    sketch gives 4,096 documents or more is dealt into blocks: ``token`` then
    names the block that the node falls in, and ``wide`` the token itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        table, seen = classes.value, set()
        for batch in slices(batches, max_bytes=SLICE):
            toks, nodes, wides, is_wide = [], [], [], []
            for s in shingle_sets(batch.column(0), seed):
                if not len(s):
                    continue
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if d in seen:
                    continue
                seen.add(d)
                node = node_id(d, clashes, bits)
                cls = table[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                rank = (cls.astype(np.uint64) << np.uint64(57)) | (mix64(s, 1) >> np.uint64(7))
                p = prefix_size(len(s), percent)
                top = np.argpartition(rank, p - 1)[:p]
                t, c = s[top], cls[top]
                wide = c > WIDE
                wides.append(t)
                is_wide.append(wide)
                if wide.any():
                    t = t.copy()
                    w = t[wide]
                    blocks = np.maximum((np.uint64(1) << c[wide].astype(np.uint64)) // np.uint64(BLOCK), np.uint64(1))
                    own = mix64(w ^ np.array([node], np.int64).view(np.uint64), 2) % blocks
                    t[wide] = mix64(w ^ mix64(own, 4), 6)
                toks.append(t)
                nodes.append(np.full(len(t), node, np.int64))
            if toks:
                on = np.concatenate(is_wide)
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(toks)), pa.array(np.concatenate(nodes)),
                     pa.array(np.concatenate(wides).view(np.int64), pa.int64(), mask=~on)], ["token", "node", "wide"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "token long, node long, wide long")


def token_cells(rows: DataFrame, partitions: int) -> DataFrame:
    """(a, b, wide, members): the cells of tokens that two nodes or more share."""
    names = ["a", "b", "wide", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        token = np.concatenate([b.column(0).to_numpy() for b in got])
        node = np.concatenate([b.column(1).to_numpy() for b in got])
        wide = np.concatenate([pc.fill_null(b.column(2), 0).to_numpy() for b in got])
        on = np.concatenate([b.column(2).is_valid().to_numpy(zero_copy_only=False) for b in got])
        del got
        order = np.lexsort((node, token))
        token, node, wide, on = token[order], node[order], wide[order], on[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, wide, on = token[new], node[new], wide[new], on[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.concatenate([first, [len(token)]]))
        wide, on = wide[first], on[first]
        h = node.view(np.uint64)
        with np.errstate(over="ignore"):
            a = np.add.reduceat(mix64(h, 21), first)
            b = np.add.reduceat(mix64(h, 22), first)
        # a lone member of a wide token's block is kept: it meets others later
        small = np.flatnonzero(((size >= 2) | on) & (size <= BLOCK))
        if len(small):       # cells with the same members are looked at once
            small = small[np.lexsort((wide[small], b[small], a[small]))]
            same = np.zeros(len(small), bool)
            same[1:] = ((a[small[1:]] == a[small[:-1]]) & (b[small[1:]] == b[small[:-1]])
                        & (wide[small[1:]] == wide[small[:-1]]) & (on[small[1:]] == on[small[:-1]]))
            small = small[~same]
        for i in range(0, len(small), 4096):
            part = small[i:i + 4096]
            at = np.repeat(first[part], size[part]) + np.arange(size[part].sum()) - np.repeat(
                np.cumsum(size[part]) - size[part], size[part])
            offsets = np.concatenate([[0], np.cumsum(size[part])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [_signed(a[part]), _signed(b[part]), pa.array(wide[part], pa.int64(), mask=~on[part]),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[at]))], names)
        for g in np.flatnonzero(size > BLOCK):
            own = node[first[g]:first[g] + size[g]]
            half = BLOCK // 2
            blocks = [own[i:i + half] for i in range(0, len(own), half)]
            for i in range(len(blocks)):
                for j in range(i + 1, len(blocks)):
                    m = np.concatenate([blocks[i], blocks[j]])
                    x = m.view(np.uint64)
                    with np.errstate(over="ignore"):
                        ha, hb = mix64(x, 21).sum(keepdims=True), mix64(x, 22).sum(keepdims=True)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(ha), _signed(hb), pa.array([int(wide[g])] if on[g] else [None], pa.int64()),
                         pa.array([m.tolist()], pa.list_(pa.int64()))], names)

    return rows.repartition(partitions, "token").mapInArrow(run, "a long, b long, wide long, members array<long>")


def cross_cells(member: DataFrame, comps: DataFrame | None, half: int = BLOCK // 2) -> DataFrame:
    """(a, b, least, wide, node): cells in which members of one wide token meet that are
    in unlike components: those outside the token's largest component, in chunks,
    with blocks of all its members. Tokens of one component make no cells."""
    rows = member.where("wide IS NOT NULL").select("wide", "node").distinct()
    rows = rows.withColumn("comp", F.col("node")) if comps is None else (
        rows.join(comps, "node", "left").select("wide", "node", F.coalesce("component", "node").alias("comp")))
    rows = materialize(rows, "join-wide")
    tokens = (rows.groupBy("wide", "comp").agg(F.count("*").alias("n")).groupBy("wide").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("m"), F.max("n").alias("most"))
        .where("m > most").select("wide", "main", F.ceil(F.col("m") / half).cast("long").alias("blocks"),
                                  F.ceil((F.col("m") - F.col("most")) / half).cast("long").alias("chunks")))
    small, _ = bounded_broadcast(tokens)
    rows = rows.join(small, "wide")
    chunk, block = F.pmod(F.xxhash64("node"), "chunks"), F.pmod(F.xxhash64("node", F.lit(1)), "blocks")
    everyone = rows.select("wide", "node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), block.alias("j"))
    outside = rows.where("comp != main").select("wide", "node", chunk.alias("i"),
                                                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    both = everyone.unionByName(outside).distinct()
    a = F.xxhash64("wide", "i", "j")
    return both.select(a.alias("a"), F.xxhash64("j", "i", "wide").alias("b"), a.alias("least"), "wide", "node")


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    while len(bitmap) > words:
        bitmap = bitmap[:len(bitmap) // 2] ^ bitmap[len(bitmap) // 2:]
    return bitmap


def _or_folded(sig: np.ndarray, words: int) -> np.ndarray:
    while sig.shape[-1] > words:
        sig = sig[..., :sig.shape[-1] // 2] | sig[..., sig.shape[-1] // 2:]
    return sig


def near_in_cell(n: np.ndarray, bitmaps: list[np.ndarray], sigs: list[np.ndarray], percent: int
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the pairs of a cell that sizes, bitmaps and the signatures of
    the further orders let pass; ``n`` rises. Distance: the differing bits, at most
    the tokens that differ."""
    words = np.array([len(b) for b in bitmaps])
    rows = {w: np.stack([_folded(b, w) for b in bitmaps if len(b) >= w]) for w in np.unique(words)}
    begin = {w: int(np.searchsorted(words, w)) for w in rows}
    # signatures (orders, words); larger sets never have fewer words
    sig_words = np.array([x.shape[1] for x in sigs])
    sig_rows = {w: np.stack([_or_folded(x, w) for x in sigs if x.shape[1] >= w]) for w in np.unique(sig_words)}
    sig_begin = {w: int(np.searchsorted(sig_words, w)) for w in sig_rows}
    out_i, out_j, out_d = [], [], []
    for i in range(len(n) - 1):
        stop = int(np.searchsorted(n, 100 * int(n[i]) // percent, side="right"))
        if stop <= i + 1:
            continue
        w = int(words[i])
        m = rows[w]
        at = begin[w]
        d = np.bitwise_count(m[i + 1 - at:stop - at] ^ m[i - at]).sum(axis=1, dtype=np.int64)
        # |x - y| + |y - x| <= (1 - t) / (1 + t) * (|x| + |y|)
        hit = np.flatnonzero((100 + percent) * d <= (100 - percent) * (n[i] + n[i + 1:stop]))
        if len(hit):
            w = int(sig_words[i])
            x, at = sig_rows[w], sig_begin[w]
            hit = hit[(x[hit + i + 1 - at] & x[i - at]).any(axis=2).all(axis=1)]
        if len(hit):
            out_i.append(np.full(len(hit), i))
            out_j.append(hit + i + 1)
            out_d.append(d[hit])
    if not out_i:
        e = np.zeros(0, np.int64)
        return e, e, e
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_d)


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def nearest_forest(i: np.ndarray, j: np.ndarray, d: np.ndarray, nodes: np.ndarray, root: list[int]) -> np.ndarray:
    """Which pairs (i, j) to take, nearest first, to connect what the pairs of a
    cell connect and ``root`` (parents, by ``nodes``; updated) does not yet: each
    part takes its nearest pair to another part, until no pair is left."""
    parts, label = np.unique(np.array([_find(root, x) for x in nodes.tolist()]), return_inverse=True)
    order = np.lexsort((j, i, d))
    a, b = label[i[order]], label[j[order]]
    own, taken = list(range(len(parts))), []
    while len(order):
        apart = a != b
        order, a, b = order[apart], a[apart], b[apart]
        at = np.arange(len(order))
        best = np.full(len(parts), len(order))
        np.minimum.at(best, a, at)
        np.minimum.at(best, b, at)
        for k in np.unique(best[best < len(order)]).tolist():
            x, y = _find(own, int(a[k])), _find(own, int(b[k]))
            if x != y:
                own[max(x, y)] = min(x, y)
                u, v = _find(root, int(parts[x])), _find(root, int(parts[y]))
                root[max(u, v)] = min(u, v)
                taken.append(int(order[k]))
        now = np.array([_find(own, x) for x in range(len(parts))])
        a, b = now[a], now[b]
    return np.array(taken, np.int64)


def candidates(members: DataFrame, partitions: int, forest: bool, percent: int) -> DataFrame:
    """(x, y, more): passing pairs of unlike components; with ``forest`` only
    those that connect the nodes of a task (at most one a node), and a row of
    nulls marks that others were left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        comp = table.column("comp").to_numpy()
        order = np.lexsort((node, n, b, a))
        a, b, node, n, comp = a[order], b[order], node[order], n[order], comp[order]
        bitmap, sig = table.column("bitmap").combine_chunks(), table.column("sig").combine_chunks()
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
        place = np.unique(node, return_inverse=True)[1]
        root = list(range(int(place.max()) + 1))
        more, seen_x, seen_y = False, [], []
        for s, e in zip(cut[:-1], cut[1:]):
            if e - s < 2 or (comp[s:e] == comp[s]).all():
                continue
            maps = [np.frombuffer(bitmap[int(k)].as_py(), "<u8") for k in order[s:e]]
            sigs = [np.frombuffer(sig[int(k)].as_py(), "<u8").reshape(len(ORDERS), -1) for k in order[s:e]]
            i, j, d = near_in_cell(n[s:e], maps, sigs, percent)
            unlike = comp[s:e][i] != comp[s:e][j]
            i, j, d = i[unlike], j[unlike], d[unlike]
            if not len(i):
                continue
            if forest:
                take = nearest_forest(i, j, d, place[s:e], root)
                more = more or len(take) < len(i)
                i, j = i[take], j[take]
            x, y = node[s:e][i], node[s:e][j]
            seen_x.append(np.minimum(x, y))
            seen_y.append(np.maximum(x, y))
        pairs = np.unique(np.stack([np.concatenate(seen_x), np.concatenate(seen_y)], axis=1), axis=0) \
            if seen_x else np.zeros((0, 2), np.int64)
        if more or len(pairs):
            x = pa.array([None, *pairs[:, 0].tolist()] if more else pairs[:, 0].tolist(), pa.int64())
            y = pa.array([None, *pairs[:, 1].tolist()] if more else pairs[:, 1].tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays([x, y], ["x", "y"])

    # Cells with one least member are mostly of one group of copies: together they
    # emit a pair once. Where such cells have many rows, they are dealt out again.
    heavy, _ = bounded_broadcast(members.groupBy("least").agg(F.count("*").alias("r")).where(f"r > {2 * HEAVY}").select(
        F.col("least").alias("l"), F.ceil(F.col("r") / HEAVY).cast("long").alias("salts")))
    dealt = members.join(heavy, F.col("least") == F.col("l"), "left")
    return (dealt.repartition(partitions, F.col("least"), F.pmod("a", F.coalesce("salts", F.lit(1))))
            .select("a", "b", "node", "n", "bitmap", "sig", "comp").mapInArrow(run, "x long, y long").distinct())


def set_rows(docs: DataFrame, key: str, text: str, wanted: DataFrame, seed: int, clashes: frozenset = frozenset(),
             bits: int = 64) -> DataFrame:
    """(node, tokens): the set of each wanted node, once."""
    small, _ = bounded_broadcast(wanted.select("id", "th").distinct())
    d = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("id"),
                    F.xxhash64(f"`{text}`").alias("th"))
    d = d.join(small.select(F.col("id").alias("i2"), F.col("th").alias("t2")),
               (F.col("th") == F.col("t2")) & F.col("id").eqNullSafe(F.col("i2")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        seen = set()
        for batch in slices(batches, max_bytes=SLICE):
            nodes, sets = [], []
            for s in shingle_sets(batch.column(0), seed):
                if len(s):
                    raw = s.tobytes()
                    node = node_id(hashlib.blake2b(raw, digest_size=16).digest(), clashes, bits)
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())],
                                             ["node", "tokens"])

    return d.mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("x"), F.col("tokens").alias("sx"))
    right = sets.select(F.col("node").alias("y"), F.col("tokens").alias("sy"))
    both = pairs.join(left, "x").join(right, "y").select("x", "y", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                b = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(keep))

    return both.mapInArrow(run, "src long, dst long")


def _classes(full: DataFrame) -> DataFrame:
    return materialize(full.groupBy("node").agg(
        F.min("id").alias("first_id"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("one"),
        F.min("digest").alias("d1"), F.max("digest").alias("d2"), F.min("n").alias("n"),
        F.min("bitmap").alias("bitmap"), F.min("sig").alias("sig")), "join-classes")


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75,
                    seed: int = 0, id_bits: int = 64) -> DataFrame:
    """(``key``, th, n_shingles, component_id, n_tested_links) per document.

    ``th``: xxhash64 of the text, which tells rows of one id apart.
    ``n_tested_links``: links that were verified at the document's node; links inside a component
    that needed no test are not counted. ``id_bits``: bits of the digest that a node's
    id takes at first (fewer make clashes likely, for tests).
    """
    spark = docs.sparkSession
    made = materialize(profile(docs, key, text, seed, percent, id_bits), "join-profile")
    rows = made.where("n IS NOT NULL").select("id", "th", "node", "other", "digest", "n", "bitmap", "sig")
    classes = _classes(rows.where("n > 0"))
    clashes = frozenset(r["node"] for r in classes.where("d1 != d2").select("node").limit(100_000).collect())
    if clashes:       # about n * n / 2^65 of n distinct sets
        small = F.broadcast(spark.createDataFrame([(x,) for x in clashes], "c long"))
        rows = rows.join(small, F.col("node") == F.col("c"), "left").withColumn(
            "node", F.when(F.col("c").isNotNull(), F.col("other")).otherwise(F.col("node")))
        classes = _classes(rows.where("n > 0"))
    facts = classes.agg(F.count("*").alias("nodes"),
                        F.sum((F.col("n") / 4 + 1).cast("long")).alias("prefix"),
                        F.max(F.col("d1") != F.col("d2")).alias("clash")).first()
    if facts["clash"]:
        raise ValueError("different sets share both halves of an id: choose another seed")
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    links = comps = None
    if facts["nodes"]:
        table, _ = token_classes(made.where("part IS NOT NULL").select("part", "counts"))
        shared = spark.sparkContext.broadcast(table)      # SKETCH bytes, at any size of the input
        tokens = prefix_tokens(docs, text, shared, seed, percent, clashes, id_bits)
        # cells with the same members are kept once; a node has one row for each prefix token
        cells = token_cells(tokens, max(least, facts["prefix"] // 500_000 + 1)).dropDuplicates(["a", "b", "wide"])

        def described(cell_rows):
            return cell_rows.join(classes.select("node", "n", "bitmap", "sig"), "node")
        member = materialize(described(
            cells.select("a", "b", F.array_min("members").alias("least"), "wide", F.explode("members").alias("node"))), "join-members")
        sets = (docs, key, text, seed, clashes, id_bits)
        links, comps = _rounds(sets, member, classes, percent, least, None, None)
        if not member.where("wide IS NOT NULL").isEmpty():
            across = materialize(described(cross_cells(member, comps)), "join-across")
            links, comps = _rounds(sets, across, classes, percent, least, links, comps)
    ids = classes.select("node", "first_id")
    if links is not None:
        labelled = comps.join(ids, "node")
        best = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
        ids = ids.join(labelled.join(best, "component").select("node", "component_id"), "node", "left") \
            .select("node", F.coalesce("component_id", "first_id").alias("first_id"))
        degree = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(
            F.count("*").alias("n_tested_links"))
        ids = ids.join(degree, "node", "left")
    else:
        ids = ids.withColumn("n_tested_links", F.lit(None).cast("long"))
    return (rows.select("id", "th", "node", "n").join(ids, "node", "left")
            .select(F.col("id").alias(key), "th", F.col("n").alias("n_shingles"),
                    F.coalesce("first_id", "id").alias("component_id"),
                    F.coalesce("n_tested_links", F.lit(0).cast("long")).alias("n_tested_links")))


def _rounds(source, member, classes, percent, least, links, comps):
    """(links, components) after a forest of candidates, then all that are still apart."""
    docs, key, text, seed, clashes, bits = source
    count = member.count()
    sets = None
    for forest in (True, False) if count else ():
        parts = max(least, count // 50_000 + 1)
        now = member.withColumn("comp", F.col("node")) if comps is None else (
            member.join(comps, "node", "left").select(*member.columns, F.coalesce("component", "node").alias("comp")))
        found = materialize(candidates(now.drop("wide"), parts, forest, percent), "join-pairs")
        pairs = found.where("x IS NOT NULL")
        if sets is None:
            alive = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
            wanted = classes.join(alive, "node", "left_semi").select("one.id", "one.th")
            sets = materialize(set_rows(docs, key, text, wanted, seed, clashes, bits), "join-sets")
            member = member.join(alive, "node", "left_semi")
        new = materialize(verify(pairs, sets, percent), "join-links")
        if not new.isEmpty():
            comps = merge_components(comps, new)
            links = new if links is None else links.unionByName(new)
        if found.where("x IS NULL").isEmpty():
            break
    return links, comps


def merge_components(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after further links: components are joined as wholes."""
    if comps is None:
        return connected_components(links)
    def label(side):
        return comps.select(F.col("node").alias(side), F.col("component").alias("c" + side))
    between = (links.join(label("src"), "src", "left").join(label("dst"), "dst", "left")
               .select(F.coalesce("csrc", "src").alias("src"), F.coalesce("cdst", "dst").alias("dst")))
    merged = connected_components(between)
    if merged is None:
        return comps
    old = comps.join(merged.select(F.col("node").alias("component"), F.col("component").alias("whole")),
                     "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    fresh = merged.join(comps.select("node"), "node", "left_anti")
    return materialize(old.unionByName(fresh), "join-components")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that copy an earlier one: of each
    component the row with the least id stays (documents without words all do). All
    columns come back as they are, whatever their names."""
    found = join_components(docs, key, text, **options)
    stay = found.where((F.col("n_shingles") == 0) | F.col(key).eqNullSafe(F.col("component_id")))
    chosen = materialize(stay.groupBy(F.col(key).alias("id"), "th").agg(
        F.count("*").alias("n"), F.min("n_shingles").alias("s")), "join-kept")
    # the row travels in a struct, so no column of the caller's can clash
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("row_id"),
                       F.xxhash64(f"`{text}`").alias("row_th"))
    kept = held.join(chosen, (F.col("row_th") == F.col("th")) & F.col("row_id").eqNullSafe(F.col("id")))
    if not chosen.where("n > 1 AND s > 0").isEmpty():      # the same row several times
        once, many = kept.where("n = 1 OR s = 0"), kept.where("n > 1 AND s > 0").dropDuplicates(["row_id", "row_th"])
        kept = once.unionByName(many)
    return kept.select("row.*")
