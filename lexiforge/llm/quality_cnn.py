"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of four bytes run over every byte of a text. Their largest
answers are taken over hops of 256 bytes; a chunk is two neighbouring hops, so
chunks of 512 bytes overlap by half and cover the whole text. Per filter, the
mean, the maximum and the minimum over the chunks, with how full the first
chunk is, go through one small layer to one probability. (In a chunk that
repeats few words most filters stay low, which the mean and minimum show; in
a short text they stay low too, which is why the fill counts.)

Applying a filter is a table look-up: two two-byte tables, added. Training runs
on the driver over a bounded sample of labelled rows: at most ``MAX_ROWS`` per
label, chosen by a hash of the id, ``MAX_CHUNKS`` chunks spread over the whole
of each text, and a fixed number of steps.

Defined results: null or empty texts are one chunk of zeros and get a score
like any other; without both labels the score is the share of label 1 (0.5
without labels); of contradictory labels of one document the larger counts;
repeated rows are each scored; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import slices, text_bytes

WIDTH, FILTERS, HIDDEN = 4, 16, 16
HOP = 256
CHUNK = 2 * HOP + WIDTH - 1
MAX_ROWS, MAX_CHUNKS = 5000, 6
STEPS, BATCH = 900, 64


@dataclass
class Network:
    filters: np.ndarray      # (WIDTH, 256, FILTERS)
    w1: np.ndarray           # (4 * FILTERS + FILLS, HIDDEN)
    b1: np.ndarray
    w2: np.ndarray           # (HIDDEN,)
    b2: float
    prior: float | None = None      # the score if nothing could be learned

    def head(self, feats: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(feats), self.prior)
        z = np.tanh(feats @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Scorer:
    """The look-up tables of one network, made once per task."""

    def __init__(self, net: Network, block: int = 32768):
        self.net, self.block = net, block
        t = net.filters.astype(np.float32)
        pair = np.arange(65536)
        self.first = t[0][pair >> 8] + t[1][pair & 255]
        self.second = t[2][pair >> 8] + t[3][pair & 255]

    def hops(self, buf: np.ndarray, starts: np.ndarray, stop: int) -> np.ndarray:
        """The largest answer of each filter between neighbouring ``starts``
        (sorted; the last runs to ``stop``); ``buf`` has WIDTH bytes beyond."""
        out = np.empty((len(starts), FILTERS), np.float32)
        pairs = (buf[:-1].astype(np.uint16) << np.uint16(8)) | buf[1:]
        i = 0
        while i < len(starts):
            j = int(np.searchsorted(starts, starts[i] + self.block, side="right"))
            j = max(j - 1, i + 1) if j < len(starts) else len(starts)
            a, b = int(starts[i]), int(starts[j]) if j < len(starts) else stop
            z = self.first.take(pairs[a:b], axis=0)
            z += self.second.take(pairs[a + 2:b + 2], axis=0)
            out[i:j] = np.maximum.reduceat(z, starts[i:j] - a, axis=0)
            i = j
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        buf, offsets = text_bytes(pc.fill_null(column, ""))
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        if self.net.prior is not None:
            return np.full(n, self.net.prior)
        # Each text is followed by WIDTH zeros, so no filter reads two texts.
        at = offsets[:-1] + WIDTH * np.arange(n)
        padded = np.zeros(len(buf) + WIDTH * (n + 1), np.uint8)
        where = np.arange(len(buf)) + np.repeat(WIDTH * np.arange(n), sizes)
        padded[where] = buf
        reach = np.maximum(sizes - WIDTH + 1, 1)           # positions at which a filter starts
        n_hops = -(-reach // HOP)
        # starts of hops, and after each text the start of what is left out
        text_of = np.repeat(np.arange(n), n_hops)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(n_hops) - n_hops, n_hops)
        starts = np.concatenate([at[text_of] + HOP * nth, at + reach])
        order = np.argsort(starts, kind="stable")
        real = order < len(text_of)
        answers = self.hops(padded, starts[order], len(padded) - WIDTH)[real]
        pooled, filled = pool(answers, n_hops), fill(sizes)
        return self.net.head(np.concatenate([pooled, (1 - filled[:, :1]) * pooled[:, :FILTERS], filled], axis=1))


def pool(hops: np.ndarray, n_hops: np.ndarray) -> np.ndarray:
    """Features of each text: mean, maximum and minimum over its chunks (pairs of
    neighbouring hops; a single hop is a chunk by itself) of tanh answers."""
    first = np.cumsum(n_hops) - n_hops
    a = np.tanh(hops)
    chunks = np.maximum(a, np.concatenate([a[1:], a[-1:]]))
    last = first + n_hops - 1
    keep = np.ones(len(a), bool)
    keep[last[n_hops > 1]] = False        # the last hop starts no chunk of its own
    chunks[last[n_hops == 1]] = a[last[n_hops == 1]]
    counts = np.maximum(n_hops - 1, 1)
    chunks = chunks[keep]
    at = np.cumsum(counts) - counts
    return np.concatenate([np.add.reduceat(chunks, at, axis=0) / counts[:, None],
                           np.maximum.reduceat(chunks, at, axis=0),
                           np.minimum.reduceat(chunks, at, axis=0)], axis=1)


FILLS = 4


def fill(sizes: np.ndarray) -> np.ndarray:
    """How full the first chunk is, on several scales."""
    share = np.minimum(sizes, CHUNK) / CHUNK
    return np.stack([share, share ** 0.5, share < 0.125, share < 0.4], axis=1).astype(np.float64)


def sample_chunks(text: bytes, max_chunks: int = MAX_CHUNKS) -> np.ndarray:
    """At most ``max_chunks`` chunks of two hops, spread over the whole text."""
    size = CHUNK
    spare = max(0, len(text) - size)
    n = min(max_chunks, 1 + -(-spare // HOP))
    out = np.zeros((n, size), np.uint8)
    for i in range(n):
        a = spare * i // max(1, n - 1) if n > 1 else 0
        part = np.frombuffer(text[a:a + size], np.uint8)
        out[i, :len(part)] = part
    return out


def train(chunks: list[np.ndarray], y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on the log loss over the chunks of each text; gradients pass to the
    bytes at each largest answer."""
    if len(chunks) == 0 or len(set(y.tolist())) < 2:
        prior = float(np.mean(y)) if len(chunks) else 0.5
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros((4 * FILTERS + FILLS, HIDDEN)),
                       np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, prior)
    rng = np.random.default_rng(seed)
    p = {"t": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
         "w1": rng.normal(0, 0.3, (4 * FILTERS + FILLS, HIDDEN)), "b1": np.zeros(HIDDEN),
         "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(1)}
    m = {k: np.zeros(v.shape) for k, v in p.items()}
    v2 = {k: np.zeros(v.shape) for k, v in p.items()}
    sizes = fill(np.array([CHUNK if len(c) > 1 else int(np.max(np.flatnonzero(c[0]), initial=-1)) + 1
                           for c in chunks]))
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    share = len(pos) / len(y)
    for step in range(1, steps + 1):
        # Both labels alike in a step; the weights restore their shares.
        pick = np.concatenate([rng.choice(pos, BATCH // 2), rng.choice(neg, BATCH // 2)])
        weight = np.where(y[pick] == 1, share, 1 - share) * 2 / BATCH
        own = [chunks[i] for i in pick]
        n = np.array([len(c) for c in own])
        first = np.cumsum(n) - n
        x = np.concatenate(own)
        reach = x.shape[1] - WIDTH + 1
        z = p["t"][0][x[:, :reach]]
        for j in range(1, WIDTH):
            z += p["t"][j][x[:, j:j + reach]]
        arg = z.argmax(axis=1)                                      # (chunks, filters)
        rows = np.arange(len(x))[:, None]
        a = np.tanh(z[rows, arg, np.arange(FILTERS)[None, :]])
        mean = np.add.reduceat(a, first, axis=0) / n[:, None]
        top, low = np.maximum.reduceat(a, first, axis=0), np.minimum.reduceat(a, first, axis=0)
        bare = 1 - sizes[pick][:, :1]
        feats = np.concatenate([mean, top, low, bare * mean, sizes[pick]], axis=1)
        h = np.tanh(feats @ p["w1"] + p["b1"])
        out = 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"][0], -30, 30)))
        d = (out - (0.01 + 0.98 * y[pick])) * weight      # labels softened by a hundredth
        g = {"w2": h.T @ d, "b2": np.array([d.sum()])}
        dh = d[:, None] * p["w2"][None, :] * (1 - h ** 2)
        g["w1"], g["b1"] = feats.T @ dh, dh.sum(axis=0)
        df = dh @ p["w1"].T
        text_of = np.repeat(np.arange(len(pick)), n)
        da = (df[:, :FILTERS] + bare * df[:, 3 * FILTERS:4 * FILTERS])[text_of] / n[text_of][:, None]
        da = da + df[:, FILTERS:2 * FILTERS][text_of] * (a >= top[text_of])
        da = da + df[:, 2 * FILTERS:3 * FILTERS][text_of] * (a <= low[text_of])
        dz = da * (1 - a ** 2)
        g["t"] = np.zeros(p["t"].shape)
        for j in range(WIDTH):
            np.add.at(g["t"][j], (x[rows, arg + j], np.arange(FILTERS)[None, :]), dz)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
            rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-8)
                    ).astype(p[k].dtype)
    return Network(p["t"], p["w1"], p["b1"], p["w2"], float(p["b2"][0]))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", max_rows: int = MAX_ROWS) -> Network:
    """A network from labelled rows (already restricted to those one may learn
    from): at most ``max_rows`` of each label, each cut to MAX_CHUNKS chunks on
    the executors, so the driver gets a bounded sample."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.col(label).cast("int").alias("y")).groupBy("key").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("key"))
    picked = F.broadcast(known.where("y = 1").orderBy(order, "key").limit(max_rows)
                         .unionByName(known.where("y = 0").orderBy(order, "key").limit(max_rows)))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")) \
        .join(picked, "key").select("key", "text", "y")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [sample_chunks(t.encode()).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary()), batch.column(2)],
                                             ["key", "part", "y"])

    kind = rows.schema["key"].dataType.simpleString()
    got = rows.mapInArrow(cut, f"key {kind}, part binary, y int").toArrow()
    got = got.sort_by([("key", "ascending"), ("part", "ascending")])
    return train([np.frombuffer(p, np.uint8).reshape(-1, CHUNK) for p in got.column("part").to_pylist()],
                 got.column("y").to_numpy().astype(float))


def score_quality(docs: DataFrame, net: Network, key: str | list[str | Column] = "doc_id",
                  text: str = "text") -> DataFrame:
    """Add the score to the ``key`` columns of every row."""
    keys = [key] if isinstance(key, str) else key
    given = docs.select(F.struct(*keys).alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scorer.score(batch.column(1)).astype(np.float64))], ["key", "score"])

    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(run, f"key {kind}, score double").select("key.*", "score")


def keep_good(docs: DataFrame, net: Network, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that score at least ``threshold``, with the columns they came with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in slices(batches, text):
            score = scorer.score(batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
