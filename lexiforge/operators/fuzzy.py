"""Batch fuzzy name lookup: best partial-ratio match per query (J-4, T-1).

Similarity (our stated definition): with ``s`` the shorter string and ``t``
the longer (``s`` = the query on equal length), the score is the best, over
windows ``W`` of ``t`` of length ``|s|`` (windows at the edges may be
shorter), of ``100 * 2 * LCS(s, W) / (|s| + |W|)``; 100 when ``s`` occurs in
``t``. Case-sensitive, no normalisation.

Execution, bound then verify: the query list (bounded by a count and by its
characters, larger lists go in slices) is sent to the tasks that hold the names.

1. Per query and batch of names, two bounds come from counts alone, in numpy. With
   ``m = |s|`` and ``c`` the characters (as a multiset) that ``s`` and ``t`` share,
   ``LCS <= c`` gives ``score <= 200 c / (m + c)``. With ``g`` the shared pairs of
   neighbouring characters, a deletion breaks at most two pairs of ``s`` and an insertion
   one, so ``LCS <= (g + m + 1 + |W|) / 3`` and, with ``w = min(m, (g + m + 1) / 2)``,
   ``score <= 200 w / (m + w)``. (Pairs are counted in 256 hashed slots: never too few.)
2. A first pass scores only the name with the best bound per query and task. The
   best of these over all tasks is the query's seed.
3. The second pass scores the names whose bound reaches the seed and the task's best
   so far, best bounds first: bit-parallel LCS over all windows of many pairs at a time
   in 64-bit words (strings ``s`` over 63 characters: one by one).

Each task emits one row per query; a partial aggregate keeps the best, ties to the
lowest key. No pair of the two tables is ever a row.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiforge.session import materialize, ship_by_value

#: Queries, and characters of queries, that ride to the tasks at once.
MAX_QUERIES = 100_000
MAX_QUERY_CHARS = 8_000_000


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel LCS length (Allison & Dix 1986; Hyyrö 2004)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def partial_ratio(q: str, name: str) -> float:
    """Score in [0, 100] per the module definition."""
    if len(q) <= len(name):
        s, t = q, name
    else:
        s, t = name, q
    m, n = len(s), len(t)
    if m == 0:
        return 0.0
    if s in t:
        return 100.0
    best = 0.0
    for i in range(-(m - 1), n):
        w = t[max(i, 0):min(i + m, n)]
        lw = len(w)
        # this window can score at most 200 * min(m, lw) / (m + lw)
        if 200.0 * min(m, lw) / (m + lw) <= best:
            continue
        r = 200.0 * lcs_length(s, w) / (m + lw)
        if r > best:
            best = r
            if best >= 100.0:
                break
    return best


PAIR_SLOTS = 256
#: 64-bit words that one step of the verification holds.
WORDS = 1 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lengths) of all texts, end to end."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4").astype(np.int64), np.array([len(t) for t in texts], np.int64)


def _counts(codes: np.ndarray, lengths: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters (by place in ``alphabet``; others do not count) and of
    hashed neighbour pairs, per text."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    known = alphabet[at] == codes
    chars = np.bincount(row[known] * len(alphabet) + at[known], minlength=len(lengths) * len(alphabet))
    slot = (codes[:-1] * 31 + codes[1:] * 17) % PAIR_SLOTS
    inside = row[:-1] == row[1:]
    pairs = np.bincount(row[:-1][inside] * PAIR_SLOTS + slot[inside], minlength=len(lengths) * PAIR_SLOTS)
    return (np.minimum(chars, 30_000).astype(np.int16).reshape(len(lengths), -1),
            np.minimum(pairs, 30_000).astype(np.int16).reshape(len(lengths), -1))


def upper_bounds(chars: np.ndarray, pairs: np.ndarray, lengths: np.ndarray, q_chars: np.ndarray, q_pairs: np.ndarray,
                 q_length: int, least: float) -> np.ndarray:
    """A bound of the score of one query with each name; where the character bound
    is below ``least``, pairs are not looked at."""
    m = np.minimum(lengths, q_length)
    c = np.minimum(np.minimum(chars, q_chars).sum(axis=1, dtype=np.int64), m)
    bound = np.where(m + c > 0, 200.0 * c / np.maximum(m + c, 1), 0.0)
    some = np.flatnonzero(bound >= least)
    g = np.minimum(pairs[some], q_pairs).sum(axis=1, dtype=np.int64)
    w = np.minimum(m[some], (g + m[some] + 1) / 2)
    # room for rounding: a bound is never below the score that it bounds
    bound[some] = np.minimum(bound[some], np.where(m[some] > 0, 200.0 * w / np.maximum(m[some] + w, 1), 0.0) + 1e-9)
    return bound


def partial_ratios(q: str, names: list[str]) -> np.ndarray:
    """``partial_ratio(q, name)`` of many names."""
    out = np.zeros(len(names))
    short = [k for k, t in enumerate(names) if 0 < min(len(q), len(t)) <= 63]
    for k in set(range(len(names))) - set(short):
        out[k] = partial_ratio(q, names[k])
    if not short:
        return out
    longest = max(max(len(names[k]) for k in short), len(q))
    step = max(1, WORDS // (2 * longest * min(63, longest)))
    for a in range(0, len(short), step):
        part = short[a:a + step]
        s = [q if len(q) <= len(names[k]) else names[k] for k in part]
        t = [names[k] if len(q) <= len(names[k]) else q for k in part]
        m, n = np.array([len(x) for x in s]), np.array([len(x) for x in t])
        sc, tc = np.full((len(part), m.max()), -1), np.full((len(part), n.max()), -2)
        for x, width, texts in ((sc, m, s), (tc, n, t)):
            x[np.arange(x.shape[1]) < width[:, None]] = _codes(texts)[0]
        bit = np.uint64(1) << np.arange(sc.shape[1], dtype=np.uint64)
        # per position of t, the places in s that hold its character
        masks = ((tc[:, :, None] == sc[:, None, :]) * bit).sum(axis=2, dtype=np.uint64)
        masks = np.concatenate([masks, np.zeros((len(part), 1), np.uint64)], axis=1)      # beyond t
        start = np.arange(m.max() + n.max() - 1) - (m[:, None] - 1)      # windows by pair
        full = (np.uint64(1) << m.astype(np.uint64)) - np.uint64(1)
        v = np.broadcast_to(full[:, None], start.shape).copy()
        for j in range(int(m.max())):
            at = start + j
            inside = (at >= 0) & (at < n[:, None]) & (j < m[:, None])
            u = v & np.take_along_axis(masks, np.where(inside, at, n.max()), axis=1)
            with np.errstate(over="ignore"):
                v = ((v + u) | (v - u)) & full[:, None]
        lcs = m[:, None] - np.bitwise_count(v).astype(np.int64)
        width = np.minimum(start + m[:, None], n[:, None]) - np.maximum(start, 0)
        score = np.where(start < n[:, None], 200.0 * lcs / (m[:, None] + np.maximum(width, 1)), 0.0)
        out[part] = score.max(axis=1)
    return out


def _match_fn(queries: list[tuple], seeds: list[float] | None, key_type, query_type):
    """Task body. Without seeds: per query the score of the name with the best bound.
    With them: the best match, and how many names were seen and scored."""
    texts = [t for _, t in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, q_lengths = _codes(texts)
        alphabet = np.unique(codes)
        q_chars, q_pairs = _counts(codes, q_lengths, alphabet)
        best: list[tuple | None] = [None] * len(queries)
        seen, scored = 0, np.zeros(len(queries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                keys = batch.column(0).slice(at, 4096).to_pylist()
                names = batch.column(1).slice(at, 4096).to_pylist()
                seen += len(names)
                chars, pairs = _counts(*(n := _codes(names)), alphabet)
                for j, q in enumerate(texts):
                    now = best[j][0] if best[j] is not None else -1.0
                    least = now if seeds is None else max(now, seeds[j])
                    bound = upper_bounds(chars, pairs, n[1], q_chars[j], q_pairs[j], int(q_lengths[j]), least)
                    if seeds is None:
                        order = np.argmax(bound, keepdims=True)
                    else:
                        order = np.flatnonzero(bound >= least)
                        order = order[np.argsort(-bound[order], kind="stable")]
                    for a in range(0, len(order), 64):
                        part = order[a:a + 64]
                        part = part[bound[part] >= least]
                        if not len(part):
                            break
                        got = partial_ratios(q, [names[k] for k in part.tolist()])
                        scored[j] += len(part)
                        top = got.max()
                        k = min((keys[x], names[x]) for x in part[got == top].tolist())
                        if best[j] is None or (top, ) > best[j][:1] or (top == best[j][0] and k < best[j][1:]):
                            best[j] = (float(top), *k)
                        least = max(least, best[j][0])
        if seen:
            rows = [b if b is not None else (None, None, None) for b in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in queries], query_type), pa.array([r[1] for r in rows], key_type),
                 pa.array([r[2] for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.float64()),
                 pa.array([seen] * len(rows), pa.int64()), pa.array(scored)],
                ["query_id", "match_key", "match_name", "score", "n_names", "n_scored"])
    return run


def fuzzy_best_match(names: DataFrame, queries: DataFrame, key: str = "uuid",
                     name: str = "name", query_id: str = "query_id",
                     text: str = "text", report: bool = False) -> DataFrame:
    """(query_id, match_key, match_name, score): the best name per non-empty
    query; equal scores go to the lowest key. ``report`` adds how many names were
    compared by bounds (n_names) and scored (n_scored)."""
    spark = names.sparkSession
    kt, qt = names.schema[key].dataType, queries.schema[query_id].dataType
    schema = (f"query_id {qt.simpleString()}, match_key {kt.simpleString()}, match_name string, score double, "
              "n_names long, n_scored long")
    queries = queries.where(F.length(F.col(text)) > 0).select(query_id, text).distinct()
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars")).first()
    # Score each distinct name once, carrying its lowest key: exact, since a
    # tie between names resolves to the lowest key over all of them. The
    # min-per-name aggregate is partial, so a hot name costs nothing extra.
    distinct = materialize(names.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias(key)).select(key, name),
                           "fuzzy-names")
    # Exact for any batch size: slices by a hash of the whole row, so a repeated
    # id splits too, each within the bounds of what rides to the tasks.
    slices = max(-(-size["n"] // MAX_QUERIES), -(-(size["chars"] or 0) // MAX_QUERY_CHARS))
    slices = slices if slices <= 1 else 2 * slices
    local = spark.createDataFrame([], schema)
    for i in range(slices):
        part = queries if slices == 1 else queries.where(
            F.pmod(F.xxhash64(query_id, text), F.lit(slices)) == i)
        qrows = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: r[1])
        if not qrows:
            continue
        kinds = to_arrow_type(kt), to_arrow_type(qt)
        first = distinct.mapInArrow(_match_fn([(n, t) for n, (_, t) in enumerate(qrows)], None, kinds[0], pa.int32()),
                                    schema.replace(f"query_id {qt.simpleString()}", "query_id int", 1))
        found = {r["query_id"]: r["s"] for r in first.groupBy("query_id").agg(F.max("score").alias("s")).collect()}
        seeds = [found.get(n) if found.get(n) is not None else -1.0 for n in range(len(qrows))]
        local = local.unionByName(distinct.mapInArrow(_match_fn(qrows, seeds, *kinds), schema))
    best = local.groupBy("query_id").agg(
        F.min_by(F.struct("match_key", "match_name", "score"),
                 F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("match_key").alias("k")))).alias("b"),
        F.sum("n_names").alias("n_names"), F.sum("n_scored").alias("n_scored")).where("b IS NOT NULL")
    return best.select("query_id", "b.match_key", "b.match_name", F.round("b.score", 6).alias("score"),
                       *(["n_names", "n_scored"] if report else []))


# Worker-side functions above travel by value (see ``ship_by_value``).
ship_by_value(__name__)
