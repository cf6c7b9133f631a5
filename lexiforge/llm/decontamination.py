"""Benchmark decontamination: passages within a small edit distance of an item.

Texts and items are words (A-Z lower-cased, ASCII marks dropped). In scripts
without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) every character is a
word, and East Asian marks are dropped. An item of n words may differ by
k = ``max_rate`` * n word edits, one of fewer than ``min_words`` words by none.

A window as long as the item (down to its length class) is embedded by the CGK
random walk: at step t it writes the word it stands on, and moves on by a word if
a random bit of (t, word) says so. Walks over windows some edits apart part at an
edit and meet again soon, so edit distance becomes Hamming distance of the strings.

Locality-sensitive hashing samples ``SAMPLES`` places of these strings, again and
again with new walks. In each repetition every item's walk starts at a position drawn
evenly from one half of the item, whatever its words and the other items are;
every second repetition walks backwards from the other half. A window is dropped at the
first sampled place at which no item agrees with all places so far. The number of
repetitions is measured, not assumed: for each length class they are added until the
very search finds ``recall`` of ``PAIRS`` random items that hold the limit's edits.
Exact copies agree everywhere and are found always.

Windows that agree in all sampled places and hold at least n - k words of the item
are verified: the least word edit distance between the whole item and any
stretch of the text around the window must be within the limit.

The item tables are sent to all tasks, in blocks of at most ``MAX_ITEMS`` distinct
items and about ``MAX_ITEM_BYTES`` of item texts (at least one item; one pass over the
texts each). Nothing is shuffled but the items, and no pair of text and item is formed unless
their samples agree.

Defined results: null or empty texts and items (or items of marks alone) match
nothing; items with fewer than ``min_words`` words match whole words exactly, those with
fewer than ``least_words`` are left out; items of equal words are one, under the least id;
a text that holds an item several times is reported once, at the least distance found and
then first word; repeated rows are each judged; an empty table gives an empty
result; ``remove_contaminated`` returns rows with all their columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from lexiforge.llm.common import mix64, slices, span_hashes, text_bytes, word_spans
from lexiforge.session import materialize

MAX_RATE, MIN_WORDS, SAMPLES, RECALL = 0.2, 5, 4, 0.995
MAX_ITEMS, MAX_ITEM_BYTES = 20_000, 16 << 20
PAIRS = 500              # random items by which repetitions are measured
REPETITIONS = 100         # beyond these, fewer places are sampled
TRIES = 8                 # starts that are drawn for an item and repetition
SLICE = 1 << 20
FLAGS = 1 << 22
CHUNK = 1 << 20           # words of the windows that are counted at once

#: Characters that are words of their own, and marks that part words.
ALONE = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x3005, 0x3007), (0x3021, 0x302F),
         (0x3031, 0x30FA), (0x30FC, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
         (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
MARKS = ((0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFE30, 0xFE4F), (0xFF01, 0xFF0F),
         (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _within(points: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    k = np.searchsorted([a for a, _ in ranges], points, side="right") - 1
    return (k >= 0) & (points <= np.array([b for _, b in ranges])[k])


def cut_characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (UTF-8) with spaces around the characters of ``ALONE`` and in place of ``MARKS``."""
    points, starts, sizes = [], [], []
    for size, least, most in ((3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
        at = np.flatnonzero((buf >= least) & (buf <= most))
        at = at[at + size <= len(buf)]
        point = buf[at].astype(np.int64) & (0xF if size == 3 else 0x7)
        for i in range(1, size):
            point = point << 6 | (buf[at + i] & 0x3F)
        points.append(point)
        starts.append(at)
        sizes.append(np.full(len(at), size))
    points, starts, sizes = np.concatenate(points), np.concatenate(starts), np.concatenate(sizes)
    marks = _within(points, MARKS)
    if marks.any():
        buf = buf.copy()
        for i in range(3):
            buf[starts[marks] + i] = 32
    alone = _within(points, ALONE)
    if not alone.any():
        return buf, offsets
    cuts = np.sort(np.concatenate([starts[alone], (starts + sizes)[alone]]))
    return np.insert(buf, cuts, 32), offsets + np.searchsorted(cuts, offsets)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (never 0) of all rows, the first word of each row (rows + 1), and
    the words' lengths."""
    buf, offsets = text_bytes(pc.fill_null(column, ""))
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for c in range(128):
        if not chr(c).isalnum():
            lower[c] = 32
    buf, offsets = cut_characters(lower[buf], offsets)
    starts, ends, row = word_spans(buf, offsets)
    h = span_hashes(buf, starts, ends)
    h[h == 0] = 1
    return h, np.searchsorted(row, np.arange(len(offsets))), ends - starts


@dataclass
class Repetition:
    """The sampled walks of all items of a length class: their keys (sorted), items
    and start positions, and per sampled place which keys up to it some item has."""
    seed: int
    backward: bool
    places: tuple[int, ...]
    keys: np.ndarray
    items: np.ndarray
    starts: np.ndarray         # from the item's last word if backward
    flags: list[np.ndarray]
    firsts: np.ndarray         # the words that the walks start from


def allowed(n: int, max_rate: float = MAX_RATE, min_words: int = MIN_WORDS) -> int:
    """Word edits by which a passage may differ from an item of ``n`` words."""
    return int(max_rate * n) if n >= min_words else 0


def window_of(n: int) -> int:
    """Items of a length class share the window of its shortest length."""
    return n if n < 8 else 1 << (n.bit_length() - 1)


def draw_places(window: int, seed: int, samples: int = SAMPLES) -> tuple[int, ...]:
    """Sampled places of the walk over a window, the first word always among them;
    all scales are drawn alike, as agreement falls with the edits on the way."""
    rng = np.random.default_rng([seed, window])
    places = {0}
    while len(places) < min(samples, window):
        places.add(int(window ** rng.random()))
    return tuple(sorted(places))


def _move(words: np.ndarray, pos: np.ndarray, seed: int, start: int, stop: int) -> np.ndarray:
    """Positions after the steps from ``start`` to ``stop``; a walk rests on a 0."""
    bits = mix64(np.arange(start, stop, dtype=np.uint64), 1000 + seed) | np.uint64(1)
    with np.errstate(over="ignore"):
        for b in bits:
            pos = pos + ((words[pos] * b) >> np.uint64(63)).astype(np.int64)
    return pos


def _extend(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(key * np.uint64(0x9E3779B97F4A7C15) + symbol, 5)


def _low(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys & np.uint64(size - 1)).astype(np.int64)


def _flags_of(keys: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << max(14, (8 * len(keys)).bit_length()), bool)
    flags[_low(keys, len(flags))] = True
    return flags


def sample_items(items: list[np.ndarray], own: np.ndarray, window: int, seed: int,
                 samples: int = SAMPLES) -> Repetition:
    """Repetition ``seed`` over the items numbered ``own``, all of one length class."""
    backward, places = seed % 2 == 1, draw_places(window, seed, samples)
    n = np.array([len(items[i]) for i in own])
    rest = np.zeros(1, np.uint64)
    flat = np.concatenate([part for i in own for part in (items[i][::-1] if backward else items[i], rest)])
    begin = np.cumsum(n + 1) - (n + 1)
    rng = np.random.default_rng([seed, window, 1])
    wanted = min(len(places), 4, window)
    best, starts = np.full(len(own), -1), np.zeros(len(own), np.int64)
    for _ in range(TRIES):     # walks that rest, or leave the item, say little: draw again
        todo = np.flatnonzero(best < wanted)
        if not len(todo):
            break
        start = (rng.random(len(todo)) * ((n[todo] + 1) // 2)).astype(np.int64)
        pos, at, seen = begin[todo] + start, 0, np.ones(len(todo), np.int64)
        for t in places[1:]:
            new = _move(flat, pos, seed, at, t)
            seen += new > pos
            pos, at = new, t
        seen[flat[pos] == 0] = 0
        better = seen > best[todo]
        best[todo[better]], starts[todo[better]] = seen[better], start[better]
    pos, at = begin + starts, 0
    key = flat[pos]
    firsts, flags = np.unique(key), [_flags_of(key)]
    for t in places[1:]:
        pos, at = _move(flat, pos, seed, at, t), t
        key = _extend(key, flat[pos])
        flags.append(_flags_of(key))
    order = np.argsort(key, kind="stable")
    return Repetition(seed, backward, places, key[order], own[order], starts[order], flags, firsts)


@lru_cache(maxsize=256)
def measured_repetitions(window: int, edits: bool, max_rate: float, min_words: int, recall: float) -> tuple[int, int]:
    """(repetitions, sampled places) with which ``candidates`` finds ``recall`` of random
    items of the class in texts that hold them with the limit's edits (substituted,
    dropped and added words). Fewer places are sampled where edits are so many that
    ``REPETITIONS`` do not do."""
    if not edits:
        return 1, SAMPLES
    rng = np.random.default_rng([window, 2])

    def fresh(size: int) -> np.ndarray:
        return rng.integers(1, 2 ** 63, size).astype(np.uint64)

    items, texts = [], []
    for _ in range(PAIRS):
        x = fresh(window if window < 8 else int(rng.integers(window, 2 * window)))
        y = [[w] for w in x]
        for p in rng.choice(len(x), allowed(len(x), max_rate, min_words), replace=False):
            y[p] = ([], list(fresh(1)), [x[p], *fresh(1)])[rng.integers(3)]
        items.append(x)
        texts.append(np.concatenate([fresh(3), np.array([w for z in y for w in z], np.uint64), fresh(3)]))
    words, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    lengths = np.array([len(x) for x in items])
    for samples in range(SAMPLES, 0, -1):
        found: set[int] = set()
        for r in range(REPETITIONS if samples > 1 else 100 * REPETITIONS):
            table = sample_items(items, np.arange(PAIRS), window, r, samples)
            found.update(row for row, item, _ in windows_of(words, first, [table], lengths).tolist() if row == item)
            if r % 2 and len(found) >= recall * PAIRS:
                return r + 1, samples
    raise ValueError(f"no number of repetitions reaches recall {recall} at max_rate {max_rate}")


def build_tables(items: list[np.ndarray], repetitions: int | None = None, max_rate: float = MAX_RATE,
                 min_words: int = MIN_WORDS, recall: float = RECALL) -> list[Repetition]:
    """The sampled walks of all items; ``repetitions`` of each class in place of the
    measured number if given."""
    if not 0 <= max_rate < 1:
        raise ValueError(f"max_rate {max_rate} is not in [0, 1)")
    out = []
    windows = np.array([window_of(len(x)) for x in items], np.int64)
    edits = np.array([allowed(len(x), max_rate, min_words) > 0 for x in items], bool)
    for w, e in sorted(set(zip(windows.tolist(), edits.tolist()))):
        own = np.flatnonzero((windows == w) & (edits == e))
        measured, samples = measured_repetitions(w, e, max_rate, min_words, recall)
        out += [sample_items(items, own, w, r, samples) for r in range(repetitions or measured)]
    return out


def first_flags(tables: list[Repetition]) -> np.ndarray:
    """Which words (by their low bits) some walk of an item starts from."""
    flags = np.zeros(FLAGS, bool)
    for rep in tables:
        flags[_low(rep.firsts, FLAGS)] = True
    return flags


def windows_of(words: np.ndarray, first: np.ndarray, tables: list[Repetition], lengths: np.ndarray,
               flags: np.ndarray | None = None, keep=None) -> np.ndarray:
    """Distinct (row, item, first word of the window within the row) whose samples
    agree with an item's; ``keep`` passes over runs of them first."""
    n, sizes = len(first) - 1, np.diff(first)
    padded = np.zeros(len(words) + n + 1, np.uint64)       # a rest around each text
    padded[1 + np.arange(len(words)) + np.repeat(np.arange(n), sizes)] = words
    row_of = np.repeat(np.arange(n), sizes + 1)            # of the place after each rest
    begin = 1 + first[:-1] + np.arange(n)
    some = padded != 0
    if flags is not None:
        some &= flags[_low(padded, FLAGS)]
    some = np.flatnonzero(some)
    last, back, said = len(padded) - 1, padded[::-1], padded[some]
    out = [np.zeros((0, 3), np.int64)]
    for rep in tables:
        on = rep.flags[0][_low(said, len(rep.flags[0]))]
        s, start, key = back if rep.backward else padded, some[on], said[on]
        if rep.backward:
            start = last - start
        pos, at = start, 0
        for t, agrees in zip(rep.places[1:], rep.flags[1:]):
            pos, at = _move(s, pos, rep.seed, at, t), t
            key = _extend(key, s[pos])
            on = agrees[_low(key, len(agrees))]
            start, pos, key = start[on], pos[on], key[on]
        lo, hi = (np.searchsorted(rep.keys, key, side) for side in ("left", "right"))
        start, lo, count = start[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        for run in _runs(count, CHUNK // 16):
            which, k = _spread(count[run])
            k += lo[run][which]
            item, where = rep.items[k], start[run][which]
            if rep.backward:       # starts count from the item's last word
                where = last - where
            row = row_of[where - 1]
            before = lengths[item] - 1 - rep.starts[k] if rep.backward else rep.starts[k]
            found = np.unique(np.column_stack([row, item, where - begin[row] - before]), axis=0)
            out.append(found if keep is None else found[keep(found)])
    return np.unique(np.concatenate(out), axis=0)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, number within it) of all of ``counts`` repeated."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _runs(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of ``counts`` that add up to about ``most`` (at least one each)."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield slice(start, end)
        start = end


class Held:
    """Which words each item holds, by bits of a hash of both (some say yes wrongly)."""

    def __init__(self, items: list[np.ndarray]):
        size = sum(len(x) for x in items)
        self.bits = np.uint64(1 << max(16, (8 * size).bit_length()))
        self.flags = np.zeros(int(self.bits), bool)
        owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
        self.flags[self._at(np.concatenate(items), owner)] = True

    def _at(self, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mix64(words + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 11)
        return (h & (self.bits - np.uint64(1))).astype(np.int64)

    def __call__(self, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self.flags[self._at(words, owner)]


def candidates(words: np.ndarray, first: np.ndarray, tables: list[Repetition], flags: np.ndarray,
               lengths: np.ndarray, most: np.ndarray, held: Held) -> list[tuple[int, int, int]]:
    """Sorted (row, item, first word of the window within the row) of the windows whose
    samples agree with an item's and that hold enough of its words."""
    found = windows_of(words, first, tables, lengths, flags,
                       lambda some: enough(some, words, first, lengths, most, held))
    return [tuple(r) for r in found.tolist()]


def enough(found: np.ndarray, words: np.ndarray, first: np.ndarray, lengths: np.ndarray, most: np.ndarray,
           held: Held) -> np.ndarray:
    """Which windows hold as many words of the item as a match leaves unedited."""
    row, item, where = found.T
    begin = np.maximum(first[row], first[row] + where - most[item])
    end = np.minimum(first[row + 1], first[row] + where + lengths[item] + most[item])
    good = np.zeros(len(found), bool)
    for run in _runs(end - begin, CHUNK):
        which, k = _spread((end - begin)[run])
        own = held(words[begin[run][which] + k], item[run][which])
        good[run] = np.bincount(which[own], minlength=len(begin[run])) >= (lengths - most)[item[run]]
    return good


def infix_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance between ``item`` and any stretch of ``text``."""
    column = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (text != x), row[1:] + 1)
        row = np.minimum.accumulate(best - column) + column
    return int(row.min())


def infix_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """``infix_distance`` and the first word of the first stretch that has it."""
    unit = len(text) + 1                      # a cell is distance * unit + first word
    column = np.arange(unit) * unit
    row = np.arange(unit)
    for i, x in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i * unit
        best[1:] = np.minimum(row[:-1] + (text != x) * unit, row[1:] + unit)
        row = np.minimum.accumulate(best - column) + column
    return divmod(int(row.min()), unit)


def matches(column: pa.Array, items: list[np.ndarray], tables: list[Repetition], flags: np.ndarray,
            max_rate: float, held: Held | None = None,
            min_words: int = MIN_WORDS) -> dict[tuple[int, int], tuple[int, int]]:
    """(row, item) -> (distance, first word) of the verified matches. ``tables`` are
    those of ``max_rate`` and ``min_words``."""
    words, first, _ = words_of(column)
    if not len(words):
        return {}
    lengths = np.array([len(x) for x in items])
    limit = np.array([allowed(n, max_rate, min_words) for n in lengths.tolist()])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for r, item, where in candidates(words, first, tables, flags, lengths, limit, held or Held(items)):
        known = best.get((r, item))
        if known is not None and known[0] == 0:
            continue
        x, most = items[item], int(limit[item])
        text = words[first[r]:first[r + 1]]
        if where >= 0 and np.array_equal(text[where:where + len(x)], x):
            d, a = 0, where
        else:
            a = max(0, where - most)
            d, start = infix_place(x, text[a:max(0, where + len(x) + most)])
            a += start
        if d <= most and (known is None or (d, a) < known):
            best[(r, item)] = (d, a)
    return best


def distinct_items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, digest, bytes): one row per sequence of words, under the least id."""
    kind = benchmark.schema[key].dataType.simpleString()
    rows = benchmark.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=SLICE):
            words, first, _ = words_of(batch.column(1))
            sums = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.binary())], ["id", "text", "digest"])

    return (rows.mapInArrow(digest, f"id {kind}, text string, digest binary").where("digest IS NOT NULL")
            .groupBy("digest").agg(F.min("id").alias("id"), F.min("text").alias("text"))
            .withColumn("bytes", F.octet_length("text")))


def item_blocks(benchmark: DataFrame, key: str, text: str, least_words: int = 1, max_items: int = MAX_ITEMS,
                max_bytes: int = MAX_ITEM_BYTES) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Blocks of (ids, words) of the distinct items of ``least_words`` words or more, at
    most about ``max_items`` items and ``max_bytes`` each."""
    distinct = materialize(distinct_items(benchmark, key, text), "decontamination-items")
    total = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-total["n"] // max_items), -(-total["bytes"] // max_bytes))
    for b in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == b).select("id", "text")
        rows = sorted(((r["id"], r["text"]) for r in part.collect()),
                      key=lambda r: (r[0] is not None, r[0], r[1]) if r[0] is not None else (False, 0, r[1]))
        words, first, _ = words_of(pa.array([t for _, t in rows], pa.string()))
        kept = [i for i in range(len(rows)) if first[i + 1] - first[i] >= max(1, least_words)]
        if kept:
            yield [rows[i][0] for i in kept], [words[first[i]:first[i + 1]] for i in kept]


def _shared(docs: DataFrame, items, max_rate: float, min_words: int, repetitions: int | None):
    """Sent to all tasks: a block's items and their tables, as plain values."""
    tables = [tuple(vars(t).values()) for t in build_tables(items, repetitions, max_rate, min_words)]
    return docs.sparkSession.sparkContext.broadcast((items, tables))


def _opened(shared) -> tuple[list[np.ndarray], list[Repetition], np.ndarray, Held]:
    items, raw = shared.value
    tables = [Repetition(*t) for t in raw]
    return items, tables, first_flags(tables), Held(items)


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                       item_key: str = "item_id", item_text: str = "text", max_rate: float = MAX_RATE,
                       min_words: int = MIN_WORDS, repetitions: int | None = None,
                       least_words: int = 1) -> DataFrame:
    """(key, item_id, n_words, distance, first_word): one row per text and item that
    it holds. ``repetitions`` takes the place of the measured number."""
    kind = docs.schema[key].dataType.simpleString()
    item_type = benchmark.schema[item_key].dataType
    schema = f"{key} {kind}, {item_key} {item_type.simpleString()}, n_words long, distance long, first_word long"
    id_type = to_arrow_type(item_type)
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    result = docs.sparkSession.createDataFrame([], schema)
    for ids, items in item_blocks(benchmark, item_key, item_text, least_words):
        shared = _shared(docs, items, max_rate, min_words, repetitions)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, ids=ids) -> Iterator[pa.RecordBatch]:
            own, tables, flags, held = _opened(shared)
            for batch in slices(batches, max_bytes=SLICE):
                found = sorted(matches(batch.column(1), own, tables, flags, max_rate, held, min_words).items())
                if found:
                    rows = pa.array([r for (r, _), _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), pa.array([ids[i] for (_, i), _ in found], id_type),
                         pa.array([len(own[i]) for (_, i), _ in found], pa.int64()),
                         pa.array([d for _, (d, _) in found], pa.int64()),
                         pa.array([a for _, (_, a) in found], pa.int64())],
                        [key, item_key, "n_words", "distance", "first_word"])

        result = result.unionByName(d.mapInArrow(run, schema))
    return result


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
                        item_text: str = "text", max_rate: float = MAX_RATE, min_words: int = MIN_WORDS,
                        repetitions: int | None = None, least_words: int = 1) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    names = docs.columns
    out = docs
    for _, items in item_blocks(benchmark, item_key, item_text, least_words):
        shared = _shared(docs, items, max_rate, min_words, repetitions)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, tables, flags, held = _opened(shared)
            for batch in slices(batches, text, SLICE):
                column = batch.column(batch.schema.get_field_index(text))
                leaks = {r for r, _ in matches(column, own, tables, flags, max_rate, held, min_words)}
                yield batch.filter(pa.array([r not in leaks for r in range(batch.num_rows)]))

        out = out.mapInArrow(run, docs.schema)
    return out.select(*[F.col(f"`{c}`") for c in names])
