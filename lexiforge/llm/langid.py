"""Language identification by bit-sliced Bloom filters of byte n-grams.

Learning counts the four-byte grams of each language (lower-cased text) over all
learning rows. Every counted gram goes into the filter of every language that has it.
Slot by slot, one table holds a bit per language, so a look-up of a gram's
hashes and one AND give all languages that (seem to) contain it. A second table of the same
form holds the grams that mark a language: those with a rate of at least ``MIN_RATE``
that is at least half of the gram's highest rate. Per-language counts over a text are
corrected for each filter's false positives; the sum of both tables' counts
decides, its share of all is the score.

The tables are built in Spark and packed by ranges of slots. They have slots for the
language with most grams, whatever the number of languages, and at most ``MAX_BYTES``:
beyond that filters get fuller and false positives, which are corrected, more; no gram is left out.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if
nothing was learned; a text none of whose grams is known gets the language
with most learning rows at score 0; equal counts go to the language first by
name; repeated rows are each judged; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import mix64, slices, text_bytes
from lexiforge.session import materialize

MIN_RATE = 2e-5
GRAM = 4
MAX_BYTES = 128 << 20      # of both tables
RANGE = 1 << 16            # slots that are packed together


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))


def _grams(buf: np.ndarray) -> np.ndarray:
    """The gram that starts at each byte (the last three have none)."""
    if len(buf) < GRAM:
        return np.zeros(0, np.uint32)
    b = buf.astype(np.uint32)
    return (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows; counted inside each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def reduced(parts):
            g = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            order = np.argsort(g, kind="stable")
            g, n = g[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            return g[first], np.add.reduceat(n, first)

        def out():
            for name, parts in held.items():
                g, n = reduced(parts)
                for i in range(0, len(g), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(g[i:i + 100_000])), pa.array(g[i:i + 100_000].astype(np.int64)),
                         pa.array(n[i:i + 100_000].astype(np.int64))], ["lang", "gram", "n"])

        for batch in slices(batches):
            buf, offsets = _lowered(batch.column(0))
            grams = _grams(buf)
            names = batch.column(1).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(codes, np.diff(offsets))[:len(grams)]
            valid = np.ones(len(buf), bool)
            for k in range(1, GRAM):
                at = offsets[1:] - k
                valid[at[at >= 0]] = False
            valid = valid[:len(grams)]
            for i, name in enumerate(names.dictionary.to_pylist()):
                own = np.sort(grams[(row == i) & valid])
                if len(own):
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    n = np.diff(np.concatenate([first, [len(own)]]))
                    parts = held.setdefault(name, [])
                    parts.append((own[first], n))
                    size += len(first)
                    if len(parts) > 16:
                        held[name] = [reduced(parts)]
            if size > 40_000_000:       # a bounded table per task; sums go on afterwards
                yield from out()
                held, size = {}, 0
        yield from out()

    return (docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
            .mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class LanguageFilters:
    """Bit l of slot s: some gram of language l hashes to s. Table 0 holds all grams,
    table 1 those that mark a language."""
    languages: list[str]
    slots: np.ndarray          # (tables, words of 64 languages, slots), uint64 or the least type that fits
    false_rate: np.ndarray     # (tables, languages)
    most_rows: int
    hashes: int

    def masks(self, grams: np.ndarray, word: int) -> list[np.ndarray]:
        """Of each table, the languages that hold each gram."""
        h = mix64(grams.astype(np.uint64), 11)
        at = [slots_at(h, k, self.hashes, self.slots.shape[2]) for k in range(self.hashes)]
        out = []
        for table in self.slots[:, word]:
            mask = table[at[0]]
            for places in at[1:]:
                mask = mask & table[places]
            out.append(mask)
        return out


def slots_at(h: np.ndarray, k: int, hashes: int, size: int) -> np.ndarray:
    """The slot of the ``k``-th hash, one of ``size`` (a power of two)."""
    return ((h >> np.uint64(64 // hashes * k)) & np.uint64(size - 1)).astype(np.int64)


def filter_slots(members: DataFrame, names: list[str], size: int, hashes: int) -> DataFrame:
    """(level, word, slot, bits) of every slot with a bit, from (level, lang, gram)."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = pa.array(names, pa.string())
        for batch in batches:
            level = batch.column(0).to_numpy()
            lang = pc.index_in(batch.column(1), order).to_numpy(zero_copy_only=False).astype(np.int64)
            h = mix64(batch.column(2).to_numpy().astype(np.uint64), 11)
            bits = (np.uint64(1) << (lang % 64).astype(np.uint64)).astype(np.int64)
            for k in range(hashes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(level), pa.array(lang // 64), pa.array(slots_at(h, k, hashes, size)), pa.array(bits)],
                    ["level", "word", "slot", "bits"])

    return (members.select("level", "lang", "gram").mapInArrow(place, "level int, word long, slot long, bits long")
            .groupBy("level", "word", "slot").agg(F.bit_or("bits").alias("bits")))


def build_filters(members: DataFrame, rows: dict[str, int], hashes: int = 2, slots_per_gram: int = 12,
                  max_bytes: int = MAX_BYTES) -> LanguageFilters:
    """Filters from (level, lang, gram), each row once, and the rows of each language."""
    names = sorted(rows)
    words = max(1, -(-len(names) // 64))
    kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 10 ** 9)) if len(names) <= n)
    width = np.dtype(kind).itemsize
    largest = members.groupBy("level", "lang").count().agg(F.max("count")).first()[0] or 1
    size = max(1 << 10, 1 << int(np.ceil(np.log2(largest * slots_per_gram))))
    while size > 1 << 10 and (size * words * width * 2 > max_bytes or size > 1 << (64 // hashes)):
        size >>= 1

    def pack(group: pa.Table) -> pa.Table:
        block = np.zeros(min(RANGE, size), kind)
        block[group.column("slot").to_numpy() % RANGE] = group.column("bits").to_numpy().view(np.uint64).astype(kind)
        return pa.table({"level": group.column("level")[:1], "word": group.column("word")[:1],
                         "part": group.column("part")[:1], "block": pa.array([block.tobytes()], pa.binary())})

    packed = (filter_slots(members, names, size, hashes).withColumn("part", F.floor(F.col("slot") / RANGE))
              .groupBy("level", "word", "part")
              .applyInArrow(pack, "level int, word long, part long, block binary"))
    slots = np.zeros((2, words, size), kind)
    for r in packed.toArrow().to_pylist():             # at most max_bytes
        block = np.frombuffer(r["block"], kind)
        slots[r["level"], r["word"], r["part"] * RANGE:r["part"] * RANGE + len(block)] = block
    false_rate = np.array([[((slots[t, i // 64] >> kind(i % 64)) & kind(1)).mean() ** hashes
                            for i in range(len(names))] for t in range(2)])
    most = max(range(len(names)), key=lambda i: (rows[names[i]], -i)) if names else -1
    return LanguageFilters(names, slots, false_rate, most, hashes)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", min_rate: float = MIN_RATE) -> LanguageFilters:
    """Filters from all rows with a language."""
    known = docs.where(F.col(f"`{lang}`").isNotNull())
    counts = materialize(gram_counts(known, text, lang), "langid-grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rows = {r["lang"]: r["n"] for r in known.groupBy(F.col(f"`{lang}`").alias("lang"))
            .agg(F.count("*").alias("n")).collect()}
    none = F.lit(None).cast("double")
    total = F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]) if totals else None
    rated = counts.withColumn("rate", F.col("n") / total[F.col("lang")] if totals else none)
    by_gram = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    held = by_gram.select("gram", "best", F.explode("all").alias("x"))      # at most one a language
    marks = (F.col("x.rate") >= 0.5 * F.col("best")) & (F.col("x.rate") >= min_rate)
    members = held.select(F.explode(F.when(marks, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("level"),
                          F.col("x.lang").alias("lang"), "gram")
    return build_filters(materialize(members, "langid-members"), rows)


def identify_texts(column: pa.Array, f: LanguageFilters) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    n = len(column)
    letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
    if not f.languages:
        return ["und"] * n, [0.0] * n
    buf, offsets = _lowered(column)
    grams = _grams(buf)
    valid = np.ones(len(buf), bool)
    for k in range(1, GRAM):
        at = offsets[1:] - k
        valid[at[at >= 0]] = False
    sizes = np.maximum(np.diff(offsets) - (GRAM - 1), 0)
    ends = np.minimum(offsets, len(grams))
    hits = np.zeros((2, n, len(f.languages)))
    for word in range(f.slots.shape[1]):
        for t, masks in enumerate(f.masks(grams, word)):
            masks[~valid[:len(grams)]] = 0
            for i in range(word * 64, min(len(f.languages), word * 64 + 64)):
                sums = np.zeros(len(grams) + 1, np.int64)
                np.cumsum((masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1), out=sums[1:])
                hits[t, :, i] = sums[ends[1:]] - sums[ends[:-1]]
    wrong = f.false_rate[:, None, :]
    true = np.maximum(0.0, (hits - sizes[None, :, None] * wrong) / np.maximum(1e-9, 1 - wrong))
    true = true.sum(axis=0)
    best = np.argmax(true, axis=1)
    all_ = true.sum(axis=1)
    score = np.where(all_ > 0, true[np.arange(n), best] / np.maximum(all_, 1e-12), 0.0)
    best = np.where(all_ > 0, best, f.most_rows)
    return ([f.languages[b] if ok else "und" for b, ok in zip(best, letters)],
            [float(min(1.0, s)) if ok else 0.0 for s, ok in zip(score, letters)])


def identify(docs: DataFrame, filters: LanguageFilters, key: str | list[str | Column] = "doc_id",
             text: str = "text") -> DataFrame:
    """Add lang_pred and score to the ``key`` columns of every row."""
    spark = docs.sparkSession
    keys = [key] if isinstance(key, str) else key
    given = docs.select(F.struct(*keys).alias("key"), F.col(f"`{text}`").alias("text"))
    parts = (filters.languages, filters.slots, filters.false_rate, filters.most_rows, filters.hashes)
    shared = spark.sparkContext.broadcast(parts)     # plain values; at most MAX_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = LanguageFilters(*shared.value)
        for batch in slices(batches):
            lang, score = identify_texts(batch.column(1), f)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(run, f"key {kind}, lang_pred string, score double").select(
        "key.*", "lang_pred", "score")
