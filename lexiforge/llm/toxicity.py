"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents that stand for plain letters, maps
homoglyphs (Cyrillic, Greek, full-width) and digit or sign substitutions to
the letters they imitate, drops marks that split a word (``i.d.i.o.t``) and
leaves words with one space around each. Entries are whole words (`` word ``)
or word starts (`` stem``). A hit inside an exception phrase does not count. The
sum of the weights of a text's hits, and that sum per thousand words, go
through a logistic curve.

Learning uses a bounded sample of labelled rows (``MAX_TOXIC``, ``MAX_CLEAN``,
chosen by a hash of the id), in which equal texts of one label count once: all
terms that are far more frequent in toxic texts, then a greedy choice that covers
every toxic text ``COVER`` times, as far as terms of two texts or more can.

Defined results: null or empty texts have no hits and get the lowest score;
without toxic labels the lexicon is empty and every score is that of no hit;
of contradictory labels of one document the larger counts; repeated rows are each
scored; only the named columns are read.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import slices
from lexiforge.session import materialize

MAX_TOXIC, MAX_CLEAN = 3000, 6000
MIN_TEXTS, MIN_LIFT = 2, 12.0
COVER = 4

#: Look-alikes and the letters that they stand for.
HOMOGLYPHS = dict(zip("абвгдеёзийкмнорстухіјѕԁԛԝαβγεηικμνορτυχω", "abbrdeezuukmhopctyxijsdqwabyenikmvoptuxw"))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
          "@": "a", "$": "s", "€": "e", "!": "i"}
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "rodeo clown", "pond scum", "sore loser",
              "idiot proof", "moron mountain")

_SPLIT = re.compile(r"(?<![^\W\d_])((?:[^\W\d_][.\-_*·]){2,}[^\W\d_])(?![^\W\d_])")
_WORDS = re.compile(r"[^\W\d_]+")


def fold_table() -> dict[int, str]:
    """The character map: homoglyphs, full-width forms and accented Latin letters."""
    out = {ord(k): v for k, v in HOMOGLYPHS.items()}
    out |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: chr(48 + i) for i in range(10)}
    for c in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFD", chr(c))
        if len(plain) > 1 and plain[0].isascii():
            out[c] = plain[0].lower()
    for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):   # invisible
        out[c] = ""
    return out


_DIGIT = re.compile(r"(?<=[^\W\d_])[0134578@$€!9]+(?=[^\W\d_])|(?<![\w@$€!])[0134578@$€9]+(?=[^\W\d_][\w@$€!])")


class Folder:
    def __init__(self):
        self.table = fold_table()

    def __call__(self, text: str) -> str:
        t = text.lower()
        if not t.isascii():
            t = t.translate(self.table)
        t = _DIGIT.sub(lambda m: "".join(DIGITS[c] for c in m[0]), t)
        if _SPLIT.search(t):
            t = _SPLIT.sub(lambda m: re.sub(r"[^a-z]+", "", m[0]) or m[0], t)
        return " " + " ".join(_WORDS.findall(t)) + " "


@dataclass
class Lexicon:
    """Entries (with their leading space; whole words also with a trailing one)
    and weights, the logistic curve, and the exception phrases."""
    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-3.0, 1.5, 0.5)     # intercept, log sum, log density
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    """The automaton of one lexicon, made once per task."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick
        self.folder, self.curve = Folder(), lexicon.curve
        self.automaton = ahocorasick.Automaton()
        for term, w in lexicon.weights.items():
            self.automaton.add_word(term, (len(term), w))
        for phrase in lexicon.exceptions:
            p = self.folder(phrase)
            self.automaton.add_word(p, (len(p), None))
        self.any = len(lexicon.weights) > 0
        if self.any:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Start of each word that is hit -> the largest weight that fits it."""
        if not self.any:
            return {}
        found: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton.iter(folded):
            start = end - n + 1
            if w is None:
                safe.append((start, end))
            else:
                found[start] = max(w, found.get(start, 0.0))
        for a, b in safe:
            for s in [s for s in found if a <= s < b]:
                del found[s]
        return found

    def score(self, text: str | None) -> tuple[float, int]:
        folded = self.folder(text or "")
        return self.score_folded(self.hits(folded), folded.count(" ") - 1)

    def features(self, text: str | None) -> tuple[float, float]:
        folded = self.folder(text or "")
        total = sum(self.hits(folded).values())
        return float(np.log1p(total)), float(np.log1p(1000 * total / max(1, folded.count(" ") - 1)))

    def score_folded(self, hits: dict[int, float], words: int) -> tuple[float, int]:
        total = sum(hits.values())
        z = (self.curve[0] + self.curve[1] * np.log1p(total)
             + self.curve[2] * np.log1p(1000 * total / max(1, words)))
        return float(1 / (1 + np.exp(-z))), len(hits)


def terms_of(folded: str) -> set[str]:
    """Whole words of three letters or more, and word starts of four to six."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(4, 7) if len(w) > n)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                    max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(key, text, y): at most ``max_toxic`` and ``max_clean`` labelled rows, by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.col(label).cast("int").alias("y")).groupBy("key").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("key"))
    picked = (known.where("y = 1").orderBy(order, "key").limit(max_toxic)
              .unionByName(known.where("y = 0").orderBy(order, "key").limit(max_clean)))
    small = F.broadcast(picked)      # at most max_toxic + max_clean rows
    return docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")) \
        .join(small, "key")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Lexicon:
    """A lexicon from labelled rows (already restricted to those one may learn from)."""
    sample = materialize(labelled_sample(docs, labels, key, text, label).select("text", "y").distinct(),
                         "toxicity-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        folder, seen = Folder(), (Counter(), Counter())
        for batch in slices(batches):
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[1 if y else 0].update(terms_of(folder(t)))
        terms = list(seen[1])     # only terms of toxic texts matter
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()),
             pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "bad", "good"])
        rest = [t for t in seen[0] if t not in seen[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()),
             pa.array([seen[0][t] for t in rest], pa.int64())], ["term", "bad", "good"])

    counts = (sample.select("text", "y").mapInArrow(count, "term string, bad long, good long")
              .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    lift = ((F.col("bad") + 0.5) / (toxic + 1)) / ((F.col("good") + 0.5) / (clean + 1))
    passed = (counts.where(F.col("bad") >= MIN_TEXTS).withColumn("lift", lift)
              .where(F.col("lift") >= MIN_LIFT).select("term", "bad", "lift").toArrow().sort_by("term"))
    names = passed.column("term").to_pylist()     # of at most max_toxic texts
    candidates = {t: (n, float(np.log(x))) for t, n, x in
                  zip(names, passed.column("bad").to_pylist(), passed.column("lift").to_pylist())}
    if not candidates:
        return Lexicon()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, number = Folder(), {t: i for i, t in enumerate(names)}
        for batch in slices(batches):
            own = [[number[x] for x in terms_of(folder(t)) if x in number] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32()))], ["terms"])

    texts = sample.where("y = 1").select("text").mapInArrow(present, "terms array<int>").toArrow().column("terms")
    chosen = cover([[names[i] for i in t.as_py()] for t in texts], candidates)
    lexicon = Lexicon({t: round(candidates[t][1], 4) for t in chosen})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in slices(batches):
            x = [matcher.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in x]), pa.array([b for _, b in x]), batch.column(1)], ["a", "b", "y"])

    found = sample.select("text", "y").mapInArrow(features, "a double, b double, y int").toArrow()
    x = np.column_stack([np.ones(found.num_rows), found.column("a").to_numpy(), found.column("b").to_numpy()])
    lexicon.curve = fit_curve(x, found.column("y").to_numpy().astype(float))
    return lexicon


def cover(texts: list[list[str]], candidates: dict[str, tuple[int, float]], times: int = COVER) -> list[str]:
    """Greedy choice of terms until each text is hit ``times`` (as far as it can
    be), or no term helps ``MIN_TEXTS`` texts. Terms that begin with a chosen one, and
    those that a chosen one begins with, are passed over."""
    need = np.full(len(texts), times)
    where: dict[str, list[int]] = {}
    for i, terms in enumerate(texts):
        for t in terms:
            where.setdefault(t, []).append(i)
    rows = {t: np.asarray(v) for t, v in where.items()}
    last = {t: i for i, t in enumerate(sorted(rows, reverse=True))}
    # gains only fall, so a term whose gain has not fallen since it was queued is the best
    queue = [(-len(r), -candidates[t][1], len(t), last[t], t) for t, r in rows.items()]
    heapq.heapify(queue)
    chosen: list[str] = []
    taken, starts = set(), set()          # the chosen terms, and all that they begin with
    while queue:
        gain, *rank, t = heapq.heappop(queue)
        if t in starts or any(t[:n] in taken for n in range(1, len(t))):
            continue
        now = int((need[rows[t]] > 0).sum())
        if now < MIN_TEXTS:
            continue
        if now < -gain:
            heapq.heappush(queue, (-now, *rank, t))
            continue
        chosen.append(t)
        need[rows[t]] -= 1
        taken.add(t)
        starts.update(t[:n] for n in range(1, len(t) + 1))
    return chosen


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, key: str | list[str | Column] = "doc_id",
                   text: str = "text") -> DataFrame:
    """Add score and n_hits to the ``key`` columns of every row."""
    keys = [key] if isinstance(key, str) else key
    given = docs.select(F.struct(*keys).alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in slices(batches):
            out = [matcher.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in out], pa.float64()),
                 pa.array([n for _, n in out], pa.int64())], ["key", "score", "n_hits"])

    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(run, f"key {kind}, score double, n_hits long").select("key.*", "score", "n_hits")
