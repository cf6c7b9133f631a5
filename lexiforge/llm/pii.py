"""Personal data: four fixed patterns, and a linear-chain conditional random field
over word shapes for the forms that the patterns do not write down.

**Base.** ``base_spans`` finds e-mail addresses, IPv4 addresses, payment cards and
international phone numbers, leftmost and without overlap within a kind; matches
that fail their check (parts over 255, digits, Luhn) are dropped. Each pattern is
searched in time linear in the text (possessive repeats, or from its rarest
character outwards), so one text of a megabyte of digits takes no longer than others.

**Field.** Words are runs of anything but ASCII white space. A word's *shape* maps
a-z and all bytes over 127 to ``a``, A-Z to ``A``, digits to ``9``, and squeezes runs of
letters. The score of a label at a word is a sum of weights of features of the shapes
two words to the left and right, and of a short list of cue words; a transition
weight joins neighbours. Weights are fitted by ``train`` on a small labelled table
(forward-backward gradients, Adam), on the driver: at most ``MAX_ROWS`` rows.

**Decoding** is Viterbi, exact over whole texts, in numpy batches. A word at which the
outside label beats every other label by more than any two transitions could give
back is outside on every best path, so texts fall into short windows between such
words; all windows of a batch take each step together.

Spans of the field that touch a base span are left out, as are those that fail the
check of their kind; base spans always stay.

Defined results: a null or empty text has no spans; positions are code points, ends
exclusive; order is by start, then kind as in ``KINDS``, then end; equal rows give
equal spans each; a null key is passed on; other columns are not read (``redact``
passes them on unchanged); an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import slices, span_hashes, text_bytes, word_spans

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "name"]
BASE = KINDS[:4]
#: Rows of the labelled table that are read, at most.
MAX_ROWS = 2_000
SPAN = "struct<kind:string,start:int,end:int,base:boolean>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = t.find("@", max(at + 1, done))


def _addresses(t: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(t):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every valid base match, in order."""
    out = [(s, 0, e) for s, e in _emails(t)]
    out += [(s, 1, e) for s, e in _addresses(t)]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---------------------------------------------------------------- word shapes

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 57
_CLASS[128:] = 97
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words that say what stands next to them.
CUES = ["at", "dot", "tel", "phone", "call", "fax", "mobile", "telefon", "card", "karte", "ssn", "iban", "ip", "host",
        "address", "email", "mail", "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "señor", "señora",
        "(at)", "[at]", "(dot)", "[dot]", "isbn", "version", "page", "pages", "pp", "no", "nr"]
TITLES = frozenset(["mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "señor", "señora"])
_EDGE = ".,;:!?\"'<>"


def shape_features(shape: str) -> list[str]:
    """Features of one shape, most specific first."""
    core = shape.strip(_EDGE)
    squeezed = re.sub("9+", "9", core)
    digits = core.count("9")
    out = [f"s={core[:40]}", f"q={squeezed[:24]}", f"d={min(digits, 20)}", f"a={core[:2]}", f"z={core[-2:]}"]
    for mark, name in (("@", "@"), (".", "."), ("-", "-"), ("+", "+"), (":", ":"), ("/", "/")):
        if mark in core:
            out.append(f"h{name}{min(core.count(mark), 4)}")
    if "(" in core or ")" in core or "[" in core:
        out.append("paren")
    if digits and not set(core) - set("9"):
        out.append("digits only")
    if not digits and not set(core) - set("aA"):
        out.append("letters " + squeezed[:3])
    if shape != core:
        out.append("edge " + shape[len(shape.rstrip(_EDGE)):][:2])
    return out


def _near_features(shape: str) -> list[str]:
    core = shape.strip(_EDGE)
    return [f"q={re.sub('9+', '9', core)[:16]}", f"d={min(core.count('9'), 20)}", f"s={core[:12]}"]


OFFSETS = (-2, -1, 0, 1, 2)


def token_features(shape: str, cue: str, offset: int) -> list[str]:
    f = shape_features(shape) if offset == 0 else _near_features(shape)
    return [f"{offset} {x}" for x in f] + ([f"{offset} cue {cue}"] if cue else []) + (["any"] if offset == 0 else [])


def shapes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the shape of each word."""
    c = _CLASS[buf]
    keep = np.ones(len(c), bool)
    if len(c):
        keep[1:] = (c[1:] != c[:-1]) | ((c[1:] != 97) & (c[1:] != 65))
        keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], place[starts], place[ends]


def cue_table() -> tuple[np.ndarray, list[str]]:
    """Sorted hashes of the cue words, also with a mark behind, and the words."""
    words = [w + m for w in CUES for m in ("", ".", ":", ",")]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(r) for r in raw]), ends)
    order = np.argsort(h)
    return h[order], [words[i].rstrip(".:,") for i in order]


# ---------------------------------------------------------------- the field

class Field:
    """Weights of a trained field, and what it makes of texts."""

    def __init__(self, weights: dict[str, np.ndarray], transitions: np.ndarray):
        self.weights = weights
        self.transitions = np.asarray(transitions, np.float64)
        t = self.transitions
        # how much more a label other than 0 may gain by its two transitions than label 0
        worst = (t[:, 0].min() + t[0].min())
        self.gain = np.array([t[:, y].max() + t[y].max() - worst for y in range(len(t))])
        self._rows: dict[int, int] = {}
        self._table = np.zeros((1, len(OFFSETS), len(t)))
        self._cues, words = cue_table()
        self._cue_rows = np.stack([np.stack([self._sum([f"{o} cue {w}"]) for o in OFFSETS]) for w in words])

    def __reduce__(self):
        return Field, (self.weights, self.transitions)

    def _sum(self, features: list[str]) -> np.ndarray:
        out = np.zeros(len(self.transitions))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                out += w
        return out

    def _shape_rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word the row of its shape in the table of scores by offset."""
        h, first, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self._rows) > 200_000:       # bounded memory, whatever shapes a text brings
            self._rows.clear()
            self._table = self._table[:1]
        rows, new = np.empty(len(h), np.int64), []
        for i, (x, k) in enumerate(zip(h.tolist(), first.tolist())):
            row = self._rows.get(x)
            if row is None:
                row = self._rows[x] = len(self._table) + len(new)
                shape = bytes(buf[starts[k]:ends[k]]).decode("ascii")
                new.append(np.stack([self._sum(token_features(shape, "", o)) for o in OFFSETS]))
            rows[i] = row
        if new:
            self._table = np.concatenate([self._table, np.stack(new)])
        return rows[inverse]

    def scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Score of each label at each word; words of other texts do not count."""
        n = len(starts)
        shape = self._shape_rows(*shapes_of(buf, starts, ends))
        h = span_hashes(_LOWER[buf], starts, ends)
        cue = np.minimum(np.searchsorted(self._cues, h), len(self._cues) - 1)
        is_cue = self._cues[cue] == h
        out = np.zeros((n, len(self.transitions)))
        for k, o in enumerate(OFFSETS):
            lo, hi = max(0, -o), min(n, n - o)
            if lo >= hi:
                continue
            same = row[lo:hi] == row[lo + o:hi + o]
            part = self._table[:, k][shape[lo + o:hi + o]]
            part[~same] = 0
            out[lo:hi] += part
            at = np.flatnonzero(is_cue[lo + o:hi + o] & same)
            out[lo + at] += self._cue_rows[cue[lo + o + at], k]
        return out

    def decode(self, scores: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best labels of every text (words of a text have one ``row``)."""
        n = len(scores)
        labels = np.zeros(n, np.int64)
        if not n:
            return labels
        open_ = (scores[:, 1:] + self.gain[1:] >= scores[:, :1]).any(axis=1)
        begins = np.flatnonzero(open_ & ~np.concatenate([[False], open_[:-1] & (row[1:] == row[:-1])]))
        stops = np.flatnonzero(open_ & ~np.concatenate([open_[1:] & (row[1:] == row[:-1]), [False]])) + 1
        if not len(begins):
            return labels
        order = np.argsort(begins - stops, kind="stable")      # longest first
        begins, length = begins[order], (stops - begins)[order]
        ends = begins + length
        left = (begins > 0) & (row[np.maximum(begins - 1, 0)] == row[begins])
        right = (ends < n) & (row[np.minimum(ends, n - 1)] == row[begins])
        t = self.transitions
        best = scores[begins] + np.where(left[:, None], t[0], 0)
        live = [int(np.searchsorted(-length, -k, side="left")) for k in range(int(length[0]))]   # windows longer than k
        back = [None]
        for k in range(1, len(live)):
            both = best[:live[k], :, None] + t
            back.append(both.argmax(axis=1).astype(np.int8))
            best[:live[k]] = both.max(axis=1) + scores[begins[:live[k]] + k]
        now = (best + np.where(right[:, None], t[:, 0], 0)).argmax(axis=1)
        for k in range(len(live) - 1, -1, -1):
            labels[begins[:live[k]] + k] = now[:live[k]]
            if k:
                now[:live[k]] = back[k][np.arange(live[k]), now[:live[k]]]
        return labels


def _padded(rows: list[list[list[int]]], labels: list[list[int]]):
    longest = max(map(len, rows))
    mask = np.zeros((len(rows), longest), bool)
    gold = np.zeros((len(rows), longest), np.int64)
    for i, y in enumerate(labels):
        mask[i, :len(y)] = True
        gold[i, :len(y)] = y
    return mask, gold


def fit(sentences: list[tuple[list[str], list[str], list[int]]], n_labels: int, rounds: int = 100,
        rate: float = 0.1, penalty: float = 1e-4) -> Field:
    """Weights from (shapes, cues, labels) of labelled texts: Adam on the mean
    conditional log-likelihood, whose gradient comes from forward-backward sums."""
    index: dict[str, int] = {}
    tokens: list[list[int]] = []
    spans = []
    for shapes, cues, _ in sentences:
        first = len(tokens)
        for i in range(len(shapes)):
            f = []
            for o in OFFSETS:
                if 0 <= i + o < len(shapes):
                    f += token_features(shapes[i + o], cues[i + o], o)
            tokens.append([index.setdefault(x, len(index)) for x in f])
        spans.append((first, len(tokens)))
    x = np.zeros((len(tokens), len(index)), np.float32)
    for i, f in enumerate(tokens):
        x[i, f] = 1
    mask, gold = _padded([[[]] * (b - a) for a, b in spans], [y for _, _, y in sentences])
    where = mask.nonzero()
    n, longest, k = len(sentences), mask.shape[1], n_labels
    w, t = np.zeros((len(index), k), np.float32), np.zeros((k, k), np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t)]
    one_hot = np.zeros((n, longest, k), np.float32)
    one_hot[where[0], where[1], gold[where]] = 1
    pair_mask = mask[:, 1:]
    gold_pairs = np.zeros((k, k), np.float32)
    np.add.at(gold_pairs, (gold[:, :-1][pair_mask], gold[:, 1:][pair_mask]), 1)

    def lse(a, axis):
        m = a.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))

    for step in range(1, rounds + 1):
        s = np.zeros((n, longest, k), np.float32)
        s[where] = x @ w
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for i in range(1, longest):
            alpha[:, i] = np.where(mask[:, i, None], lse(alpha[:, i - 1, :, None] + t, 1) + s[:, i], alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            beta[:, i] = np.where(mask[:, i + 1, None], lse(t + (s[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        marginal = np.where(mask[:, :, None], np.exp(alpha + beta - z[:, None, None]), 0)
        pairs = np.exp(alpha[:, :-1, :, None] + t + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        pairs[~pair_mask] = 0
        grads = [x.T @ (marginal - one_hot)[where].astype(np.float32) / n + penalty * w,
                 (pairs.sum(axis=(0, 1)) - gold_pairs) / n + penalty * t]
        for p, g, (m1, m2) in zip((w, t), grads, moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    return Field({f: w[i].astype(np.float64) for f, i in index.items()}, t)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
    return raw, starts, ends


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Field:
    """Fit a field to a table (text, spans array<struct<kind, start, end>>) of
    whole texts with all their spans marked (code points). At most ``max_rows``
    rows are read, by text; rows without words do not count; kinds are ``KINDS``."""
    rows = labelled.select("text", "spans").where("text IS NOT NULL").orderBy("text").limit(max_rows).collect()
    sentences = []
    known = set(CUES)
    for r in rows:
        raw, starts, ends = words_of(r["text"])
        if not len(starts):
            continue
        b, s, e = shapes_of(raw, starts, ends)
        shapes = [bytes(b[i:j]).decode("ascii") for i, j in zip(s, e)]
        points = np.cumsum((raw & 0xC0) != 0x80)
        labels = [0] * len(shapes)
        cues = []
        for i, (p, q) in enumerate(zip(starts, ends)):
            word = bytes(raw[p:q]).decode("utf-8", "replace")
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            cue = lower[:-1] if lower[-1:] in (".", ":", ",") else lower
            cues.append(cue if cue in known else "")
            lo, hi = int(points[p]) - 1, int(points[q - 1])
            for span in r["spans"] or []:
                if span["start"] < hi and lo < span["end"]:
                    labels[i] = 1 + KINDS.index(span["kind"])
        sentences.append((shapes, cues, labels))
    return fit(sentences, 1 + len(KINDS))


# ---------------------------------------------------------------- a small labelled table

_NAMES = ("Anna Karl Maria Louis Elena James Sofia Peter Nina Oscar Clara Hugo Laura Felix Irene Marc "
          "Smith Meyer Dupont Garcia Brown Weber Martin Lopez Clark Fischer Bernard Torres").split()
_FILL = ("the and of to in a is that for was with are this from on by at as it be or they write say "
         "und der die das ist nicht von mit le la les des est pour que el los una por con "
         "people water report system market number review result Station Garden Company Morning List "
         "Every Order Number Item").split()


def _card(rng: random.Random, sep: str) -> str:
    body = [rng.choice("345")] + [rng.choice("0123456789") for _ in range(14)]
    last = next(d for d in "0123456789" if luhn("".join(body) + d))
    digits = "".join(body) + last
    return sep.join(digits[i:i + 4] for i in range(0, 16, 4))


def _value(rng: random.Random, kind: str) -> tuple[str, str]:
    """(cue words before, value) of a form that the base patterns leave out, or base form."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))       # noqa: E731
    w = lambda: "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(3, 9)))     # noqa: E731
    if kind == "email":
        who = rng.choice([w(), f"{w()}.{d(2)}", f"{w()}.{w()}", f"{w()}_{d(2)}"])
        host, top = w(), rng.choice(["com", "org", "net", "de", "fr"])
        return rng.choice(["", "email", "mail:"]), rng.choice(
            [f"{who}@{host}.{top}", f"{who}@mail{d(1)}.{host}.{top}", f"{who} (at) {host} (dot) {top}",
             f"{who} [at] {host}.{top}", f"{who}(at){host}.{top}", f"{who} [at] {host} [dot] {top}", f"{who}[at]{host}[dot]{top}"])
    if kind == "ip":
        h = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(2, 4)))
        four = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        return rng.choice(["", "host", "ip"]), rng.choice(
            [four, four, f"2001:db8::{h()}", ":".join(h() for _ in range(8)), f"fe80::{h()}:{h()}"])
    if kind == "card":
        return rng.choice(["", "card", "card:"]), _card(rng, rng.choice(["", "-", " ", ".", "."]))
    if kind == "phone":
        a, b, c = rng.randint(200, 989), d(3), d(4)
        return rng.choice(["", "tel", "phone:", "call"]), rng.choice(
            [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"+49 {d(3)} {d(7)}"])
    if kind == "ssn":
        return rng.choice(["", "ssn", "ssn:"]), f"{d(3)}-{d(2)}-{d(4)}"
    if kind == "iban":
        land = rng.choice(["DE", "FR", "ES", "GB"])
        body = d(20)
        return rng.choice(["", "iban", "iban:"]), rng.choice(
            [land + body, f"{land}{body[:2]} " + " ".join(body[i:i + 4] for i in range(2, 18, 4)) + f" {d(2)}"])
    first, last = rng.choice(_NAMES[:16]), rng.choice(_NAMES[16:])
    return rng.choice(["Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]), rng.choice(
        [f"{first} {last}", last, f"{first} {last}"])


def _other(rng: random.Random) -> str:
    """Numbers and codes that are nobody's."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))       # noqa: E731
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))     # noqa: E731
    return rng.choice([
        f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(2)}/{d(2)}/{d(4)}",
        f"{d(2)}:{d(2)}", f"{d(1)}.{d(1)}", f"version {d(1)}.{d(1)}.{d(2)}", f"${d(1)},{d(3)}.{d(2)}", f"({d(4)})", d(1), d(2), d(3), d(4), d(5),
        d(6), d(8), d(12), d(16), f"{d(4)}-{d(4)}", f"pages {d(2)}-{d(3)}", f"isbn 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", h(18), f"password={h(18)}",
        f'token = "{h(40)}"', f"AKIA{h(6).upper()}{d(2)}{h(4).upper()}", f"{d(2)}%", f"{d(3)}.{d(2)}", f"CC BY-NC {d(1)}.{d(1)}.",
        f"https://{h(6)}.org/{d(4)}", f"({d(3)})", f"#{d(5)}", f"{d(3)}x{d(3)}", f"{d(1)}.{d(1)}.{d(1)}.", f"{d(3)} - {d(3)}",
        f"no. {d(4)}", " ".join(_word(rng) + rng.choice(["***", "&&&", "%%%", "$$$", ",###", "!!", "!?", "|", "..."])
                                for _ in range(rng.randint(1, 5))),
        " ".join(_word(rng).upper() + rng.choice(["", "!!", "."]) for _ in range(rng.randint(1, 4))),
        f"| {_word(rng)} | {d(2)} |", f"<{_word(rng)}>", f"{_word(rng)}-{_word(rng)}", f"{_word(rng)}/{_word(rng)}", f"@{h(5)}", f"a/b-{d(2)}", "C++", "x = y + 1", "- - -", "| a | b |", "Table 3.", "(a) and (b)"])


def labelled_examples(spark: SparkSession, rows: int = 600, seed: int = 7) -> DataFrame:
    """A small labelled table (text, spans) made by rule: every kind in the forms
    above, numbers and codes that are none, and plain words of several languages."""
    rng, out = random.Random(seed), []
    for i in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(1, 2)):
            text += "".join(_word(rng) + rng.choice([" ", " ", " ", ". ", ", ", "\n"]) for _ in range(rng.randint(1, 4)))
            if rng.random() < 0.55:
                kind = KINDS[rng.randrange(len(KINDS))]
                cue, value = _value(rng, kind)
                text += f"{cue} " if cue else ""
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + rng.choice([" ", " ", ". ", ", "])
            else:
                text += _other(rng) + rng.choice([" ", " ", ". "])
        text += " ".join(_word(rng) for _ in range(rng.randint(1, 3)))
        out.append((text, spans))
    return spark.createDataFrame(out, "text string, spans array<struct<kind:string,start:int,end:int>>")


def _word(rng: random.Random) -> str:
    if rng.random() < 0.5:
        return rng.choice(_FILL)
    w = "".join(rng.choice("aeiourstnldhcéñü") for _ in range(rng.randint(2, 10)))
    return w if rng.random() < 0.8 else w.capitalize()


# ---------------------------------------------------------------- spans of documents

_SPELT = re.compile(r"[A-Za-z0-9._%+-]++\s*(?:@|[\[(]at[\])]|(?<=\s)at(?=\s))\s*[A-Za-z0-9-]++"
                    r"(?:\s*(?:\.|[\[(]dot[\])]|(?<=\s)dot(?=\s))\s*[A-Za-z0-9-]++)++")


def _valid(kind: int, value: str, before: str) -> bool:
    """Whether a span of the field passes its kind's check; ``before``: the word before it."""
    name = KINDS[kind]
    digits = "".join(c for c in value if c in "0123456789")
    if name == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if name == "phone":
        return 10 <= len(digits) <= 15
    if name == "ssn":
        return len(digits) == 9
    if name == "iban":
        return 14 <= len(digits) <= 30
    if name == "ip":
        return value.count(":") >= 2
    if name == "email":
        return _SPELT.fullmatch(value) is not None
    return before in TITLES and all(w.istitle() and w.isalpha() for w in value.replace("-", " ").split())


_TRIM = " \t\n\r\v\f.,;:!?\"'<>"


def field_spans(model: Field, column: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> (start, kind number, end) of the field's valid spans, in code points."""
    buf, offsets = text_bytes(column)
    starts, ends, row = word_spans(buf, offsets)
    if not len(starts):
        return {}
    labels = model.decode(model.scores(buf, starts, ends, row), row)
    on = np.flatnonzero(labels)
    if not len(on):
        return {}
    same = (labels[on[1:]] == labels[on[:-1]]) & (on[1:] == on[:-1] + 1) & (row[on[1:]] == row[on[:-1]])
    first = on[np.concatenate([[True], ~same])]
    last = on[np.concatenate([~same, [True]])]
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(first.tolist(), last.tolist()):
        r = int(row[a])
        lo, hi = int(starts[a]), int(ends[b])
        value = bytes(buf[lo:hi]).decode("utf-8", "replace")
        at = int(((buf[offsets[r]:lo] & 0xC0) != 0x80).sum())
        cut = len(value) - len(value.lstrip(_TRIM))
        value = value.strip(_TRIM)
        kind = int(labels[a]) - 1
        if KINDS[kind] == "name":       # a name ends with its clause
            value = re.split(r"[,;:!?\n]|\. ", value)[0]
        titled = a and row[a - 1] == r
        before = bytes(buf[starts[a - 1]:ends[a - 1]]).decode("utf-8", "replace").rstrip(".").lower() if titled else ""
        if value and _valid(kind, value, before):
            out.setdefault(r, []).append((at + cut, kind, at + cut + len(value)))
    return out


def all_spans(model: Field | None, column: pa.Array) -> Iterator[list[tuple[int, int, int, bool]]]:
    """Of each text (start, kind number, end, base), in order."""
    added = field_spans(model, column) if model is not None else {}
    for i, text in enumerate(column.to_pylist()):
        base = base_spans(text)
        spans = [(s, k, e, True) for s, k, e in base]
        for s, k, e in added.get(i, ()):
            if not any(s < f and b < e for b, _, f in base):
                spans.append((s, k, e, False))
        spans.sort()
        yield spans


def find_pii(docs: DataFrame, model: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, spans array<struct<kind, start, end, base>>) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)      # some thousand weights
    d = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches):
            column = pc.fill_null(batch.column(0), "")
            counts, flat = [], []
            for spans in all_spans(field, column):
                counts.append(len(spans))
                flat += spans
            values = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for _, k, _, _ in flat], pa.string()), pa.array([s for s, *_ in flat], pa.int32()),
                 pa.array([e for _, _, e, _ in flat], pa.int32()), pa.array([b for *_, b in flat], pa.bool_())],
                ["kind", "start", "end", "base"])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.ListArray.from_arrays(pa.array(ends), values)], ["id", "spans"])

    return d.mapInArrow(run, f"id {kind}, spans array<{SPAN}>").select(F.col("id").alias(key), "spans")


def redact(docs: DataFrame, model: Field | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in brackets (of
    overlapping spans the first; the others lose what they share). Null stays null."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches, text=text):
            column = batch.column(at)
            out = []
            for t, spans in zip(column.to_pylist(), all_spans(field, pc.fill_null(column, ""))):
                if spans:
                    pieces, done = [], 0
                    for s, k, e, _ in spans:
                        if e > done:
                            pieces += [t[done:max(s, done)], f"[{KINDS[k].upper()}]"] if s >= done else []
                            done = e
                    t = "".join(pieces) + t[done:]
                out.append(t)
            columns = [pa.array(out, column.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    rest = [c for c in found.columns if c != "spans"]
    return found.select(*rest, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
