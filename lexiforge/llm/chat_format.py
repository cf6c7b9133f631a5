"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
sorted spans of its assistant texts are intersected with the sorted token
spans by binary search. A token is under the loss if it shares a character
with an assistant text; the characters under the loss are those shared ones.

Turns are marked by ``<|im_start|>role\\n`` and ``<|im_end|>\\n``. Inside roles and
texts every ``<|`` (also with backslashes between) gets one more backslash
before its bar, so no text can hold a mark; taking that backslash away again
restores the text exactly.

Defined results: null texts and roles are empty; turns are ordered by (turn,
role, text), nulls first; repeated rows are turns of their own; a null
conversation id is a conversation; a conversation without assistant turn has
an empty mask; other columns are not read. A conversation is one row of the
result and is gathered by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_HELD = re.compile(r"<(\\*)\|")
_FREED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _HELD.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _FREED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the sorted spans of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}\n", escape(text)
        at += len(head)
        if role == learn:
            spans.append((at, at + len(body)))
        at += len(body) + len(END) + 1
        parts += [head, body, END, "\n"]
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, body = part.partition("\n")
        turns.append((unescape(head), unescape(body[:body.rindex(END)])))
    return turns


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The mask over tokens: which of the sorted token spans (n x 2) meet one of
    the sorted, disjoint character spans."""
    mask = np.zeros(len(offsets), dtype=bool)
    starts, ends = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(ends, a, side="right"):np.searchsorted(starts, b, side="left")] = True
    return mask


def masked_spans(offsets: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The character spans under the mask, clipped to the spans to learn."""
    out = []
    for a, b in spans:
        lo = np.searchsorted(offsets[:, 1], a, side="right")
        hi = np.searchsorted(offsets[:, 0], b, side="left")
        hit = np.flatnonzero(mask[lo:hi]) + lo
        if len(hit):
            out.append((max(a, int(offsets[hit[0], 0])), min(b, int(offsets[hit[-1], 1]))))
    return out


def load_tokenizer(spec: str):
    """The vocabulary with the two marks as special tokens of their own."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.add_special_tokens([START, END])
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


FORMATTED = ("n_turns long, formatted string, ids array<int>, loss_mask binary, "
             "loss_spans array<struct<start:int,end:int>>")


def format_conversations(turns: DataFrame, vocabulary: str, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, n_turns, formatted, ids, loss_mask (one
    byte per token) and loss_spans (code points of ``formatted``)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = turns.sparkSession.sparkContext.broadcast(f.read())
    key = turns.schema[conv].dataType.simpleString()
    empty = F.lit("")
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), empty).alias("role"),
        F.coalesce(F.col(f"`{text}`"), empty).alias("text")).alias("t"))
    convs = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        .alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts, spans, counts = [], [], []
                for ts in part.column(1).to_pylist():
                    t, s = render([(x["role"], x["text"]) for x in ts], learn)
                    texts.append(t)
                    spans.append(s)
                    counts.append(len(ts))
                ids, masks, under = [], [], []
                for t, s in zip(texts, spans):
                    e = tokenizer.encode(t, add_special_tokens=False)
                    offsets = np.asarray(e.offsets, dtype=np.int64).reshape(-1, 2)
                    mask = align(offsets, s)
                    ids.append(e.ids)
                    masks.append(mask.astype(np.uint8).tobytes())
                    under.append([{"start": a, "end": b} for a, b in masked_spans(offsets, mask, s)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(texts, pa.string()),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.binary()),
                     pa.array(under, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    ["conv", "n_turns", "formatted", "ids", "loss_mask", "loss_spans"])

    out = convs.mapInArrow(run, f"conv {key}, {FORMATTED}")
    return out.withColumnRenamed("conv", conv)


def digest_formatted(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from the output: turns and the text under the loss."""
    key = formatted.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        for batch in batches:
            cols = {k: [] for k in ("n", "turns", "chars", "loss", "size")}
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                h = hashlib.sha256()
                for r, t in turns:
                    h.update(f"{r}\n{t}\n".encode())
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                for k, v in zip(cols, (len(turns), h.hexdigest(), len(loss),
                                       hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    cols[k].append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, t) for v, t in zip(cols.values(), types)]],
                [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(conv, "formatted", "loss_spans").mapInArrow(
        run, f"{conv} {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")
