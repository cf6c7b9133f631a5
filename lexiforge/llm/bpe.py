"""Byte-level BPE encoding and decoding by tree concatenation.

A text is cut into halves down to leaves of ``leaf_chars``; leaves are encoded
on their own and neighbours are joined upwards. At each join a window of
tokens on both sides is encoded again and grown until it agrees with both
sides at a place from which the cut can have no effect:

* a *safe* place: white space after something else. The splitting pattern
  starts a new piece there whatever stands around it; or
* any token boundary, if the whole window is one run of letters or digits:
  it then lies in one piece, and a sequence of BPE tokens whose neighbours
  all occur side by side in valid encodings is itself the valid encoding.

Otherwise the window grows to the whole of both sides, which is exact by
definition. Texts longer than ``long_chars`` are dealt out: their leaves become
rows that any task may encode, and are joined per text afterwards.

Vocabulary, merges and special tokens come from a ``tokenizers`` JSON file; no
file is copied or changed. Special tokens in a text become their ids, as that
library does by default. Defined results: a null text counts as empty and has
no tokens; repeated rows (also of one id) are each encoded; an empty table
gives an empty result; only the id and text columns are read, so clashing
names of others do no harm.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import slices
from lexiforge.session import materialize

#: Fixed value: the published splitting pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 8192
LONG_CHARS = 65536


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TreeBpe:
    """Encoder and decoder for one vocabulary file, made once per task."""

    def __init__(self, spec: str, leaf_chars: int = LEAF_CHARS, window: int = 16):
        import regex
        import tiktoken
        model = json.loads(spec)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.ranks = {bytes(letters[c] for c in token): i
                      for token, i in model["model"]["vocab"].items() if token not in special}
        merged = [self.ranks[bytes(letters[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))]
                  for m in model["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("ids of merged tokens must rise in the order of the merges")
        self.encoding = tiktoken.Encoding("tree", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
                                        + ")") if special else None
        self.bytes_of = {i: t for t, i in self.ranks.items()} | {i: s.encode() for s, i in special.items()}
        self.leaf_chars, self.window = leaf_chars, window
        self.safe = regex.compile(r"(?<=\S)\s")
        self.one_class = regex.compile(r"\p{L}+|\p{N}+")

    def encode(self, text: str) -> list[int]:
        if self.split_special is None:
            return self.encode_plain(text)
        out: list[int] = []
        for part in self.split_special.split(text):
            out += [self.special[part]] if part in self.special else self.encode_plain(part)
        return out

    def encode_plain(self, text: str) -> list[int]:
        """Tree concatenation over one text without special tokens."""
        if len(text) <= self.leaf_chars:
            return self.encoding.encode_ordinary(text)
        half = len(text) // 2
        return self.join(self.encode_plain(text[:half]), self.encode_plain(text[half:]))

    def direct(self, text: str) -> list[int]:
        """The encoding of a window, in one go."""
        if self.split_special is None:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for part in self.split_special.split(text):
            out += [self.special[part]] if part in self.special else self.encoding.encode_ordinary(part)
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' texts together, from their encodings."""
        if not left or not right:
            return left + right
        size = self.window
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            whole = a == 0 and b == len(right)
            joined = self._try(left, right, a, b, whole)
            if joined is not None:
                return joined
            size *= 2

    def _try(self, left, right, a, b, whole):
        head = self.decode_bytes(left[a:])
        tail = self.decode_bytes(right[:b])
        try:
            text = (head + tail).decode("utf-8")
        except UnicodeDecodeError:      # an edge of the window cuts a character
            if whole:
                raise
            return None
        new = self.direct(text)
        if whole:
            return new
        one_class = self.one_class.fullmatch(text) is not None
        ends = np.cumsum([len(self.bytes_of[i]) for i in new])
        seam, size = len(head), len(head) + len(tail)
        # Left: equal tokens from the window's start up to a place no later than
        # three characters (of up to four bytes) before the seam.
        p = self._agree(new, ends, left[a:], text, one_class, seam - 12, 0) if a else 0
        back = new[::-1]
        q = self._agree(back, size - np.concatenate([[0], ends[:-1]])[::-1], right[:b][::-1], text,
                        one_class, len(tail) - 12, size) if b < len(right) else 0
        if p is None or q is None or p + q > len(new):
            return None
        return left[:a] + new + right[b:]

    def _agree(self, new, ends, old, text, one_class, limit, size):
        """How many tokens of ``new`` (from this side of the window) equal ``old``
        and end at a safe place within ``limit`` bytes; None if there is none.
        ``ends``: distance in bytes of each token's far end from this edge;
        ``size``: 0 on the left side, the window's bytes on the right side."""
        data = text.encode("utf-8")
        found, best = None, 0
        for k, (x, y) in enumerate(zip(new, old)):
            if x != y or ends[k] > limit:
                break
            best = k + 1
            if one_class:
                found = best
                break
            at = int(ends[k]) if not size else size - int(ends[k])
            try:
                around = data[max(0, at - 4):at].decode("utf-8", "ignore")[-1:] + data[at:at + 4].decode("utf-8", "ignore")[:1]
            except UnicodeDecodeError:
                continue
            if len(around) == 2 and self.safe.match(around, 1):
                found = best
                break
        return found


def load_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _digests(ids: list[int], codec: TreeBpe) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
                     with_ids: bool = False, leaf_chars: int = LEAF_CHARS,
                     long_chars: int = LONG_CHARS, split_rows: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Returns key, n_tokens, ids_sha256, decoded_sha256 and with ``with_ids`` also
    ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``.
    ``split_rows``: deal the leaves of long texts out to all tasks.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(load_spec(vocabulary))   # one vocabulary file
    key_type = docs.schema[key].dataType
    d = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = (f"key {key_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, "
              "ids binary, decoded string")
    leaf_schema = schema + ", row string, leaf int, part string"

    def result(keys, out, codec):
        cols = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for ids in out:
            n, a, b = _digests(ids, codec) if ids is not None else (None, None, None)
            cols["n_tokens"].append(n)
            cols["ids_sha256"].append(a)
            cols["decoded_sha256"].append(b)
            cols["ids"].append(np.asarray(ids, "<u4").tobytes() if with_ids and ids is not None else None)
            cols["decoded"].append(codec.decode(ids) if with_ids and ids is not None else None)
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        return [keys, *[pa.array(v, t) for v, t in zip(cols.values(), types)]]

    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        codec = TreeBpe(spec.value, leaf_chars)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            long = [split_rows and len(t) > long_chars for t in texts]
            out = [None if big else codec.encode(t) for t, big in zip(texts, long)]
            done = pa.array([not big for big in long])
            nothing = pa.nulls(sum(not x for x in long))
            base = pa.RecordBatch.from_arrays(
                [*result(batch.column(0), out, codec)], names).filter(done)
            yield pa.RecordBatch.from_arrays(
                [*base.columns, nothing.cast(pa.string()), nothing.cast(pa.int32()), nothing.cast(pa.string())],
                [*names, "row", "leaf", "part"])
            for i, big in enumerate(long):
                if big:
                    row = uuid.uuid4().hex
                    parts = [p for s in (codec.split_special.split(texts[i]) if codec.split_special
                                         else [texts[i]]) for p in ([s] if s in codec.special else [
                                             s[j:j + leaf_chars] for j in range(0, len(s), leaf_chars)])]
                    n = len(parts)
                    none = pa.nulls(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * n, batch.column(0).type), none.cast(pa.int64()),
                         none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.binary()),
                         none.cast(pa.string()), pa.array([row] * n), pa.array(range(n), pa.int32()),
                         pa.array(parts)], [*names, "row", "leaf", "part"])

    def encode_leaf(batches):
        codec = TreeBpe(spec.value, leaf_chars)
        for batch in slices(batches, "part"):
            ids = [np.asarray(codec.encode(t), "<u4").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())],
                                             ["key", "row", "leaf", "ids"])

    def join_leaves(group: pa.Table) -> pa.Table:
        codec = TreeBpe(spec.value, leaf_chars)
        group = group.sort_by("leaf")
        level = [np.frombuffer(x, "<u4").tolist() for x in group.column("ids").to_pylist()]
        special = set(codec.special.values())

        def join(a, b):
            if (a and a[-1] in special) or (b and b[0] in special):
                return a + b
            return codec.join(a, b)

        # Texts between special tokens are joined by themselves; the tree below
        # never crosses one, as ``join`` stops at it.
        while len(level) > 1:
            level = [join(*level[i:i + 2]) if i + 1 < len(level) else level[i]
                     for i in range(0, len(level), 2)]
        return pa.Table.from_arrays(result(group.column("key").slice(0, 1), level, codec), names)

    done = d.mapInArrow(encode, leaf_schema)
    if split_rows:
        done = materialize(done, "bpe")    # leaves of long texts and results of the others
        leaves = (done.where("leaf IS NOT NULL").select("key", "row", "leaf", "part")
                  .repartition("row", "leaf")
                  .mapInArrow(encode_leaf, f"key {key_type.simpleString()}, row string, leaf int, ids binary"))
        joined = leaves.groupBy("row").applyInArrow(join_leaves, schema)
        done = done.where("leaf IS NULL").select(*names).unionByName(joined)
    return done.select(F.col("key").alias(key), *(names[1:] if with_ids else names[1:4]))
