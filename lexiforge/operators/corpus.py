"""Training-data preparation and prompts (S-5..S-7, M-1..M-8).

Design for skew: a conversation is a group of turns, and one conversation may
be huge. Per-conversation totals (token counts, trainable counts) are
partial aggregates; the only ordered operations per conversation are windows
over its turns (sorted with spill), and the only collected text is bounded by
the truncation length.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions.text import md5_bucket, train_tokens
from lexiforge.schemas import (
    CHAT_BEGIN, CHAT_END, CHAT_HEADER, DEFAULT_TEST_FRACTION, RAG_JOIN, RAG_PREAMBLE,
    SYSTEM_PROMPT,
)
from lexiforge.session import materialize, ship_by_value
from lexiforge.versions import new_folder, publish, read_manifest


@dataclass(frozen=True)
class ChatTemplate:
    """Header/footer strings of a chat template (M-1); a parameter, not a model."""

    begin: str = CHAT_BEGIN
    header: str = CHAT_HEADER   # contains "{role}"
    end: str = CHAT_END

    def header_col(self, role: Column) -> Column:
        before, after = self.header.split("{role}")
        return F.concat(F.lit(before), role, F.lit(after))

    def message(self, role: Column, content: Column) -> Column:
        return F.concat(self.header_col(role), F.coalesce(content, F.lit("")), F.lit(self.end))


LLAMA3 = ChatTemplate()


def render_messages(messages: Column, template: ChatTemplate = LLAMA3,
                    add_generation_prompt: bool = False) -> Column:
    """M-1 over an ``array<struct<role, content>>`` column (narrow)."""
    body = F.array_join(F.transform(messages, lambda m: template.message(m["role"], m["content"])), "")
    tail = template.header_col(F.lit("assistant")) if add_generation_prompt else F.lit("")
    return F.concat(F.lit(template.begin), body, tail)


def render_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text",
                 template: ChatTemplate = LLAMA3) -> DataFrame:
    """M-1 over a flat turns table -> (conv, n_messages, text).

    Each message is rendered in place (narrow); only the final ordered join
    is per conversation.
    """
    piece = template.message(F.col(role), F.col(text))
    return (turns.select(conv, turn, piece.alias("_p"))
            .groupBy(conv)
            .agg(F.count(F.lit(1)).alias("n_messages"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "_p"))),
                                          lambda x: x["_p"]), "").alias("_body"))
            .select(conv, "n_messages",
                    F.concat(F.lit(template.begin), F.col("_body")).alias("text")))


def turn_tokens(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text",
                template: ChatTemplate = LLAMA3) -> DataFrame:
    """Per turn: rendered-message tokens, header token count, trainable count.

    Tokenising each rendered message separately gives the same tokens as
    tokenising the whole rendered conversation: every message ends with the
    end marker and starts with a header token, and the regex never matches
    across either.
    """
    header = template.header_col(F.col(role))
    toks = train_tokens(template.message(F.col(role), F.col(text)))
    n_header = F.size(train_tokens(header))
    return turns.select(
        conv, turn, role, toks.alias("tokens"), F.size(toks).alias("n_tokens"),
        F.when(F.col(role) == "assistant", F.size(toks) - n_header).otherwise(F.lit(0))
        .alias("n_trainable"))


def truncate_tokens(turns: DataFrame, max_len: int, conv: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text",
                    template: ChatTemplate = LLAMA3) -> DataFrame:
    """M-2: token count of the rendered conversation and its first ``max_len``
    tokens, joined by single spaces -> (conv, n_tokens, n_kept, kept_text).

    Tensors are not padded here: padding depends on batch grouping and belongs
    to the export step. The running offset per conversation is a window over
    its turns; the collected tokens are at most ``max_len``.
    """
    begin = train_tokens(F.lit(template.begin))
    t = turn_tokens(turns, conv, turn, role, text, template)
    # The token arrays go through the window with their row, so a repeated
    # (conv, turn) counts each of its rows once; ties go by the tokens.
    w = Window.partitionBy(conv).orderBy(turn, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_off", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)) + F.size(begin))
    room = F.greatest(F.lit(max_len) - F.col("_off"), F.lit(0))
    kept = F.when(room > 0, F.slice("tokens", 1, room)).otherwise(F.array().cast("array<string>"))
    per_conv = (t.select(conv, turn, "n_tokens", kept.alias("_k"))
                .groupBy(conv)
                .agg(F.sum("n_tokens").alias("_n"),
                     F.collect_list(F.when(F.size("_k") > 0, F.struct(turn, "_k"))).alias("_ks")))
    kept_all = F.concat(F.slice(begin, 1, max_len),
                        F.flatten(F.transform(F.array_sort("_ks"), lambda x: x["_k"])))
    return per_conv.select(
        conv,
        (F.col("_n") + F.size(begin)).cast("bigint").alias("n_tokens"),
        F.size(kept_all).cast("bigint").alias("n_kept"),
        F.array_join(kept_all, " ").alias("kept_text"))


def response_mask_counts(turns: DataFrame, conv: str = "conv_id", **kw) -> DataFrame:
    """M-6 totals: all tokens vs. tokens that carry a label (assistant content
    and its end marker) -> (conv, n_tokens, n_trainable). Partial aggregates."""
    t = turn_tokens(turns, conv, **kw)
    return t.groupBy(conv).agg(
        (F.sum("n_tokens") + F.lit(1)).cast("bigint").alias("n_tokens"),
        F.sum("n_trainable").cast("bigint").alias("n_trainable"))


IGNORE_INDEX = -100


def response_mask_labels(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                         **kw) -> DataFrame:
    """M-6 per turn: token list and label mask (1 = trained, IGNORE_INDEX = not).

    Per-turn rows keep the mask distributed; a consumer that needs one array
    per conversation orders by ``turn`` at export.
    """
    t = turn_tokens(turns, conv, turn, **kw)
    mask = F.transform("tokens", lambda x, i: F.when(
        (F.col("n_trainable") > 0) & (i >= F.col("n_tokens") - F.col("n_trainable")),
        F.lit(1)).otherwise(F.lit(IGNORE_INDEX)))
    return t.select(conv, turn, "tokens", mask.alias("labels"))


def labelled_tokens(turns: DataFrame, max_len: int, conv: str = "conv_id", turn: str = "turn",
                    template: ChatTemplate = LLAMA3, **kw) -> DataFrame:
    """M-6 per conversation: (conv, tokens, labels), the first ``max_len`` tokens of the
    rendered conversation and a label for each: 1 for assistant content and its end
    marker, ``IGNORE_INDEX`` for the rest. Tokens and labels are cut by the same offsets, so
    they stay aligned; what is collected per conversation is at most ``max_len`` long."""
    begin = train_tokens(F.lit(template.begin))
    t = turn_tokens(turns, conv, turn, template=template, **kw)
    w = Window.partitionBy(conv).orderBy(turn, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_off", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)) + F.size(begin))
    labels = F.transform("tokens", lambda x, i: F.when(
        (F.col("n_trainable") > 0) & (i >= F.col("n_tokens") - F.col("n_trainable")), F.lit(1)).otherwise(F.lit(IGNORE_INDEX)))
    room = F.greatest(F.lit(max_len) - F.col("_off"), F.lit(0))
    piece = F.when(room > 0, F.struct(F.col(turn).alias("turn"), F.slice("tokens", 1, room).alias("t"),
                                      F.slice(labels, 1, room).alias("l")))
    per_conv = t.select(conv, piece.alias("_p")).groupBy(conv).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    ignored = F.transform(begin, lambda x: F.lit(IGNORE_INDEX))
    return per_conv.select(
        conv, F.concat(F.slice(begin, 1, max_len), F.flatten(F.transform("_ps", lambda x: x["t"]))).alias("tokens"),
        F.concat(F.slice(ignored, 1, max_len), F.flatten(F.transform("_ps", lambda x: x["l"]))).alias("labels"))


def hash_split(df: DataFrame, key: str, test_fraction: float = DEFAULT_TEST_FRACTION,
               buckets: int = 100, out: str = "split") -> DataFrame:
    """M-3: deterministic train/test split by a hash of ``key``.

    Every row of one key lands on one side (all phrasings of one entity stay
    together); the result does not depend on partitioning. Sizes are
    approximately ``test_fraction``.
    """
    cut = int(round(test_fraction * buckets))
    return df.withColumn(out, F.when(md5_bucket(F.col(key), buckets) < cut, F.lit("test"))
                         .otherwise(F.lit("train")))


def exact_split(df: DataFrame, key: str, test_fraction: float = DEFAULT_TEST_FRACTION,
                out: str = "split") -> DataFrame:
    """M-3, exact: the test side takes whole groups of one ``key`` in the order of a hash,
    as few as hold ``ceil(test_fraction * rows)`` rows; exact to the row where each key has
    one row. Nothing is sorted: passes over a histogram of the hash's next 16 bits
    (at most 65,536 counts each) narrow down the last hash of the test side. The result depends on
    the keys alone. A null key is a group of its own; an empty table stays empty.
    """
    h = F.md5(F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n")))
    hashes = df.select(h.alias("h"))
    prefix, before, target = "", 0, None
    while len(prefix) < 32:
        at = len(prefix)
        part = hashes.where(F.substring("h", 1, at) == prefix) if at else hashes
        counts = part.groupBy(F.substring("h", at + 1, 4).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
        if target is None:
            # as a decimal, so that 0.1 of 30 rows is 3
            target = math.ceil(Fraction(str(test_fraction)) * sum(r["n"] for r in counts))
            if target <= 0:
                return df.withColumn(out, F.lit("train"))
        for r in counts:
            if before + r["n"] >= target:
                prefix += r["b"]
                break
            before += r["n"]
        if before + r["n"] == target:       # the whole bucket belongs to the test side
            break
    return df.withColumn(out, F.when(F.substring(h, 1, len(prefix)) <= prefix, F.lit("test")).otherwise(F.lit("train")))


def _running_fn(before: str, out: list[str]):
    def run(batches):
        from pyspark import TaskContext
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(before).cast(pa.int64())
            ends = pc.add(pc.cumulative_sum(n), total)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * b.num_rows, pa.int64()), pc.subtract(ends, n)], [*b.schema.names, *out])
            total = ends[-1].as_py() if b.num_rows else total
    return run


def pack_offsets(docs: DataFrame, length: str, key: str, block_len: int, parts: int | None = None) -> DataFrame:
    """M-5, offsets: all documents laid end to end in one order, that of the md5 of
    ``key`` (then length and a hash of the other columns), each ``length`` long (tokens + one end token);
    blocks are cut every ``block_len`` tokens -> (+ offset, first_block, last_block).

    Two prefix sums: rows are sorted by ranges and each task sums within its range as it
    writes it; the ranges' totals (one row each) are summed up and added. No window
    spans a range, a repeated key is cut at any row, and the result does not depend on
    ``parts``, partitioning or the number of rows. Null lengths count as 0. Columns
    named ``_part``, ``_within`` or ``_row`` are refused.
    """
    if {"_part", "_within", "_row"} & set(docs.columns):
        raise ValueError("columns _part, _within and _row are used here")
    d = docs.withColumn(length, F.coalesce(F.col(length).cast("bigint"), F.lit(0).cast("bigint")))
    rest = [F.col(c) for c in docs.columns if c not in (key, length)]
    spark = docs.sparkSession
    # short sort keys: the texts themselves are neither sampled nor compared
    order = [F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.col(length), *([F.xxhash64(*rest)] if rest else [])]
    d = d.withColumn("_row", F.monotonically_increasing_id())
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, *order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    schema = T.StructType([*d.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_within", T.LongType())])
    laid = materialize(d.mapInArrow(_running_fn(length, ["_part", "_within"]), schema), "pack")
    totals = laid.groupBy("_part").agg(F.sum(length).alias("n")).orderBy("_part").collect()     # one row a range
    starts, at = [], 0
    for r in totals:
        starts.append((r["_part"], at))
        at += r["n"]
    starts = spark.createDataFrame(starts, "_part long, _start long")
    laid = laid.join(F.broadcast(starts), "_part")
    o = (F.col("_start") + F.col("_within")).cast("bigint")
    last = F.greatest(o + F.col(length) - 1, o)
    return (laid.withColumn("offset", o).withColumn("first_block", F.floor(o / block_len).cast("bigint"))
            .withColumn("last_block", F.floor(last / block_len).cast("bigint")).drop("_part", "_within", "_start"))


def pack_blocks(docs: DataFrame, tokens: str, key: str, block_len: int, parts: int | None = None,
                end_token: str = CHAT_END) -> DataFrame:
    """M-5, contents: -> (block, tokens) with ``block_len`` tokens a block. A document
    crossing a boundary is split; only the very last block may be partial (reported by
    its size, never dropped)."""
    own = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    d = docs.select(F.col(key).alias("key"), F.concat(own, F.array(F.lit(end_token))).alias("t"))
    d = pack_offsets(d.withColumn("len", F.size("t")), "len", "key", block_len, parts)
    # one row per (document, block) it touches, holding its slice of tokens
    d = d.withColumn("block", F.explode(F.sequence("first_block", "last_block")))
    begin = F.greatest(F.col("offset"), F.col("block") * block_len)
    end = F.least(F.col("offset") + F.col("len"), (F.col("block") + 1) * block_len)
    piece = F.slice("t", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int"))
    return (d.select("block", F.struct(begin.alias("g"), piece.alias("p")).alias("x"))
            .groupBy("block")
            .agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"])).alias("tokens")))


def system_message(context: Column) -> Column:
    """M-7: system text, plus the retrieved context when it is non-empty."""
    extra = F.concat(F.lit("." + RAG_PREAMBLE + RAG_JOIN), context)
    return F.concat(F.lit(SYSTEM_PROMPT),
                    F.when(F.coalesce(F.length(context), F.lit(0)) > 0, extra).otherwise(F.lit("")))


def prompt_messages(queries: DataFrame, context: DataFrame | None = None,
                    history: DataFrame | None = None, query_id: str = "query_id",
                    text: str = "text") -> DataFrame:
    """M-7/M-8: one row per query with ``messages = [*history, system, user]``.

    ``context``: (query_id, context string); ``history``: (query_id, turn,
    role, content) -- history goes before the system message.
    """
    q = queries.select(query_id, text)
    if context is not None:
        q = q.join(context, query_id, "left")
    else:
        q = q.withColumn("context", F.lit(None).cast("string"))
    own = F.array(F.struct(F.lit("system").alias("role"), system_message(F.col("context")).alias("content")),
                  F.struct(F.lit("user").alias("role"), F.col(text).alias("content")))
    if history is not None:
        h = (history.groupBy(query_id)
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
                              lambda x: F.struct(x["role"].alias("role"),
                                                 x["content"].alias("content"))).alias("_h")))
        q = q.join(h, query_id, "left")
        msgs = F.concat(F.coalesce(F.col("_h"), F.array().cast("array<struct<role:string,content:string>>")), own)
    else:
        msgs = own
    return q.select(query_id, msgs.alias("messages"))


# --- QA store (S-5..S-7) ------------------------------------------------------

def write_corpus(qa: DataFrame, path: str, mode: str = "overwrite") -> dict[str, dict[str, int]]:
    """S-5/X-2: a new version of the store: one partition folder per group, and a
    manifest with each group's folders, rows and characters (A-8, counted from what was
    written). ``overwrite`` replaces all groups, ``append`` adds to them; earlier versions
    stay readable, and a write that fails changes nothing. Returns the counts by group."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode!r}")
    spark = qa.sparkSession
    now = read_manifest(spark, path)
    folder = new_folder(path, "data")
    qa.write.partitionBy("group").parquet(folder)
    groups = {} if mode == "overwrite" or now is None else dict(now[1]["groups"])
    added = _group_counts(spark.read.schema(qa.schema).parquet(folder))
    if None in added:
        raise ValueError("rows without a group cannot be stored")
    for name, counts in added.items():
        old = groups.get(name, {"folders": [], "rows": 0, "chars": 0})
        groups[name] = {"folders": [*old["folders"], folder], "rows": old["rows"] + counts["rows"],
                        "chars": old["chars"] + counts["chars"]}
    publish(spark, path, {"groups": groups, "schema": qa.schema.json()}, now[0] if now else 0)
    return {name: {k: g[k] for k in ("rows", "chars")} for name, g in groups.items()}


def _group_counts(stored: DataFrame) -> dict[str | None, dict[str, int]]:
    chars = F.lit(0)
    if "conversations" in stored.columns:
        chars = F.coalesce(F.aggregate("conversations", F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(
            F.length(m["content"]), F.lit(0))), F.lit(0))
    rows = stored.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum(chars).alias("chars")).collect()
    return {r["group"]: {"rows": int(r["rows"]), "chars": int(r["chars"])} for r in rows}


def corpus_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, dict]:
    """S-6/A-8: group -> folders, rows and characters, from the manifest alone; a
    missing store has no groups."""
    found = read_manifest(spark, path, version)
    return found[1]["groups"] if found else {}


def corpus_groups(spark: SparkSession, path: str) -> list[str]:
    """S-6: group names, from the manifest; a missing store -> []."""
    return sorted(corpus_manifest(spark, path))


def load_corpus(spark: SparkSession, path: str, *groups: str, version: int | None = None) -> DataFrame:
    """S-7/U-2: one or more groups of a version (the last if None), concatenated;
    unknown names raise. Only the groups' own folders are read."""
    if not groups:
        raise ValueError("name at least one group to load")
    found = read_manifest(spark, path, version)
    known = found[1]["groups"] if found else {}
    missing = [g for g in groups if g not in known]
    if missing:
        raise ValueError(f"no such group: {missing}; stored: {sorted(known)}")
    schema = T.StructType.fromJson(json.loads(found[1]["schema"]))
    wanted: dict[str, list[str]] = {}
    for g in dict.fromkeys(groups):
        for folder in known[g]["folders"]:
            wanted.setdefault(folder, []).append(g)
    parts = [spark.read.schema(schema).parquet(folder).where(F.col("group").isin(names)) for folder, names in wanted.items()]
    return reduce(DataFrame.unionByName, parts)


# Worker-side functions above travel by value (see ``ship_by_value``).
ship_by_value(__name__)
