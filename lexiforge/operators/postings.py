"""A stored lexical index that prunes (R-1, R-2, S-9, T-3, A-7).

**Build.** One narrow pass over the documents, without a shuffle: a task cuts its
documents into shards of at most ``SHARD_DOCS`` documents and writes each shard's
postings sorted by token, in blocks of ``BLOCK`` documents. A block states the largest
term frequency and the least document length in it, from which a bound of its scores
follows for any corpus statistics. Row groups are small, so a search for a few
tokens skips the others (the filter on ``token`` reaches the scan).

**Segments.** An index is a list of such passes under a manifest (``versions``).
Adding documents writes one more segment and publishes the next version;
document counts, lengths and frequencies are summed over segments, so an index grown in
steps answers as one that was built at once.

**Search.** The batch's tokens go to all tasks (within a size bound, else the batch is
cut into slices); their blocks are dealt by shard, so a posting moves once,
whatever the number of queries, and no (query, document) pair is shuffled. A shard is
searched term at a time with upper bounds (MaxScore): terms in falling order of
their bound, and a block is passed over unread if the best partial score in its range,
its own bound and the bounds of the terms to come cannot reach the k-th best score
known, which is carried from shard to shard. Scores and ties are those of
``bm25_scan_search``; each task sends at most k rows per query.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiforge.functions.predicates import compile_filters
from lexiforge.functions.text import word_tokens
from lexiforge.operators.retrieval import (
    B, DELTA, K1, MAX_BATCH_CHARS, SCORE_DIGITS, _query_tokens, format_result, token_slices, top_k,
)
from lexiforge.schemas import DEFAULT_TOP_K
from lexiforge.session import materialize, ship_by_value
from lexiforge.versions import new_folder, publish, read_manifest

SHARD_DOCS = 16_384
SHARD_TOKENS = 2_000_000
#: Tokens that are counted at once while a shard is gathered.
SLICE_TOKENS = 250_000
BLOCK = 512
ROW_GROUP_BYTES = 1 << 20
#: Scores are compared after rounding; bounds leave this much room.
SLACK = 2 * 10.0 ** -SCORE_DIGITS


@dataclass(frozen=True)
class TextIndex:
    """A version of a stored index."""

    docs: DataFrame       # id, content, and all other columns of the documents
    lists: DataFrame      # seg, shard, token, ... : one row per block, and one per shard with token ""
    n_docs: int
    avg_len: float
    path: str
    version: int


def _lists_schema(id_type: str) -> str:
    return (f"shard long, token string, block int, n int, first int, last int, max_tf int, min_len int, "
            f"docs binary, tfs binary, ids array<{id_type}>, lens binary")


def _shard_rows(shard: int, ids: list, lens: np.ndarray, tokens: list[str], code: np.ndarray, doc: np.ndarray, tf: np.ndarray,
                id_type: pa.DataType, block: int) -> Iterator[pa.RecordBatch]:
    """The shard's own row, then its blocks by token."""
    names = ["shard", "token", "block", "n", "first", "last", "max_tf", "min_len", "docs", "tfs", "ids", "lens"]
    i32 = pa.int32()
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.array([""]), *[pa.array([v], i32) for v in (0, len(ids), 0, len(ids) - 1, 0, 0)],
         pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([ids], pa.list_(id_type)),
         pa.array([lens.astype("<i4").tobytes()])], names)
    order = sorted(range(len(tokens)), key=tokens.__getitem__)
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.arange(len(tokens))
    rank = rank.astype(np.int32)[code]
    by = np.argsort((rank.astype(np.int64) << 32) | doc)
    rank, doc, tf = rank[by], doc[by].astype("<i4", copy=False), tf[by].astype("<i4", copy=False)
    del by
    token_start = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
    within = np.arange(len(rank)) - np.repeat(token_start, np.diff(np.r_[token_start, len(rank)]))
    start = np.flatnonzero(within % block == 0)
    if not len(start):
        return
    stop = np.r_[start[1:], len(rank)]
    max_tf, min_len = np.maximum.reduceat(tf, start), np.minimum.reduceat(lens[doc], start)
    for a in range(0, len(start), 4096):
        s, e = start[a:a + 4096], stop[a:a + 4096]
        m = len(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, shard)), pa.array([tokens[order[r]] for r in rank[s].tolist()]),
             pa.array((within[s] // block).astype(np.int32)), pa.array((e - s).astype(np.int32)),
             pa.array(doc[s]), pa.array(doc[e - 1]), pa.array(max_tf[a:a + 4096].astype(np.int32)),
             pa.array(min_len[a:a + 4096].astype(np.int32)),
             pa.array([doc[x:y].tobytes() for x, y in zip(s, e)]), pa.array([tf[x:y].tobytes() for x, y in zip(s, e)]),
             pa.nulls(m, pa.list_(id_type)), pa.nulls(m, pa.binary())], names)


def _build_fn(id_type: pa.DataType, shard_docs: int, shard_tokens: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        vocab: dict[str, int] = {}
        ids, lens, rows, held = [], [], [], 0

        def shard():
            code, doc, tf = (np.concatenate(x) if rows else np.zeros(0, np.int32) for x in
                             (zip(*rows) if rows else ([], [], [])))
            rows.clear()
            yield from _shard_rows((part << 24) + seq, ids, np.concatenate(lens), list(vocab), code, doc, tf, id_type, block)

        for batch in batches:
            lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for at, count in token_slices(lengths, SLICE_TOKENS, min(1024, shard_docs)):
                b = batch.slice(at, count)
                lists = b.column(1)
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if ids and (len(ids) + b.num_rows > shard_docs or held + n.sum() > shard_tokens):
                    yield from shard()
                    vocab, ids, lens, rows, held, seq = {}, [], [], [], 0, seq + 1
                flat = lists.flatten().dictionary_encode()
                own = np.array([vocab.setdefault(t, len(vocab)) for t in flat.dictionary.to_pylist()], np.int64)
                if len(flat):
                    local = own[flat.indices.to_numpy()]
                    key, tf = np.unique((np.repeat(np.arange(b.num_rows), n) << 32) + local, return_counts=True)
                    rows.append(((key & 0xFFFFFFFF).astype(np.int32), ((key >> 32) + len(ids)).astype(np.int32), tf.astype(np.int32)))
                ids += b.column(0).to_pylist()
                lens.append(n)
                held += int(n.sum())
        if ids:
            yield from shard()
    return run


def add_documents(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "id", text_col: str = "content",
                  shard_docs: int = SHARD_DOCS, block: int = BLOCK) -> int:
    """R-1: write ``docs`` as a further segment of the index at ``path`` (created if
    there is none) and publish the next version; returns it. Null texts have no
    tokens; each row is a document, also where ids repeat."""
    now = read_manifest(spark, path)
    segments = now[1]["segments"] if now else []
    folder = new_folder(path, "segment")
    docs.withColumn("id", F.col(id_col)).withColumn("content", F.col(text_col)).write.parquet(f"{folder}/docs")
    stored = spark.read.parquet(f"{folder}/docs")
    kind = stored.schema["id"].dataType
    rows = stored.select("id", word_tokens("content").alias("tokens"))
    lists = rows.mapInArrow(_build_fn(to_arrow_type(kind), shard_docs, SHARD_TOKENS, block), _lists_schema(kind.simpleString()))
    lists.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/lists")
    lengths = spark.read.parquet(f"{folder}/lists").where("token = ''").select("n", "lens").mapInArrow(
        _sum_lengths, "docs long, total long, some long")
    s = lengths.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"), F.sum("some").alias("some")).first()
    segment = {"path": folder, "docs": s["docs"] or 0, "total": s["total"] or 0, "some": s["some"] or 0}
    return publish(spark, path, {"segments": [*segments, segment]}, now[0] if now else 0)


def _sum_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lens = [np.frombuffer(x, "<i4") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in lens], pa.int64()),
                                          pa.array([int(x.sum()) for x in lens], pa.int64()),
                                          pa.array([int((x > 0).sum()) for x in lens], pa.int64())], ["docs", "total", "some"])


def load_text_index(spark: SparkSession, path: str, version: int | None = None) -> TextIndex:
    """S-9: a version of the index (the last if None); FileNotFoundError without one."""
    found = read_manifest(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no search index at {path}")
    version, manifest = found
    docs = lists = None
    for i, s in enumerate(manifest["segments"]):
        d = spark.read.parquet(f"{s['path']}/docs")
        x = spark.read.parquet(f"{s['path']}/lists").select(F.lit(i).alias("seg"), "*")
        docs, lists = (d, x) if docs is None else (docs.unionByName(d, allowMissingColumns=True), lists.unionByName(x))
    some = sum(s["some"] for s in manifest["segments"])
    return TextIndex(docs, lists, sum(s["docs"] for s in manifest["segments"]),
                     sum(s["total"] for s in manifest["segments"]) / some if some else 0.0, path, version)


# --- search --------------------------------------------------------------------

def _part(tf: np.ndarray, length: np.ndarray, avg_len: float) -> np.ndarray:
    c = tf / (1 - B + B * length / (avg_len or 1.0))
    return (K1 + 1) * (c + DELTA) / (K1 + c + DELTA)


class Shard:
    """The blocks of one shard that a batch needs."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, allowed: np.ndarray | None, avg_len: float):
        self.ids, self.lens, self.avg_len, self.allowed = ids, lens, avg_len, allowed
        self.blocks: dict[str, list[tuple]] = {}
        self.read = self.skipped = 0

    def add(self, token: str, first: int, last: int, max_tf: int, min_len: int, docs: bytes, tfs: bytes) -> None:
        self.blocks.setdefault(token, []).append((first, last, max_tf, min_len, docs, tfs))

    def finish(self) -> None:
        """Bounds of all blocks, by token; documents are read when a query needs them."""
        self.terms = {}
        for token, rows in self.blocks.items():
            first, last, max_tf, min_len = (np.array(x, np.int64) for x in zip(*[r[:4] for r in rows]))
            self.terms[token] = (first, last, _part(max_tf, min_len, self.avg_len), rows)

    def search(self, query: list[tuple[str, float]], k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, rounded scores) of all documents that may be among the best ``k``, given
        that ``k`` documents elsewhere score ``threshold`` or more (-inf: unknown)."""
        terms = [(w, *self.terms[t]) for t, w in query if t in self.terms]
        terms.sort(key=lambda x: -x[0] * x[3].max())
        rest = np.cumsum([0.0] + [w * bound.max() for w, _, _, bound, _ in reversed(terms)])[::-1]
        score = np.zeros(len(self.lens)) if self.allowed is None else np.where(self.allowed, 0.0, -np.inf)
        for i, (w, first, last, bound, rows) in enumerate(terms):
            if threshold > -np.inf:
                edges = np.empty(2 * len(first), np.int64)
                edges[0::2], edges[1::2] = first, np.minimum(last + 1, len(score) - 1)
                top = np.maximum.reduceat(score, edges)[0::2]
                top = np.maximum(top, score[last])
                need = np.flatnonzero(top + w * bound + rest[i + 1] >= threshold - SLACK).tolist()
            else:
                need = range(len(rows))
            for j in need:
                doc = np.frombuffer(rows[j][4], "<i4")
                score[doc] += w * _part(np.frombuffer(rows[j][5], "<i4"), self.lens[doc], self.avg_len)
            self.read += len(need)
            self.skipped += len(rows) - len(need)
            if len(score) >= k:
                threshold = max(threshold, float(np.partition(score, len(score) - k)[len(score) - k]))
                threshold = threshold if threshold > 0 else -np.inf
        hit = np.flatnonzero((score > 0) & (score >= threshold - SLACK))
        return self.ids[hit], np.floor(score[hit] * 10 ** SCORE_DIGITS + 0.5) / 10 ** SCORE_DIGITS


def _search_fn(queries: list[tuple[Any, list[tuple[str, float]]]], qid_type, id_type, avg_len: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(queries)
        now, shard = None, None

        def searched():
            shard.finish()
            for q, (_, tokens) in enumerate(queries):
                old = best[q]
                ids, s = shard.search(tokens, k, old[1][k - 1] if old is not None and len(old[1]) == k else -np.inf)
                if len(ids):
                    if old is not None:
                        ids, s = np.concatenate([old[0], ids]), np.concatenate([old[1], s])
                    order = np.lexsort((ids, -s))[:k]
                    best[q] = ids[order], s[order]

        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("seg", "shard", "token", "first", "last", "max_tf", "min_len", "docs", "tfs")}
            for i in range(batch.num_rows):
                key = (c["seg"][i], c["shard"][i])
                if key != now:
                    if shard is not None:
                        searched()
                    now = key
                    lens = np.frombuffer(batch.column("lens")[i].as_py(), "<i4")
                    allowed = batch.column("allowed")[i]
                    mask = None
                    if batch.column("filtered")[i].as_py():
                        mask = np.zeros(len(lens), bool)
                        mask[np.array(allowed.as_py() or [], np.int64)] = True
                    shard = Shard(np.asarray(batch.column("ids")[i].as_py()), lens, mask, avg_len)
                else:
                    shard.add(c["token"][i], c["first"][i], c["last"][i], c["max_tf"][i], c["min_len"][i], c["docs"][i], c["tfs"][i])
        if shard is not None:
            searched()
        for q, found in enumerate(best):
            if found is not None:
                n = len(found[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([queries[q][0]] * n, qid_type), pa.array(found[0].tolist(), id_type), pa.array(found[1])],
                    ["query_id", "id", "score"])
    return run


def _allowed(index: TextIndex, filters: dict[str, Any], fields: list[str]) -> DataFrame:
    """(seg, shard, allowed): the places of the documents that pass the filters."""
    places = index.lists.where("token = ''").select("seg", "shard", F.posexplode("ids").alias("place", "id"))
    ok = index.docs.where(compile_filters(filters, fields)).select("id").distinct()
    return places.join(ok, "id", "left_semi").groupBy("seg", "shard").agg(F.collect_list("place").alias("allowed"))


def search_index(index: TextIndex, queries: DataFrame, k: int = DEFAULT_TOP_K, filters: dict[str, Any] | None = None,
                 fields: list[str] | None = None, query_id: str = "query_id", text: str = "text",
                 max_batch_chars: int = MAX_BATCH_CHARS) -> DataFrame:
    """R-2/T-3: (query_id, rank, id, score), the best ``k`` documents of each query.
    Statistics cover all documents, whatever the filters (E-10); repeated query tokens count
    once per occurrence. Batches beyond ``max_batch_chars`` are searched in slices."""
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text"))
    size = q.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = 1 if size <= max_batch_chars else 2 * -(-size // max_batch_chars)
    id_kind = index.lists.schema["ids"].dataType.elementType
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {id_kind.simpleString()}, score double"
    out = spark.createDataFrame([], schema)
    allowed = None if not filters else materialize(_allowed(index, filters, fields or index.docs.columns), "index-allowed")
    for i in range(slices):
        part = q if slices == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        tokens = _query_tokens(part, "query_id", "text").collect()
        vocab = sorted({r["token"] for r in tokens})
        if not vocab:
            continue
        if len(vocab) <= 1000:      # reaches the scan, where sorted row groups are skipped
            mine = index.lists.where(F.col("token").isin(["", *vocab]))
        else:
            mine = index.lists.join(F.broadcast(spark.createDataFrame([(t,) for t in ["", *vocab]], "token string")), "token")
        df = {r["token"]: r["n"] for r in mine.where("token != ''").groupBy("token").agg(F.sum("n").alias("n")).collect()}
        weights: dict[Any, list[tuple[str, float]]] = {}
        for r in sorted(tokens, key=lambda r: r["token"]):
            if r["token"] in df:
                weights.setdefault(r["query_id"], []).append(
                    (r["token"], r["qn"] * float(np.log((index.n_docs + 1.0) / (df[r["token"]] + 0.5)))))
        if not weights:
            continue
        rows = mine.withColumn("filtered", F.lit(allowed is not None))
        if allowed is None:
            rows = rows.withColumn("allowed", F.lit(None).cast("array<int>"))
        else:
            own = rows.where("token = ''").join(allowed, ["seg", "shard"], "left")
            rows = rows.where("token != ''").withColumn("allowed", F.lit(None).cast("array<int>")).unionByName(own)
        rows = rows.repartition("seg", "shard").sortWithinPartitions("seg", "shard", "token", "block")
        out = out.unionByName(rows.mapInArrow(
            _search_fn(list(weights.items()), to_arrow_type(q.schema["query_id"].dataType), to_arrow_type(id_kind),
                       index.avg_len, k), schema))
    return top_k(out, k)


def search_results(index: TextIndex, queries: DataFrame, k: int = DEFAULT_TOP_K, filters: dict[str, Any] | None = None,
                   fields: list[str] | None = None, **options) -> DataFrame:
    """R-5, P-14 over the stored index: (query_id, rank, id, score, name, content, meta,
    formatted) of the best ``k`` documents of each query of a table. The results (queries
    times ``k`` rows) go to the documents, so texts that no query returns are not moved."""
    found = materialize(search_index(index, queries, k, filters, fields, **options), "index-results")
    small = F.broadcast(found) if found.count() <= 200_000 else found
    return index.docs.select("id", "content", "meta").join(small, "id").select(
        "query_id", "rank", "id", "score", F.col("meta.name").alias("name"), "content", "meta",
        format_result(F.col("score"), F.col("content"), F.col("meta")).alias("formatted"))


# Worker-side functions above travel by value (see ``ship_by_value``).
ship_by_value(__name__)
