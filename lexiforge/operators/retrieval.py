"""Hybrid retrieval over a document table (R-1..R-6, A-7, T-2, T-3, U-3, E-10,
P-12..P-14, S-9).

Plan choices, for a corpus far larger than the query batch:

* BM25 over a table, for a batch within a size bound: one job counts N, the
  total length and the batch tokens' document frequencies (a result as large as
  the batch's vocabulary), a second scores each document inside its own Arrow
  batch and keeps a running top-k per query, so tasks x queries x k rows move.
  Larger batches, and saved indexes, join tokens with postings.
* Dense: each vector partition scores its batches against tiles of the
  (size-checked) query matrix and keeps one running top-k per query. The work
  is exact, O(queries x vectors x dimensions); no query x document pairs are
  ever materialised as rows.
* Merge: union, first-source-wins dedupe per (query, doc), then top-k.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiforge.functions.predicates import compile_filters
from lexiforge.functions.text import WORD_TOKEN, explode_computed, split_lines, word_tokens
from lexiforge.operators.broadcast import bounded_broadcast
from lexiforge.session import ship_by_value
from lexiforge.schemas import (
    DEFAULT_TOP_K, DOC_LABELS, RESULT_CMC, RESULT_IDENTITY, RESULT_LOYALTY, RESULT_MANA,
    RESULT_RARITY, RESULT_SCORE,
)

# BM25L (Lv & Zhai, 2011) parameters; our stated definition.
K1, B, DELTA = 1.5, 0.75, 0.5
SCORE_DIGITS = 6
MAX_BROADCAST_QUERIES = 200_000
#: A batch of at most this many characters travels to the tasks as a token table.
MAX_BATCH_CHARS = 4_000_000
#: Scores held at once by a task while it scores one Arrow batch.
TILE_SCORES = 500_000
#: Tokens of documents that a task looks up at once.
SLICE_TOKENS = 250_000


@dataclass
class SearchIndex:
    """R-1: the tables a search needs; write with :func:`save_index`."""

    docs: DataFrame       # id, content, meta...
    postings: DataFrame   # token, id, tf, dl
    token_df: DataFrame   # token, df
    n_docs: int
    avg_len: float
    vectors: DataFrame | None = None  # id, embedding


def build_index(docs: DataFrame, id_col: str = "id", text_col: str = "content",
                vectors: DataFrame | None = None, persist: bool = False) -> SearchIndex:
    """R-1/A-7: postings (with document length), document frequencies and the
    two corpus scalars.

    Within one search plan the postings feed both the document frequencies
    and the scoring join; Spark reuses that exchange, so the corpus is
    tokenised once per plan. The scalars come from one narrow aggregate (no
    shuffle). With ``persist`` the postings and frequencies are written to the
    shared checkpoint folder first, for an index searched many times (or use
    :func:`save_index`).
    """
    from lexiforge.session import materialize
    toks = docs.select(F.col(id_col).alias("id"), word_tokens(F.col(text_col)).alias("_t"))
    postings = (toks.select("id", F.size("_t").alias("dl"), explode_computed("_t").alias("token"))
                .where(F.col("token").isNotNull())
                .groupBy("token", "id", "dl").agg(F.count(F.lit(1)).alias("tf")))
    if persist:
        postings = materialize(postings, "postings")
    token_df = document_frequencies(docs, text_col)
    if persist:
        token_df = materialize(token_df, "token_df")
    n, avg = corpus_stats(docs, text_col)
    return SearchIndex(docs, postings, token_df, n, avg, vectors)


def document_frequencies(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """A-7: (token, df) for every token. Each document contributes its
    distinct tokens, so the partial aggregate is keyed by token alone
    (vocabulary-sized per task), not by (token, document)."""
    return (docs.select(explode_computed(F.array_distinct(word_tokens(F.col(text_col)))).alias("token"))
            .where(F.col("token").isNotNull())
            .groupBy("token").agg(F.count(F.lit(1)).alias("df")))


def corpus_stats(docs: DataFrame, text_col: str = "content") -> tuple[int, float]:
    """(N, average length of documents with at least one token): one narrow
    aggregate, returned as two scalars."""
    dl = F.regexp_count(F.lower(F.col(text_col)), F.lit(WORD_TOKEN))
    row = docs.select(dl.alias("dl")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avg")).first()
    return int(row["n"]), float(row["avg"] or 0.0)


def corpus_statistics(docs: DataFrame, text_col: str = "content") -> tuple[int, float, DataFrame]:
    """A-7 in one pass over the texts: (N, average length of documents with a token,
    (token, df)). Every document adds a row without a token that carries its length; the
    counts, as large as the vocabulary, are written once."""
    from lexiforge.session import materialize
    d = docs.select(word_tokens(F.col(text_col)).alias("_t"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.coalesce(F.size("_t"), F.lit(0)).alias("dl")))
    toks = F.transform(F.coalesce(F.array_distinct("_t"), F.array().cast("array<string>")),
                       lambda t: F.struct(t.alias("token"), F.lit(0).alias("dl")))
    rows = d.select(explode_computed(F.concat(own, toks)).alias("_x")).select("_x.token", "_x.dl")
    counts = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total"),
                                                   F.count_if(F.col("dl") > 0).alias("filled")), "corpus-statistics")
    head = counts.where("token IS NULL").first()
    n, avg = (head["df"], head["total"] / head["filled"] if head["filled"] else 0.0) if head else (0, 0.0)
    return int(n), float(avg), counts.where("token IS NOT NULL").select("token", "df")


def idf(df: Column, n_docs: int) -> Column:
    return F.log((F.lit(n_docs) + 1.0) / (df + 0.5))


def bm25_candidates(index: SearchIndex, queries: DataFrame, query_id: str = "query_id",
                    text: str = "text") -> DataFrame:
    """R-2: (query_id, id, score) for every document sharing a query token.

    Repeated query tokens count once per occurrence (``qn``).
    """
    qt = _query_tokens(queries, query_id, text)
    # The size check runs on the query tokens alone (cheap); the join with
    # document frequencies only removes rows.
    _, small = bounded_broadcast(qt, MAX_BROADCAST_QUERIES * 64)
    qt = qt.join(index.token_df, "token", "inner")
    if small:
        qt = F.broadcast(qt)
    return (index.postings.join(qt, "token", "inner")
            .groupBy("query_id", "id").agg(F.sum(_bm25_part(index.n_docs, index.avg_len)).alias("score")))


def _query_tokens(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return (queries.select(F.col(query_id).alias("query_id"),
                           explode_computed(word_tokens(F.col(text))).alias("token"))
            .where(F.col("token").isNotNull())
            .groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qn")))


def _bm25_part(n_docs: int, avg_len: float) -> Column:
    c = F.col("tf") / (1 - B + B * F.col("dl") / F.lit(avg_len or 1.0))
    return F.col("qn") * idf(F.col("df"), n_docs) * (K1 + 1) * (c + DELTA) / (K1 + c + DELTA)


def bm25_scan_candidates(docs: DataFrame, queries: DataFrame, id_col: str = "id",
                         text_col: str = "content", query_id: str = "query_id",
                         text: str = "text") -> DataFrame:
    """R-2 without a prebuilt index, for a batch of any size: tokens of the
    documents that some query holds are counted per document, written, and
    joined with the query tokens by token. Document frequencies are counted
    over all documents, N and the average length by a plain aggregate.
    """
    from lexiforge.session import materialize
    qt = _query_tokens(queries, query_id, text)
    _, small = bounded_broadcast(qt, MAX_BROADCAST_QUERIES * 64)
    vocab = qt.select("token").distinct()
    if small:
        vocab = F.broadcast(vocab)
    n_docs, avg_len = corpus_stats(docs, text_col)
    toks = (docs.select(F.col(id_col).alias("id"), word_tokens(F.col(text_col)).alias("_t"))
            .withColumn("dl", F.size("_t")))
    hits = (toks.select("id", "dl", explode_computed("_t").alias("token"))
            .join(vocab, "token", "left_semi"))
    tf = materialize(hits.groupBy("token", "id", "dl").agg(F.count(F.lit(1)).alias("tf")), "bm25-hits")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    q = qt.join(df, "token", "inner")
    if small:
        q = F.broadcast(q)
    return (tf.join(q, "token", "inner")
            .groupBy("query_id", "id").agg(F.sum(_bm25_part(n_docs, avg_len)).alias("score")))


def _batch_statistics(docs: DataFrame, vocab: DataFrame, text_col: str) -> tuple[int, float, dict[str, int]]:
    """(N, average length, document frequency per batch token) in one job over
    all documents. Each document sends its distinct tokens and one null token
    that carries its length; tokens outside the batch stop at the broadcast
    join, so the aggregate holds at most one row per batch token and one more."""
    t = word_tokens(F.col(text_col))
    marked = F.concat(F.array_distinct(t), F.array(F.lit(None).cast("string")))
    # Length and tokens are computed below the explode, once per document.
    rows = (docs.select(F.size(t).alias("dl"), marked.alias("_m"))
            .select("dl", explode_computed("_m").alias("token"))
            .join(F.broadcast(vocab.withColumn("_in", F.lit(True))), "token", "left")
            .where(F.col("_in") | F.col("token").isNull())
            .groupBy("token").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.when(F.col("dl") > 0, F.col("dl"))).alias("len_sum"),
                                  F.count(F.when(F.col("dl") > 0, F.lit(1))).alias("len_docs"))
            .collect())
    total = next((r for r in rows if r["token"] is None), None)
    n_docs = int(total["n"]) if total else 0
    avg_len = total["len_sum"] / total["len_docs"] if total and total["len_docs"] else 0.0
    return n_docs, float(avg_len), {r["token"]: int(r["n"]) for r in rows if r["token"] is not None}


def _keep_top(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """First ``k`` per query number by score desc, then id."""
    order = np.lexsort((ids, -scores, q))
    qs = q[order]
    start = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]])
    rank = np.arange(len(qs)) - np.repeat(start, np.diff(np.r_[start, len(qs)]))
    keep = order[rank < k]
    return q[keep], ids[keep], scores[keep]


def _merge_top(best, new, k: int):
    return _keep_top(*(new if best is None else map(np.concatenate, zip(best, new))), k)


def token_slices(lengths: np.ndarray, max_tokens: int, max_rows: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of the runs that cover all rows, each of at most ``max_rows`` rows and
    ``max_tokens`` tokens; a longer document is a run of its own."""
    ends, a = np.cumsum(lengths, dtype=np.int64), 0
    while a < len(lengths):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + max_tokens, "right"))
        b = min(max(b, a + 1), a + max_rows)
        yield a, b - a
        a = b


def _bm25_topk_fn(vocab: list[str], weights: np.ndarray, first: np.ndarray, token_query: np.ndarray,
                  token_n: np.ndarray, qids: list, qid_type, avg_len: float, k: int):
    """Task body: ``first[t]:first[t + 1]`` are the entries of token ``t`` in
    ``token_query`` (query numbers) and ``token_n`` (its occurrences there). Batches are
    scored in slices of bounded tokens, so a task's memory does not grow with its batches."""
    words = pa.array(vocab, pa.string())

    def score(lists, ids):
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        pos = pc.index_in(lists.flatten(), value_set=words)
        hit = pos.is_valid().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lengths)), lengths)[hit]
        tok = pos.drop_null().to_numpy().astype(np.int64)
        key, tf = np.unique(doc * len(vocab) + tok, return_counts=True)
        if not len(key):
            return
        doc, tok = np.divmod(key, len(vocab))
        c = tf / (1 - B + B * lengths[doc] / (avg_len or 1.0))
        part = weights[tok] * (K1 + 1) * (c + DELTA) / (K1 + c + DELTA)
        fan = first[tok + 1] - first[tok]
        # whole documents per tile, TILE_SCORES scores or one document each
        ends = np.r_[np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)]
        total = np.cumsum(fan)[ends - 1]
        a = i = done = 0
        while i < len(ends):
            j = max(i, int(np.searchsorted(total, done + TILE_SCORES, "right")) - 1)
            f, b = fan[a:ends[j]], ends[j]
            row = np.repeat(np.arange(a, b), f)
            at = np.arange(f.sum()) + np.repeat(first[tok[a:b]] - (np.cumsum(f) - f), f)
            pair, inv = np.unique(doc[row] * len(qids) + token_query[at], return_inverse=True)
            s = np.bincount(inv, part[row] * token_n[at], len(pair))
            d, q = np.divmod(pair, len(qids))
            yield q, ids[d], np.floor(s * 10 ** SCORE_DIGITS + 0.5) / 10 ** SCORE_DIGITS
            a, i, done = b, j + 1, total[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            ids, lists = np.asarray(batch.column("id").to_pylist()), batch.column("_t")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for at, n in token_slices(lengths, SLICE_TOKENS, max(len(ids), 1)):
                for new in score(lists.slice(at, n), ids[at:at + n]):
                    best = _merge_top(best, new, k)
        if best is not None:
            q, ids, s = best
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids, qid_type).take(pa.array(q)), pa.array(ids.tolist(), id_type), pa.array(s)],
                names=["query_id", "id", "score"])
    return run


def top_k(cands: DataFrame, k: int, order: list[Column] | None = None,
          part: str = "query_id") -> DataFrame:
    """T-2/T-3: first ``k`` per query by rounded score desc, then id; adds
    ``rank`` (1-based). Scores are rounded first so ties break the same way
    in every engine."""
    cands = cands.withColumn("score", F.round("score", SCORE_DIGITS))
    order = order or [F.col("score").desc(), F.col("id").asc()]
    w = Window.partitionBy(part).orderBy(*order)
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filter_docs(index: SearchIndex, cands: DataFrame, filters: dict[str, Any] | None,
                fields: list[str]) -> DataFrame:
    """E-10: keep candidates whose document passes ``filters``. Corpus
    statistics were computed before, so they do not depend on the filter."""
    if not filters:
        return cands
    ok = index.docs.where(compile_filters(filters, fields)).select("id")
    return cands.join(ok, "id", "left_semi")


def bm25_search(index: SearchIndex, queries: DataFrame, k: int = DEFAULT_TOP_K,
                filters: dict[str, Any] | None = None, fields: list[str] | None = None,
                query_id: str = "query_id", text: str = "text") -> DataFrame:
    cands = bm25_candidates(index, queries, query_id, text)
    cands = filter_docs(index, cands, filters, fields or index.docs.columns)
    return top_k(cands, k)


def bm25_scan_search(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K,
                     filters: dict[str, Any] | None = None, fields: list[str] | None = None,
                     id_col: str = "id", text_col: str = "content", query_id: str = "query_id",
                     text: str = "text") -> DataFrame:
    """Top-k BM25 for one query batch straight from the document table.

    Statistics cover all documents; the filter is applied before scoring
    (E-10). Null query ids ask nothing; a document without an id counts in the
    statistics and is never returned. A batch of more than MAX_BATCH_CHARS
    characters goes through :func:`bm25_scan_candidates`, with equal results.
    """
    queries = queries.where(F.col(query_id).isNotNull())
    found = docs.where(F.col(id_col).isNotNull())
    if filters:
        found = found.where(compile_filters(filters, fields or docs.columns))
    chars = queries.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    if chars > MAX_BATCH_CHARS:
        cands = bm25_scan_candidates(docs, queries, id_col, text_col, query_id, text)
        return top_k(cands.join(found.select(F.col(id_col).alias("id")), "id", "left_semi"), k)
    qt = _query_tokens(queries, query_id, text)
    rows = sorted((r["token"], r["query_id"], r["qn"]) for r in qt.collect())
    spark = docs.sparkSession
    vocab = sorted({t for t, _, _ in rows})
    token_no = {t: i for i, t in enumerate(vocab)}
    qids = sorted({q for _, q, _ in rows})
    query_no = {q: i for i, q in enumerate(qids)}
    n_docs, avg_len, df = _batch_statistics(
        docs, spark.createDataFrame([(t,) for t in vocab], "token string"), text_col)
    counts = np.bincount([token_no[t] for t, _, _ in rows], minlength=len(vocab)) if rows else np.zeros(0, int)
    score = _bm25_topk_fn(
        vocab, np.array([math.log((n_docs + 1.0) / (df.get(t, 0) + 0.5)) for t in vocab]),
        np.r_[0, np.cumsum(counts)].astype(np.int64),
        np.array([query_no[q] for _, q, _ in rows], dtype=np.int64),
        np.array([n for _, _, n in rows], dtype=np.int64), qids,
        to_arrow_type(queries.schema[query_id].dataType), avg_len, k)
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType),
                           T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType())])
    local = (found.select(F.col(id_col).alias("id"), word_tokens(F.col(text_col)).alias("_t"))
             .mapInArrow(score, schema))
    return top_k(local, k)


# --- dense -------------------------------------------------------------------

def _dense_topk_fn(qids: np.ndarray, qmat: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            if pdf.empty:
                continue
            ids = np.asarray(pdf["id"].tolist())
            mat = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            kk = min(k, len(ids))
            tile = max(1, TILE_SCORES // len(ids))
            for j in range(0, len(qmat), tile):
                scores = np.round(qmat[j:j + tile] @ mat.T, SCORE_DIGITS)  # (queries, docs)
                # everything from the k-th score on, so ties go by id below
                kth = np.partition(scores, len(ids) - kk, axis=1)[:, len(ids) - kk]
                q, d = np.nonzero(scores >= kth[:, None])
                best = _merge_top(best, (q + j, ids[d], scores[q, d]), k)
        if best is not None:
            yield pd.DataFrame({"query_id": qids[best[0]], "id": best[1], "score": best[2]})
    return run


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K,
                 query_id: str = "query_id", embedding: str = "embedding",
                 id_col: str = "id", max_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """R-3: inner-product top-k per query, in double precision.

    The distinct queries are collected only within a count bound (they ride to
    the tasks); a larger batch is split by a hash of the whole row, so a
    repeated id splits too, and one ranking covers all slices.
    """
    spark = vectors.sparkSession
    # Rows without a vector have no dense results, on either side.
    vectors = (vectors.where(F.col(embedding).isNotNull())
               .select(F.col(id_col).alias("id"), F.col(embedding).alias("embedding")))
    queries = queries.where(F.col(embedding).isNotNull()).select(query_id, embedding).distinct()
    n = queries.count()
    qid_type = queries.schema[query_id].dataType.simpleString()
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"query_id {qid_type}, id {id_type}, score double"
    slices = 1 if n <= max_queries else -(-n // max_queries) * 2
    local = spark.createDataFrame([], schema)
    for i in range(slices):
        part = queries if slices == 1 else queries.where(
            F.pmod(F.xxhash64(query_id, embedding), F.lit(slices)) == i)
        rows = part.collect()
        if rows:
            qids = np.array([r[0] for r in rows])
            qmat = np.array([np.asarray(r[1], dtype=np.float64) for r in rows])
            local = local.unionByName(vectors.mapInPandas(_dense_topk_fn(qids, qmat, k), schema))
    return top_k(local, k)


# --- hybrid ------------------------------------------------------------------

def merge_results(first: DataFrame, second: DataFrame, k: int = DEFAULT_TOP_K,
                  names: tuple[str, str] = ("bm25", "embedding")) -> DataFrame:
    """U-3 + T-2: union two ranked lists; a document found by both keeps the
    first list's score; top ``k`` by score (ties: first list, then id).
    Each row is labelled with the retriever that actually produced it."""
    a = first.select("query_id", "id", "score", F.lit(0).alias("_src"))
    b = second.select("query_id", "id", "score", F.lit(1).alias("_src"))
    u = a.unionByName(b)
    w = Window.partitionBy("query_id", "id").orderBy("_src")
    u = u.withColumn("_d", F.row_number().over(w)).where(F.col("_d") == 1).drop("_d")
    out = top_k(u, k, [F.col("score").desc(), F.col("_src"), F.col("id")])
    return out.withColumn("retriever", F.when(F.col("_src") == 0, F.lit(names[0]))
                          .otherwise(F.lit(names[1]))).drop("_src")


def rrf_merge(first: DataFrame, second: DataFrame, k: int = DEFAULT_TOP_K,
              c: int = 60) -> DataFrame:
    """U-3, optional mode: reciprocal-rank fusion. Each list contributes
    ``1 / (c + rank)`` per document; scores are summed over the lists and the
    top ``k`` kept (ties by id). Inputs carry ``rank`` (as from :func:`top_k`).
    Per-(query, doc) sums are partial aggregates."""
    u = (first.select("query_id", "id", "rank").unionByName(second.select("query_id", "id", "rank"))
         .groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(c) + F.col("rank"))).alias("score")))
    return top_k(u, k).withColumn("retriever", F.lit("rrf"))


def hybrid_search(index: SearchIndex | None, queries: DataFrame, k: int = DEFAULT_TOP_K,
                  candidate_k: int = DEFAULT_TOP_K, filters: dict[str, Any] | None = None,
                  fields: list[str] | None = None, docs: DataFrame | None = None,
                  vectors: DataFrame | None = None) -> DataFrame:
    """R-5: BM25 and dense candidates (``candidate_k`` each), merged, top ``k``.

    ``queries``: (query_id, text, embedding). With a prebuilt ``index`` the
    lexical side reads its postings; with ``docs``/``vectors`` instead, one
    scan of the corpus serves the batch.
    """
    if index is not None:
        lex = bm25_search(index, queries, candidate_k, filters, fields)
        docs, vecs = index.docs, index.vectors
    else:
        lex = bm25_scan_search(docs, queries, candidate_k, filters, fields)
        vecs = vectors
    if filters:
        ok = docs.where(compile_filters(filters, fields or docs.columns)).select("id")
        vecs = vecs.join(ok, "id", "left_semi")
    den = dense_search(vecs, queries, candidate_k)
    return merge_results(lex, den, k)


# --- documents and rendering -------------------------------------------------

def _labelled(label: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(label), c))


def card_content(name: Column, mana_cost: Column, type_: Column, text: Column,
                 power: Column, toughness: Column, loyalty: Column, side: Column) -> Column:
    """P-12: the document text; null attributes are left out, lines in a fixed
    order. The full name is written (not the face name)."""
    pt = (F.when(power.isNotNull() & toughness.isNotNull(),
                 F.concat(F.lit(DOC_LABELS["pt"]), power, F.lit("/"), toughness))
          .when(power.isNotNull(), F.concat(F.lit(DOC_LABELS["power"]), power))
          .when(toughness.isNotNull(), F.concat(F.lit(DOC_LABELS["toughness"]), toughness)))
    return F.concat_ws("\n", _labelled(DOC_LABELS["name"], name),
                       _labelled(DOC_LABELS["mana_cost"], mana_cost),
                       _labelled(DOC_LABELS["type"], type_),
                       _labelled(DOC_LABELS["text"], text), pt,
                       _labelled(DOC_LABELS["loyalty"], loyalty),
                       _labelled(DOC_LABELS["side"], side))


def card_meta(name: Column, mana_cost: Column, cmc: Column, color_identity: Column,
              type_: Column, power: Column, toughness: Column, rarity: Column,
              loyalty: Column, side: Column) -> Column:
    """P-13: metadata struct; missing text -> ``""``, ``cmc`` as double
    (missing -> null)."""
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(e(name).alias("name"), e(mana_cost).alias("mana_cost"),
                    cmc.cast("double").alias("cmc"), e(color_identity).alias("color_identity"),
                    e(type_).alias("type"), e(power).alias("power"),
                    e(toughness).alias("toughness"), e(rarity).alias("rarity"),
                    e(loyalty).alias("loyalty"), e(side).alias("side"))


def card_documents(cards: DataFrame) -> DataFrame:
    """Card relation -> (id, content, meta)."""
    c = F.col
    return cards.select(
        c("uuid").alias("id"),
        card_content(c("name"), c("manaCost"), c("type"), c("text"), c("power"),
                     c("toughness"), c("loyalty"), c("side")).alias("content"),
        card_meta(c("name"), c("manaCost"), c("cmc"), c("colorIdentity"), c("type"),
                  c("power"), c("toughness"), c("rarity"), c("loyalty"), c("side")).alias("meta"))


def _not_blank(c: Column) -> Column:
    """Python's ``not s.isspace()``: the empty string counts as not blank."""
    return c.isNotNull() & ~c.rlike("^\\s+$")


def format_result(score: Column, content: Column, meta: Column) -> Column:
    """P-14: the text block for one search result.

    Score with two decimals (rounded half-up from the score rounded to six
    places), content lines, then mana cost, cmc as an integer, colour identity
    and rarity unless blank, loyalty if non-empty; a blank line ends the block.
    Empty content gives null (the source raises).
    """
    lines = F.concat(
        F.coalesce(split_lines(content), F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(_not_blank(meta["mana_cost"]), F.concat(F.lit(RESULT_MANA), meta["mana_cost"])),
            F.when(meta["cmc"].isNotNull(),
                   F.concat(F.lit(RESULT_CMC), meta["cmc"].cast("bigint").cast("string"))),
            F.when(_not_blank(meta["color_identity"]),
                   F.concat(F.lit(RESULT_IDENTITY), meta["color_identity"])),
            F.when(_not_blank(meta["rarity"]), F.concat(F.lit(RESULT_RARITY), meta["rarity"])),
            F.when(F.length(meta["loyalty"]) > 0, F.concat(F.lit(RESULT_LOYALTY), meta["loyalty"])),
        )))
    lines = F.when(F.size(lines) > 0, F.concat(lines, F.array(F.lit("\n")))).otherwise(lines)
    score2 = F.round(score, SCORE_DIGITS).cast("decimal(38,2)").cast("string")
    text = F.concat(F.lit(RESULT_SCORE), score2, F.lit("\n"), F.array_join(lines, "\n"))
    return F.when(F.coalesce(F.length(content), F.lit(0)) > 0, text)


def short_result(name: Column, score: Column) -> Column:
    """``name (0.00)``."""
    return F.concat(name, F.lit(" ("), F.round(score, SCORE_DIGITS).cast("decimal(38,2)").cast("string"),
                    F.lit(")"))


def context_per_query(formatted: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """R-6: formatted results joined by newlines in rank order (at most ``k``
    per query, so the collected list is bounded)."""
    return (formatted.groupBy("query_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "formatted"))),
                                          lambda x: x["formatted"]), "\n").alias("context")))


# --- persistence (S-9) ---------------------------------------------------------

_POINTER = "_current"


def save_index(index: SearchIndex, path: str, version: str) -> str:
    """Write every index table under ``path/v=<version>``, then switch the
    pointer. An earlier version stays readable until the pointer moves, and a
    failed write never touches it."""
    spark = index.docs.sparkSession
    root = f"{path.rstrip('/')}/v={version}"
    index.docs.write.mode("error").parquet(f"{root}/docs")
    index.postings.write.mode("error").parquet(f"{root}/postings")
    index.token_df.write.mode("error").parquet(f"{root}/token_df")
    if index.vectors is not None:
        index.vectors.write.mode("error").parquet(f"{root}/vectors")
    spark.createDataFrame([(index.n_docs, index.avg_len, version, index.vectors is not None)],
                          "n_docs long, avg_len double, version string, has_vectors boolean") \
        .write.mode("error").parquet(f"{root}/stats")
    spark.createDataFrame([(version,)], "version string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path.rstrip('/')}/{_POINTER}")
    return root


def load_index(spark: SparkSession, path: str) -> SearchIndex:
    """Read the version the pointer names; missing store -> FileNotFoundError."""
    try:
        version = spark.read.parquet(f"{path.rstrip('/')}/{_POINTER}").first()["version"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no search index at {path}") from e
    root = f"{path.rstrip('/')}/v={version}"
    stats = spark.read.parquet(f"{root}/stats").first()
    vectors = spark.read.parquet(f"{root}/vectors") if stats["has_vectors"] else None
    return SearchIndex(spark.read.parquet(f"{root}/docs"), spark.read.parquet(f"{root}/postings"),
                       spark.read.parquet(f"{root}/token_df"), int(stats["n_docs"]),
                       float(stats["avg_len"]), vectors)


# --- encoders (R-4) ------------------------------------------------------------

def encoder_udf(factory, dim: int):
    """Wrap ``factory() -> encode(list[str]) -> ndarray[n, dim]`` as an Arrow
    UDF. The model is built once per Python worker, not per row or batch."""
    state: dict[str, Any] = {}

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        if "enc" not in state:
            state["enc"] = factory()
        mat = np.asarray(state["enc"](texts.fillna("").tolist()), dtype=np.float32)
        return pd.Series(list(mat))

    return encode


def hashing_encoder(dim: int = 256):
    """Model-free encoder: hashed bag of word tokens, L2-normalised."""
    import re
    import zlib
    tok = re.compile(r"[^\W]{2,}")

    def build():
        def enc(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in tok.findall(t.lower()):
                    out[i, zlib.crc32(w.encode()) % dim] += 1.0
                norm = math.sqrt(float((out[i] ** 2).sum()))
                if norm:
                    out[i] /= norm
            return out
        return enc
    return build


# Worker-side functions above travel by value (see ``ship_by_value``).
ship_by_value(__name__)
