"""Corpus preparation (M-1..M-7), retrieval (R-1..R-6, U-3, T-2, P-12..P-14,
S-9) and fuzzy matching (J-4, T-1) against brute-force Python oracles."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions.predicates import compile_filters
from lexiforge.operators import corpus, retrieval
from lexiforge.operators.fuzzy import fuzzy_best_match, lcs_length, partial_ratio

TURNS = [(1, 0, "system", "Be brief."), (1, 1, "user", "What is [END OF COMBO] here?"),
         (1, 2, "assistant", "It marks the end."), (2, 0, "user", "Hi"), (3, 0, "user", "No answer")]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")


def test_chat_render(turns):
    r = {x.conv_id: x for x in corpus.render_turns(turns).collect()}
    assert r[1].text == ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nBe brief.<|eot_id|>"
                         "<|start_header_id|>user<|end_header_id|>\n\nWhat is [END OF COMBO] here?<|eot_id|>"
                         "<|start_header_id|>assistant<|end_header_id|>\n\nIt marks the end.<|eot_id|>")
    assert r[1].n_messages == 3


def test_render_messages_generation_prompt(spark):
    df = spark.createDataFrame([([("user", "q")],)], "m array<struct<role:string,content:string>>")
    got = df.select(corpus.render_messages(F.col("m"), add_generation_prompt=True)).first()[0]
    assert got.endswith("<|start_header_id|>assistant<|end_header_id|>\n\n")


def test_truncate_equals_whole_render(spark, turns):
    from lexiforge.functions.text import train_tokens
    whole = {r.conv_id: r for r in corpus.render_turns(turns)
             .select("conv_id", train_tokens("text").alias("t")).collect()}
    for L in (1, 5, 12, 1000):
        got = {r.conv_id: r for r in corpus.truncate_tokens(turns, L).collect()}
        for cid, w in whole.items():
            assert got[cid].n_tokens == len(w.t)
            assert got[cid].kept_text == " ".join(w.t[:L])
    assert "[END OF COMBO]" in whole[1].t          # marker stays one token (M-4)


def test_response_mask(spark, turns):
    m = {r.conv_id: r for r in corpus.response_mask_counts(turns).collect()}
    # assistant turn: "It marks the end." -> It, marks, the, end, "." + eot = 6
    assert m[1].n_trainable == 6 and m[2].n_trainable == 0 and m[3].n_trainable == 0
    labels = corpus.response_mask_labels(turns).where("conv_id = 1 and turn = 2").first()
    assert labels.labels.count(1) == 6 and labels.labels[:3] == [-100, -100, -100]


def test_hash_split_stable_and_grouped(spark):
    df = spark.range(0, 5000).select((F.col("id") % 700).alias("key"), F.col("id"))
    a = corpus.hash_split(df.repartition(3), "key")
    b = corpus.hash_split(df.repartition(17), "key")
    sa = {(r.id, r.split) for r in a.collect()}
    assert sa == {(r.id, r.split) for r in b.collect()}                 # partition-independent
    per_key = a.groupBy("key").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
    assert per_key == 0                                                 # a key never straddles
    frac = a.where("split = 'test'").select("key").distinct().count() / 700
    assert 0.12 < frac < 0.28


def test_pack_conserves_tokens(spark):
    rows = [(i, [f"t{i}_{j}" for j in range(n)]) for i, n in enumerate([0, 3, 10, 1, 25, 7, 7, 40])]
    docs = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    L = 8
    blocks = corpus.pack_blocks(docs, "toks", "doc_id", L, parts=3).collect()
    assert all(len(b.tokens) <= L for b in blocks)
    flat = Counter(t for b in blocks for t in b.tokens)
    want = Counter(t for _, ts in rows for t in ts)
    want["<|eot_id|>"] = len(rows)
    assert flat == want
    blocks.sort(key=lambda b: b.block)                 # only the last block may be partial
    assert [b.block for b in blocks] == list(range(len(blocks)))
    assert all(len(b.tokens) == L for b in blocks[:-1])


def test_prompt_messages(spark):
    q = spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id long, text string")
    ctx = spark.createDataFrame([(1, "ctx")], "query_id long, context string")
    hist = spark.createDataFrame([(1, 1, "assistant", "a0"), (1, 0, "user", "u0")],
                                 "query_id long, turn long, role string, content string")
    out = {r.query_id: r.messages for r in corpus.prompt_messages(q, ctx, hist).collect()}
    assert [m.role for m in out[1]] == ["user", "assistant", "system", "user"]  # history first
    assert out[1][2].content.endswith(".\n            Higher Relevancy Scores means that information is more "
                                      "relevant.\n            \n\relevant information:\nctx")
    assert [m.role for m in out[2]] == ["system", "user"] and "relevant information" not in out[2][0].content


# --- retrieval -----------------------------------------------------------------

DOCS = [(1, "Red fire bolt deals damage"), (2, "Blue water counters spells and spells"),
        (3, "Fire and water"), (4, ""), (5, "Bolt bolt bolt lightning")]
QUERIES = [(10, "fire bolt"), (11, "spells spells water"), (12, "nothing matches")]


def brute_bm25(docs, queries, k1=1.5, b=0.75, d=0.5):
    tok = lambda s: re.findall(r"[^\W]{2,}", s.lower())
    dt = {i: tok(t) for i, t in docs}
    n = len(docs)
    lens = [len(v) for v in dt.values() if v]
    avg = sum(lens) / len(lens)
    df = Counter(t for v in dt.values() for t in set(v))
    out = {}
    for qid, qt in queries:
        for did, toks in dt.items():
            tf = Counter(toks)
            s = 0.0
            for t, qn in Counter(tok(qt)).items():
                if tf[t]:
                    c = tf[t] / (1 - b + b * len(toks) / avg)
                    s += qn * math.log((n + 1) / (df[t] + 0.5)) * (k1 + 1) * (c + d) / (k1 + c + d)
            if s:
                out[(qid, did)] = round(s, 6)
    return out


@pytest.fixture
def index(spark):
    docs = spark.createDataFrame(DOCS, "id long, content string")
    vecs = spark.createDataFrame([(i, [float(i), 1.0, -float(i % 2)]) for i, _ in DOCS],
                                 "id long, embedding array<float>")
    return retrieval.build_index(docs, vectors=vecs)


def test_bm25_matches_brute_force(spark, index):
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = {(r.query_id, r.id): r.score for r in retrieval.bm25_search(index, q, k=10).collect()}
    assert got == pytest.approx(brute_bm25(DOCS, QUERIES))
    top1 = retrieval.bm25_search(index, q, k=1).collect()
    assert {r.query_id for r in top1} == {10, 11}


def test_dense_matches_numpy(spark, index):
    qv = spark.createDataFrame([(10, [1.0, 0.5, 2.0]), (11, [-1.0, 0.0, 0.0])],
                               "query_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.id) for r in retrieval.dense_search(index.vectors, qv, k=2).collect()]
    mat = np.array([[float(i), 1.0, -float(i % 2)] for i, _ in DOCS])
    want = []
    for qid, v in [(10, [1.0, 0.5, 2.0]), (11, [-1.0, 0.0, 0.0])]:
        s = np.round(mat @ np.array(v), 6)
        order = sorted(range(len(DOCS)), key=lambda j: (-s[j], DOCS[j][0]))[:2]
        want += [(qid, r + 1, DOCS[j][0]) for r, j in enumerate(order)]
    assert sorted(got) == sorted(want)


def test_merge_first_source_wins(spark):
    a = spark.createDataFrame([(1, 7, 2.0), (1, 8, 1.0)], "query_id long, id long, score double")
    b = spark.createDataFrame([(1, 7, 9.0), (1, 9, 2.0)], "query_id long, id long, score double")
    out = [(r.rank, r.id, r.score, r.retriever) for r in
           retrieval.merge_results(a, b, k=3).orderBy("rank").collect()]
    # doc 7 keeps its first-list score; the tie at 2.0 goes to the first list
    assert out == [(1, 7, 2.0, "bm25"), (2, 9, 2.0, "embedding"), (3, 8, 1.0, "bm25")]


def test_hybrid_and_filters(spark, index):
    q = spark.createDataFrame([(10, "fire bolt", [1.0, 0.5, 2.0])],
                              "query_id long, text string, embedding array<float>")
    docs = index.docs.withColumn("lang", F.when(F.col("id") == 5, "de").otherwise("en"))
    ix = retrieval.SearchIndex(docs, index.postings, index.token_df, index.n_docs, index.avg_len,
                               index.vectors)
    res = retrieval.hybrid_search(ix, q, k=3, candidate_k=2, filters={"lang": "en"})
    assert 5 not in {r.id for r in res.collect()}
    assert res.count() == 3


def test_format_result(spark):
    meta = ("Knight", "", 3.0, "W", "Creature", "2", "2", "", "", "a")
    df = spark.createDataFrame([(2.675, "Card Name: Knight\nType: Creature", meta),
                                (1.0, "", meta)],
                               f"score double, content string, meta struct<{', '.join(f'{f}:{t}' for f, t in zip(['name','mana_cost','cmc','color_identity','type','power','toughness','rarity','loyalty','side'], ['string','string','double']+['string']*7))}>")
    got = [r[0] for r in df.select(retrieval.format_result(F.col("score"), F.col("content"), F.col("meta"))).collect()]
    # row 23: an empty (not blank) mana cost and rarity are printed, empty
    # loyalty is skipped; 2.675 rounds half-up to 2.68
    assert got[0] == ("Relevancy Score: 2.68\nCard Name: Knight\nType: Creature\nMana Cost: \n"
                      "Coverted Mana Cost (cmc): 3\nColor Identity: W\nRarity: \n\n")
    assert got[1] is None


def test_index_save_load(spark, index, tmp_dir):
    retrieval.save_index(index, f"{tmp_dir}/ix", "1")
    back = retrieval.load_index(spark, f"{tmp_dir}/ix")
    assert back.n_docs == index.n_docs and back.postings.count() == index.postings.count()
    with pytest.raises(FileNotFoundError):
        retrieval.load_index(spark, f"{tmp_dir}/nothing")


def test_hashing_encoder(spark):
    enc = retrieval.encoder_udf(retrieval.hashing_encoder(16), 16)
    df = spark.createDataFrame([("fire bolt",), ("",)], "t string")
    v = [r[0] for r in df.select(enc("t")).collect()]
    assert len(v[0]) == 16 and abs(sum(x * x for x in v[0]) - 1) < 1e-5 and sum(v[1]) == 0


# --- fuzzy ---------------------------------------------------------------------

def lcs_dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def ratio_brute(q, n):
    s, t = (q, n) if len(q) <= len(n) else (n, q)
    m = len(s)
    if m == 0:
        return 0.0
    best = 0.0
    for i in range(-(m - 1), len(t)):
        w = t[max(i, 0):min(i + m, len(t))]
        best = max(best, 200.0 * lcs_dp(s, w) / (m + len(w)))
    return best


def test_lcs_and_ratio_against_dp():
    rng = np.random.default_rng(7)
    alphabet = list("abcde ")
    for _ in range(300):
        a = "".join(rng.choice(alphabet, rng.integers(0, 9)))
        b = "".join(rng.choice(alphabet, rng.integers(0, 12)))
        assert lcs_length(a, b) == lcs_dp(a, b)
        assert partial_ratio(a, b) == pytest.approx(ratio_brute(a, b)) or (a and a in b)


def test_fuzzy_best_match_against_brute_force(spark):
    # row 26: query contained in a name, equal lengths, tie between two keys
    names = [(1, "Lightning Bolt"), (2, "Lightning Helix"), (3, "Bolt"), (4, "Bolt"),
             (5, "Counterspell"), (6, None), (7, "Llanowar Elves")]
    queries = [(100, "Bolt"), (101, "Lightnin Bolt"), (102, "Cuonterspel"), (103, "Elvish"), (104, "")]
    ndf = spark.createDataFrame(names, "uuid long, name string").repartition(3)
    qdf = spark.createDataFrame(queries, "query_id long, text string")
    got = {r.query_id: (r.match_key, r.score) for r in fuzzy_best_match(ndf, qdf).collect()}
    for qid, q in queries:
        if not q:
            assert qid not in got
            continue
        scored = [(ratio_brute(q, n), k) for k, n in names if n is not None]
        best = max(s for s, _ in scored)
        key = min(k for s, k in scored if s == best)
        assert got[qid] == (key, pytest.approx(round(best, 6)))
    assert got[100][0] == 1                                # contained in a longer name: 100, lowest key


def test_rrf_merge(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id long, id long, rank int")
    out = [(r.rank, r.id) for r in retrieval.rrf_merge(a, b, k=3).orderBy("rank").collect()]
    assert out == [(1, 8), (2, 7), (3, 9)]      # 8 is in both lists


def test_index_versions_switch_pointer(spark, index, tmp_dir):
    retrieval.save_index(index, f"{tmp_dir}/ix", "1")
    smaller = retrieval.SearchIndex(index.docs.limit(2), index.postings.limit(3), index.token_df,
                                    2, index.avg_len, None)
    retrieval.save_index(smaller, f"{tmp_dir}/ix", "2")
    assert retrieval.load_index(spark, f"{tmp_dir}/ix").n_docs == 2
    old = spark.read.parquet(f"{tmp_dir}/ix/v=1/docs")          # earlier version stays readable
    assert old.count() == len(DOCS)
    with pytest.raises(Exception):
        retrieval.save_index(index, f"{tmp_dir}/ix", "2")        # a version is never overwritten


def test_query_batches_over_the_bound_are_sliced(spark, index):
    qv = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.5]) for i in range(7)],
                               "query_id long, embedding array<float>")
    whole = {(r.query_id, r.rank, r.id) for r in retrieval.dense_search(index.vectors, qv, k=2).collect()}
    sliced = {(r.query_id, r.rank, r.id) for r in
              retrieval.dense_search(index.vectors, qv, k=2, max_queries=3).collect()}
    assert sliced == whole and len({q for q, _, _ in whole}) == 7


def test_fuzzy_slices_over_the_bound(spark, monkeypatch):
    from lexiforge.operators import fuzzy
    names = spark.createDataFrame([(1, "Bolt"), (2, "Helix"), (3, "Shock")], "uuid long, name string")
    qs = spark.createDataFrame([(i, t) for i, t in enumerate(["bolt", "Helx", "Shok", "Bolt"])],
                               "query_id long, text string")
    whole = {tuple(r) for r in fuzzy.fuzzy_best_match(names, qs).collect()}
    monkeypatch.setattr(fuzzy, "MAX_QUERIES", 1)
    assert {tuple(r) for r in fuzzy.fuzzy_best_match(names, qs).collect()} == whole


def test_filters_on_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, a string")

    def ids(f):
        return sorted(r[0] for r in df.where(compile_filters(f, ["a"])).select("id").collect())

    assert ids({"a": "y"}) == [2]
    assert ids({"$not": {"a": "y"}}) == [1]
    assert ids({"a": None}) == [3]
    assert ids({"$not": {"a": None}}) == [1, 2]
    assert ids({"$or": [{"a": "y"}, {"a": None}]}) == [2, 3]


def test_dense_search_without_vectors_on_some_rows(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    got = retrieval.dense_search(vectors, queries, 2).select("query_id", "id", "rank").collect()
    assert sorted(map(tuple, got)) == [(7, 1, 1), (7, 3, 2)]


def test_truncate_counts_repeated_turns_once(spark):
    row = (1, 0, "user", "one two three")
    one = spark.createDataFrame([row], "conv_id long, turn long, role string, text string")
    n1 = corpus.truncate_tokens(one, 100).first()
    n2 = corpus.truncate_tokens(one.unionAll(one), 100).first()
    begin = 1
    assert n2["n_tokens"] == 2 * (n1["n_tokens"] - begin) + begin == n2["n_kept"]
