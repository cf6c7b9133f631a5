"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the whole driver tables. Output columns are flat scalars, named the same
as in the matching SQL of ``lexiforge.plans.oracle``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import codes, predicates as P, text as X
from lexiforge.operators import batches, cells, corpus, lookup, postings, qa, retrieval
from lexiforge.operators.canonical import aggregate_rulings
from lexiforge.operators.fuzzy import fuzzy_best_match
from lexiforge.operators.nest import nest_combos
from lexiforge.plans import analogs as A
from lexiforge.schemas import MARKERS
from lexiforge.session import ensure_checkpoint_dir
from lexiforge.versions import new_folder

MAX_SEQ_LEN = 1024        # sequence length of the smaller training recipes
TOP_K = 10
SEARCH_FILTERS = {"lang": ["en", "de"], "n_chars": {"$lte": 20000}}


def q_canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.canonical(spark, d).select(*A.CANONICAL_OUT)


def q_string_agg(spark: SparkSession, d: str) -> DataFrame:
    r = A.rulings(spark, d)
    counts = r.groupBy("uuid").agg(F.count(F.lit(1)).cast("bigint").alias("n_rulings"))
    return aggregate_rulings(r).join(counts, "uuid").select("uuid", "n_rulings", "rulings")


def q_typed_numeric(spark: SparkSession, d: str) -> DataFrame:
    p = A.printings(spark, d)
    return p.select("uuid", "manaValue",
                    codes.float_text_to_int("manaValue").alias("cmc"),
                    codes.is_fractional_text("manaValue").alias("bad_numeric"))


def q_normalize_codes(spark: SparkSession, d: str) -> DataFrame:
    p = A.printings(spark, d)
    return p.select(
        "uuid", "colors",
        codes.strip_commas("colors").alias("stripped"),
        codes.strip_brackets("manaCost").alias("mana_plain"),
        codes.normalize_color_code("colorIdentity").alias("identity"),
        codes.color_list_delimited("colors").alias("colors_pipe"),
        codes.color_list_delimited("colors", compat=True).alias("colors_pipe_compat"))


def q_identity_name(spark: SparkSession, d: str) -> DataFrame:
    p = A.printings(spark, d).select("uuid", codes.normalize_color_code("colorIdentity").alias("identity"))
    return p.select("uuid", "identity",
                    codes.identity_name("identity").alias("identity_name"),
                    codes.identity_name("identity", compat=True).alias("identity_name_compat"))


def q_face_name(spark: SparkSession, d: str) -> DataFrame:
    p = A.printings(spark, d)
    return p.select("uuid", "name", "side", X.face_name("name", "side").alias("face_name"))


def q_ordinal_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").select("doc_id", X.split_lines("text").alias("lines"))
    return docs.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        X.number_lines("lines", start=0).alias("rulings_form"),
        X.number_lines("lines", start=1, indent="  ").alias("steps_form"))


def q_null_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    v = (F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string"))
          .when(F.col("p_size") % 3 == 1, F.lit("")).otherwise(F.col("p_type")))
    t = p.select(F.col("p_partkey").alias("uuid"), v.alias("value"))
    return t.select("uuid", "value",
                    F.col("value").isNull().alias("is_null"),
                    F.col("value").isNotNull().alias("is_not_null"),
                    P.not_empty_keep_null("value").alias("ne_keep_null"),
                    P.not_empty_sql("value").alias("ne_sql"))


def q_lookup_by_key(spark: SparkSession, d: str) -> DataFrame:
    cards = A.cards(spark, d, persist=True, with_rulings=False).select("uuid", "name", "cmc")
    li = A.table(spark, d, "lineitem")
    by_id_req = li.select(F.col("l_partkey").alias("req")).distinct()
    by_id = lookup.cards_by_ids(cards, by_id_req, "req").select(
        F.lit("by_id").alias("lookup"), F.col("req").cast("string").alias("request"), "uuid", "name")
    names = A.printings(spark, d).select(F.col("name").alias("req")).distinct()
    by_name = lookup.first_by_name(cards, names, "req").select(
        F.lit("by_name").alias("lookup"), F.col("req").alias("request"), "uuid", "name")
    qty = li.select(F.col("l_quantity").cast("int").alias("req")).distinct()
    by_cmc = qty.join(cards, qty.req == cards.cmc, "inner").select(
        F.lit("by_cmc").alias("lookup"), F.col("req").cast("string").alias("request"), "uuid", "name")
    return by_id.unionByName(by_name).unionByName(by_cmc)


CODE_SEARCHES = [("identity", "WU"), ("identity", "WB"), ("identity", "G"),
                 ("mana_cost", "{2}{W}"), ("mana_cost", "{0}"),
                 ("color", "White"), ("color", "u")]


def q_code_contains(spark: SparkSession, d: str) -> DataFrame:
    pred = {"identity": lookup.identity_predicate, "mana_cost": lookup.mana_cost_predicate,
            "color": lookup.color_predicate}
    searches = [({"search": kind, "term": term}, pred[kind](term)) for kind, term in CODE_SEARCHES]
    return lookup.multi_search(A.cards(spark, d, with_rulings=False), searches, keep=["uuid"])


def q_type_contains(spark: SparkSession, d: str) -> DataFrame:
    searches = [({"search": "type_substring"}, lookup.type_predicate("land")),
                ({"search": "type_word"}, lookup.type_predicate("Land", word=True)),
                ({"search": "split_name"}, P.contains_cs("name", "//")),
                ({"search": "name_bolt"}, P.contains_cs("name", "bolt"))]
    return lookup.multi_search(A.cards(spark, d, with_rulings=False), searches, keep=["uuid"])


def q_distinct_sorted(spark: SparkSession, d: str) -> DataFrame:
    return lookup.distinct_sorted(A.cards(spark, d, with_rulings=False), "cmc")


def q_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookup.value_counts(A.table(spark, d, "events"), "event_type", out="n")


def q_nest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    nested = nest_combos(A.combo_tables(spark, d))
    return nested.select(
        "combo_id", "identity", "of", "includes",
        F.size("cards").cast("bigint").alias("n_cards"),
        F.size("features").cast("bigint").alias("n_features"),
        F.size("requires").cast("bigint").alias("n_requires"),
        F.size(F.array_distinct(F.transform("cards", lambda c: c["zone_locations"])))
         .cast("bigint").alias("n_zone_sets"),
        F.array_join(F.transform("cards", lambda c: c["card_name"]), ", ").alias("card_names"),
        F.array_join(F.transform("features", lambda f: f["feature_name"]), ", ").alias("feature_names"))


def q_combo_qa(spark: SparkSession, d: str) -> DataFrame:
    return qa.combo_pairs(A.combo_tables(spark, d)).select("combo_id", "question", "answer")


def q_qa_template_fanout(spark: SparkSession, d: str) -> DataFrame:
    return qa.fanout(A.cards(spark, d), qa.card_templates(False), keep=["uuid"])


COMPAT_BUILDERS = ["mana_cost", "colors", "color_identity", "card_with_cmc"]


def q_qa_null_branch(spark: SparkSession, d: str) -> DataFrame:
    templates = [t for t in qa.card_templates(True) if t.name in COMPAT_BUILDERS]
    return qa.fanout(A.cards(spark, d, compat=True, with_rulings=False), templates, keep=["uuid"])


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    rules = A.rule_tables(spark, d)
    reg = qa.default_registry(rule_tables=list(rules))
    tables = {"cards": A.cards(spark, d), "combos": A.combo_tables(spark, d), **rules}
    return reg.build(tables)


def q_qa_union_groups(spark: SparkSession, d: str) -> DataFrame:
    return (_corpus(spark, d).groupBy("group", "train_order", "builder")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_pairs"),
                 F.sum(F.length("question") + F.length("answer")).cast("bigint").alias("n_chars")))


def q_corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return (_corpus(spark, d).groupBy("group")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_pairs"),
                 F.sum(F.length("question") + F.length("answer")).cast("bigint").alias("n_chars")))


STORE_GROUPS = ["rules", "combos"]


def q_corpus_store(spark: SparkSession, d: str) -> DataFrame:
    """Build the corpus into a store, list it from its manifest, load two groups."""
    rules = A.rule_tables(spark, d)
    tables = {"cards": A.cards(spark, d), "combos": A.combo_tables(spark, d), **rules}
    path = new_folder(ensure_checkpoint_dir(spark), "corpus")
    qa.build_corpus(qa.default_registry(rule_tables=list(rules)), tables, path)
    listed = corpus.corpus_manifest(spark, path)
    counts = F.create_map(*[F.lit(x) for g in sorted(listed) for x in (g, listed[g]["rows"])])
    loaded = corpus.load_corpus(spark, path, *STORE_GROUPS)
    return loaded.select("group", "builder", counts[F.col("group")].cast("bigint").alias("n_rows"),
                         F.posexplode("conversations").alias("turn", "m")).select(
        "group", "builder", "n_rows", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"))


def q_chat_render(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.render_turns(A.table(spark, d, "conversations"))
    return r.select("conv_id", F.col("n_messages").cast("bigint").alias("n_messages"), "text")


def q_token_truncate(spark: SparkSession, d: str) -> DataFrame:
    return corpus.truncate_tokens(A.table(spark, d, "conversations"), MAX_SEQ_LEN)


def q_response_mask(spark: SparkSession, d: str) -> DataFrame:
    return corpus.response_mask_counts(A.table(spark, d, "conversations"))


BATCH_ROWS = 24      # examples of a training batch
LABEL_LEN = 128      # short, so that conversations are cut


def q_padded_batches(spark: SparkSession, d: str) -> DataFrame:
    """M-2: rendered conversations through a tokenizer hook into padded batches, one row an example."""
    rendered = corpus.render_turns(A.table(spark, d, "conversations"))
    coded = batches.encode_texts(rendered, "conv_id", "text", batches.hashed_words, "hashed-words", MAX_SEQ_LEN)
    return batches.padded_batches(coded, "conv_id", BATCH_ROWS).select("batch", "width", F.inline("rows")).select(
        F.col("batch").cast("bigint"), F.col("slot").cast("bigint"), F.col("key").alias("conv_id"),
        F.col("n_tokens").cast("bigint"), F.col("width").cast("bigint"),
        F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", "").alias("attention_mask"))


def q_response_labels(spark: SparkSession, d: str) -> DataFrame:
    """Token-aligned labels of each conversation, through the cut."""
    r = corpus.labelled_tokens(A.table(spark, d, "conversations"), LABEL_LEN)
    return r.select("conv_id", F.size("tokens").cast("bigint").alias("n_kept"), F.array_join("tokens", " ").alias("tokens"),
                    F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"))


def q_marker_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a marker set inside their words: markers stay whole tokens."""
    c = A.table(spark, d, "conversations").where("text IS NOT NULL")
    marker = F.element_at(F.array(*[F.lit(m) for m in MARKERS]), (F.pmod("turn", F.lit(len(MARKERS))) + 1).cast("int"))
    marked = F.concat(F.substring("text", 1, 20), marker, F.substring(F.col("text"), F.lit(21), F.length("text")))
    toks = c.select("conv_id", "turn", X.train_tokens(marked).alias("t"))
    return toks.select("conv_id", "turn", F.size("t").cast("bigint").alias("n_tokens"),
                       F.size(F.filter("t", lambda x: x.isin(MARKERS))).cast("bigint").alias("n_markers"),
                       F.array_join("t", " ").alias("tokens"))


def q_hash_split(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations")
    return corpus.hash_split(c, "conv_id").select("conv_id", "turn", "split")


def q_exact_split(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations")
    return corpus.exact_split(c, "conv_id").select("conv_id", "turn", "split")


def q_pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    lengths = docs.select(
        "doc_id", (F.coalesce(F.size(X.word_tokens("text")), F.lit(0)) + 1).cast("bigint").alias("n_tokens"))
    return corpus.pack_offsets(lengths, "n_tokens", "doc_id", MAX_SEQ_LEN).select(
        "doc_id", "n_tokens", "offset", "first_block", "last_block")


def q_pack_contents(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    toks = docs.select("doc_id", X.word_tokens("text").alias("tokens"))
    blocks = corpus.pack_blocks(toks, "tokens", "doc_id", MAX_SEQ_LEN)
    return blocks.select("block", F.size("tokens").cast("bigint").alias("n_tokens"),
                         F.array_join("tokens", " ").alias("tokens"))


def q_doc_content(spark: SparkSession, d: str) -> DataFrame:
    docs = retrieval.card_documents(A.cards(spark, d, with_rulings=False))
    return docs.select("id", "content", *[F.col(f"meta.{f}").alias(f"meta_{f}") for f in
                                          ("name", "mana_cost", "cmc", "color_identity", "type",
                                           "power", "toughness", "rarity", "loyalty", "side")])


def q_bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = A.doc_table(spark, d)
    n_docs, _, freq = retrieval.corpus_statistics(docs)
    return freq.select("token", F.col("df").cast("bigint").alias("df"),
                       F.round(retrieval.idf(F.col("df"), n_docs), 6).alias("idf"))


def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.bm25_scan_search(A.doc_table(spark, d), A.query_table(spark, d), TOP_K)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")


def q_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.dense_search(A.vector_table(spark, d), A.query_table(spark, d), TOP_K)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")


def q_cell_search(spark: SparkSession, d: str) -> DataFrame:
    """The vectors indexed in cells below the shared folder, loaded and searched: equal to ``dense_topk``."""
    path = new_folder(ensure_checkpoint_dir(spark), "vectors")
    cells.add_vectors(spark, path, A.vector_table(spark, d))
    r = cells.search_vectors(cells.load_vector_index(spark, path), A.query_table(spark, d), TOP_K)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")


def q_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.bm25_scan_search(A.doc_table(spark, d), A.query_table(spark, d), TOP_K,
                                   SEARCH_FILTERS, fields=["lang", "source", "n_chars"])
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid_search(None, A.query_table(spark, d), TOP_K, TOP_K,
                                   docs=A.doc_table(spark, d), vectors=A.doc_vector_table(spark, d))


def q_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", F.col("rank").cast("bigint").alias("rank"),
                                    "id", "score", "retriever")


def _formatted(spark: SparkSession, d: str) -> DataFrame:
    res = _hybrid(spark, d)
    docs = A.doc_table(spark, d).select("id", "content", "meta")
    return res.join(docs, "id", "inner").select(
        "query_id", "rank", retrieval.format_result(F.col("score"), F.col("content"), F.col("meta"))
        .alias("formatted"))


def q_format_results(spark: SparkSession, d: str) -> DataFrame:
    return _formatted(spark, d).select("query_id", F.col("rank").cast("bigint").alias("rank"),
                                       "formatted")


def q_prompt_messages(spark: SparkSession, d: str) -> DataFrame:
    q = A.query_table(spark, d)
    ctx = retrieval.context_per_query(_formatted(spark, d))
    conv = A.table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), "turn", "role", F.col("text").alias("content"))
    msgs = corpus.prompt_messages(q, ctx, conv.join(q.select("query_id"), "query_id", "left_semi"))
    return msgs.select("query_id", F.posexplode("messages").alias("msg_index", "m")).select(
        "query_id", F.col("msg_index").cast("bigint").alias("msg_index"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def _stored_index(spark: SparkSession, d: str, steps: int = 2) -> postings.TextIndex:
    """The documents indexed, in steps, below the shared folder, and loaded back."""
    path = new_folder(ensure_checkpoint_dir(spark), "index")
    docs = A.doc_table(spark, d)
    for i in range(steps):
        postings.add_documents(spark, path, docs.where(F.pmod(F.xxhash64("id"), F.lit(steps)) == i))
    return postings.load_text_index(spark, path)


def q_index_search(spark: SparkSession, d: str) -> DataFrame:
    """Build, save, grow, load and search: equal to ``bm25_topk``."""
    r = postings.search_index(_stored_index(spark, d), A.query_table(spark, d), TOP_K)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")


def q_prompt_batch(spark: SparkSession, d: str) -> DataFrame:
    """From query texts to prompts over a stored index, with filters."""
    queries = A.query_table(spark, d).select("query_id", "text")
    found = postings.search_results(_stored_index(spark, d, 1), queries, TOP_K, SEARCH_FILTERS, ["lang", "source", "n_chars"])
    msgs = corpus.prompt_messages(queries, retrieval.context_per_query(found))
    return msgs.select("query_id", F.posexplode("messages").alias("msg_index", "m")).select(
        "query_id", F.col("msg_index").cast("bigint").alias("msg_index"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def q_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt part names (vowels rotated) looked up among all printings."""
    names = A.printings(spark, d).select("uuid", "name")
    queries = (A.table(spark, d, "part").select("p_name").distinct()
               .select(F.conv(F.substring(F.md5("p_name"), 1, 12), 16, 10).cast("bigint").alias("query_id"),
                       F.translate("p_name", "aeiou", "eioua").alias("text")))
    return fuzzy_best_match(names, queries)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "canonical_rows": q_canonical_rows,
    "string_agg": q_string_agg,
    "typed_numeric": q_typed_numeric,
    "normalize_codes": q_normalize_codes,
    "identity_name": q_identity_name,
    "face_name": q_face_name,
    "ordinal_lines": q_ordinal_lines,
    "null_predicates": q_null_predicates,
    "lookup_by_key": q_lookup_by_key,
    "code_contains": q_code_contains,
    "type_contains": q_type_contains,
    "distinct_sorted": q_distinct_sorted,
    "value_counts": q_value_counts,
    "nest_roundtrip": q_nest_roundtrip,
    "combo_qa": q_combo_qa,
    "qa_template_fanout": q_qa_template_fanout,
    "qa_null_branch": q_qa_null_branch,
    "qa_union_groups": q_qa_union_groups,
    "corpus_counts": q_corpus_counts,
    "corpus_store": q_corpus_store,
    "chat_render": q_chat_render,
    "token_truncate": q_token_truncate,
    "response_mask": q_response_mask,
    "padded_batches": q_padded_batches,
    "response_labels": q_response_labels,
    "marker_tokens": q_marker_tokens,
    "hash_split": q_hash_split,
    "exact_split": q_exact_split,
    "pack_sequences": q_pack_sequences,
    "pack_contents": q_pack_contents,
    "doc_content": q_doc_content,
    "bm25_stats": q_bm25_stats,
    "bm25_topk": q_bm25_topk,
    "dense_topk": q_dense_topk,
    "cell_search": q_cell_search,
    "filtered_search": q_filtered_search,
    "hybrid_search": q_hybrid_search,
    "format_results": q_format_results,
    "prompt_messages": q_prompt_messages,
    "index_search": q_index_search,
    "prompt_batch": q_prompt_batch,
    "fuzzy_match": q_fuzzy_match,
}
