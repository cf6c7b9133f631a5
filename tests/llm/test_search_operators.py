"""N-gram join, components and decontamination against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiforge.llm import decontamination, ngram_join
from lexiforge.llm.common import span_hashes, text_bytes, word_spans
from lexiforge.llm.components import connected_components


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_join(docs, percent=75):
    sets = {d: sets_of(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = classes(links, ids)
    return {d: (len(sets[d]), comp[d]) for d in ids}


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def fixture(seed):
    rng = random.Random(seed)
    def word():
        return f"w{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    texts = [None, "", "\n \t", "One two", "one TWO", "one two three four five", "a b c d e f", "a b c d e f g"]
    for size, n, edits in ((60, 25, 4), (150, 20, 8), (30, 12, 2), (8, 10, 1)):
        texts += copies(rng, [word() for _ in range(size)], n, edits)
    texts += [" ".join([word() for _ in range(rng.randint(5, 60))] + passage) for _ in range(25)]
    texts += [texts[20], texts[20], " ".join(f"u{i}" for i in range(4000))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(d, texts[k]) for d, k in enumerate(order)]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 8)])
def test_join_components(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)     # 8: groups are cut into blocks
    docs = fixture(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(df).collect()}
    assert got == brute_join(docs)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    want = brute_join(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(
        d for d, (n, c) in want.items() if n == 0 or d == c)


def test_join_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (None, "x y z"), (None, None), (3, "A B C d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"] or 0)
                 for r in ngram_join.join_components(df).collect())
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 1, 1), (0, 1, 1), (0, 0, 0), (3, 2, 1)])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.keep_one(df).where("text IS NOT NULL").collect()) == [
        (1, "a b c d e f"), (1, "x y z")]
    assert ngram_join.join_components(df.limit(0)).count() == 0
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_bitmap_bound_never_drops_a_pair():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
        sets = []
        for _ in range(12):
            keep = base[rng.random(200) < rng.uniform(0.8, 1)]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2 ** 63, rng.integers(0, 40)).astype(np.uint64)])))
        sets.sort(key=len)
        maps = [np.frombuffer(ngram_join.parity_bitmap(s), "<u8") for s in sets]
        sigs = [np.frombuffer(ngram_join.prefix_signature(s, 75), "<u8").reshape(2, -1) for s in sets]
        i, j, _ = ngram_join.near_in_cell(np.array([len(s) for s in sets]), maps, sigs, 75)
        found = set(zip(i.tolist(), j.tolist()))
        for a in range(12):
            for b in range(a + 1, 12):
                c = len(np.intersect1d(sets[a], sets[b]))
                if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                    assert (a, b) in found


def test_signatures_filter_pairs_that_share_a_first_prefix_only():
    """Of pairs with one common token, few share a prefix token under both further orders."""
    rng = np.random.default_rng(6)
    sets = [np.unique(np.concatenate([[np.uint64(7)], rng.integers(0, 2 ** 63, 40).astype(np.uint64)])) for _ in range(60)]
    flat = [np.zeros(1, np.uint64)] * len(sets)       # a bitmap that lets all pairs pass
    sigs = [np.frombuffer(ngram_join.prefix_signature(s, 75), "<u8").reshape(2, -1) for s in sets]
    i, _, _ = ngram_join.near_in_cell(np.full(60, 41), flat, sigs, 75)
    assert len(i) < 0.25 * 60 * 59 / 2


def brute_near(docs, percent=75):
    """As brute_join, over many near copies: sets of ints, one linked component at a time."""
    sets = {d: sets_of(t) for d, t in docs}
    left, comp = sorted(d for d in sets if sets[d]), {d: d for d in sets}
    while left:
        first, left = left[0], left[1:]
        reach = [first]
        for x in reach:
            near = [y for y in left if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])]
            for y in near:
                comp[y] = first
            reach += near
            gone = set(near)
            left = [y for y in left if y not in gone]
    return {d: (len(sets[d]), comp[d]) for d in sets}


def hot_group(n=1500):
    """A large group of near copies, far copies that share many of its shingles but link
    with few or none, and a chain of texts that connects step by step."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    texts = copies(rng, base, n, 1)
    for k in range(80):
        w = list(base)
        for p in rng.sample(range(90), rng.randint(3, 9)):
            w[p] = f"far{k}x{p}"
        texts.append(" ".join(w))
    for k in range(30):
        texts.append(" ".join(base[:70 - k] + [f"c{i}" for i in range(k + 20)]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(d, texts[k]) for d, k in enumerate(order)]


def test_members_apart_meet_across_blocks(spark, monkeypatch):
    """Frequent tokens dealt into blocks of 8: results equal brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "WIDE", 3)
    monkeypatch.setattr(ngram_join, "HEAVY", 64)
    docs = hot_group()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(df).collect()}
    assert got == brute_near(docs)


def test_rows_of_a_large_group_grow_with_it(spark):
    """20,000 near copies of a text of 60 words: one prefix row a token and node."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(copies(rng, base, 20_000, 3))], "doc_id long, text string").repartition(8)
    made = ngram_join.profile(df, "doc_id", "text", 0)
    table, _ = ngram_join.token_classes(made.where("part IS NOT NULL").select("part", "counts"))
    assert (table > ngram_join.WIDE).any()
    tokens = ngram_join.prefix_tokens(df, "text", spark.sparkContext.broadcast(table), 0, 75)
    assert tokens.count() < 1_000_000
    cells = ngram_join.token_cells(tokens, 16).select(F.size("members").alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert cells[0] < 1_000_000 and cells[1] <= ngram_join.BLOCK


def test_clashing_ids_keep_results_right(spark):
    """Ids of 6 bits at first: nearly all clash and take the other half of the digest."""
    docs = fixture(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(df, id_bits=6).collect()}
    assert got == brute_join(docs)


def test_keep_one_keeps_clashing_columns(spark):
    rows = [(i, "a b c d e f g", *[f"{c}{i}" for c in "abcdefg"]) for i in (3, 3, 5)] + [(7, "x y", *"abcdefg"), (8, None, *"abcdefg")]
    names = ["_n", "_th", "_s", "_id", "_th2", "row", "th"]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aé \t\n\x0b\x1cb", max_size=12), max_size=8))
def test_word_spans(texts):
    buf, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends, row = word_spans(buf, offsets)
    got = [[] for _ in texts]
    for a, b, r in zip(starts, ends, row):
        got[r].append(bytes(buf[a:b]).decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    h = span_hashes(buf, starts, ends)
    words = [w for ws in got for w in ws]
    assert len(set(h.tolist())) == len(set(words))


@pytest.mark.parametrize("seed", [1])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    edges += [(i, i + 1) for i in range(1000, 1020)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == classes(real, sorted({x for e in real for x in e}))
    for options in ({"small": 0}, {"python": False}):      # star rounds alone
        assert {r["node"]: r["component"] for r in connected_components(df, **options).collect()} == got
    assert connected_components(df.limit(0)) is None


def words(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)


def infix(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_infix_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randrange(4) + 1 for _ in range(rng.randint(1, 8))]
        text = [rng.randrange(4) + 1 for _ in range(rng.randint(0, 12))]
        assert decontamination.infix_distance(np.array(item, np.uint64), np.array(text, np.uint64)) == infix(item, text)


def leaky(rng, n_items=40, n_docs=160):
    def word():
        return rng.choice(["the", "of", "and", "é"]) if rng.random() < 0.3 else f"word{rng.randrange(3000)}"
    items = [" ".join(word() for _ in range(rng.randint(12, 60))) for _ in range(n_items)]
    docs = []
    for _ in range(n_docs):
        body = [word() for _ in range(rng.randint(0, 300))]
        if rng.random() < 0.6:
            w = rng.choice(items).split()
            for _ in range(rng.choice([0, 0, 1, len(w) // 12, len(w) // 7])):
                p = rng.randrange(len(w))
                w[p:p + 1] = rng.choice([[], ["new"], [w[p], "more"]])
            p = rng.randint(0, len(body))
            body[p:p] = w
        docs.append(" ".join(body).upper() if rng.random() < 0.2 else ", ".join(body))
    return items, docs


def test_decontamination_against_brute_force(spark):
    items, docs = leaky(random.Random(7))
    docs += [None, "", "the of and"]
    items += [items[0], None, "", "too short"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.find_contamination(df, bench).collect()}
    want = {}
    for d, t in enumerate(docs):
        for i, x in enumerate(items[:40]):
            w = words(x)
            k = infix(w, words(t))
            if k <= int(0.2 * len(w)):
                want[(d, i)] = k
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    exact = {k for k, v in want.items() if v == 0}
    assert exact <= set(got)
    assert len(got) >= 0.97 * len(want)
    clean = decontamination.remove_contaminated(df, bench)
    assert clean.columns == df.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(set(range(len(docs))) - {d for d, _ in got})
    assert decontamination.find_contamination(df.limit(0), bench).count() == 0
    assert decontamination.find_contamination(df, bench.limit(0)).count() == 0
    assert decontamination.remove_contaminated(df, bench.limit(0)).count() == len(docs)


def test_item_blocks_cover_all_items(spark, monkeypatch):
    items, docs = leaky(random.Random(9), 12, 40)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    whole = sorted(decontamination.find_contamination(df, bench).select("doc_id", "item_id").collect())
    blocks = list(decontamination.item_blocks(bench, "item_id", "text", 5, max_items=4))
    assert len(blocks) == 3 and sorted(k for ids, _ in blocks for k in ids) == list(range(12))
    by_bytes = list(decontamination.item_blocks(bench, "item_id", "text", 5, max_bytes=600))
    assert len(by_bytes) > 3 and sorted(k for ids, _ in by_bytes for k in ids) == list(range(12))
    monkeypatch.setattr(decontamination, "item_blocks", lambda *a: iter(blocks))
    assert len(set(whole) ^ set(decontamination.find_contamination(df, bench).select("doc_id", "item_id").collect())) <= 1


def test_items_of_equal_words_are_one_in_any_blocks(spark):
    said = "one two three four five six"
    rows = [(3, said), (None, said.upper()), (1, said.replace(" ", ", ")), (2, f" {said}!"), (7, "a b c d e f g"), (8, "?")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    for most in (1, 2, 100):
        ids = [k for block, _ in decontamination.item_blocks(bench, "item_id", "text", 1, max_items=most) for k in block]
        assert sorted(ids) == [1, 7]


def test_short_items_can_be_left_out(spark):
    bench = spark.createDataFrame([(1, "yes"), (2, "one two three four five six")], "item_id long, text string")
    df = spark.createDataFrame([(1, "oh yes"), (2, "x one two three four five six y"), (3, "no")], "doc_id long, text string")
    for least, kept in ((1, [3]), (2, [1, 3])):
        out = decontamination.remove_contaminated(df, bench, least_words=least).select("doc_id").collect()
        assert sorted(r["doc_id"] for r in out) == kept


def test_recall_at_the_edit_limit():
    items, _ = leaky(random.Random(3), 150, 0)
    rng = random.Random(4)
    w, f, _ = decontamination.words_of(pa.array(items))
    own = [w[f[i]:f[i + 1]] for i in range(len(items))]
    tables = decontamination.build_tables(own)
    flags = decontamination.first_flags(tables)
    for rate, least in ((0.0, 1.0), (0.1, 0.99), (0.2, 0.97)):
        texts = []
        for x in items:
            ws = x.split()
            for p in rng.sample(range(len(ws)), int(rate * len(ws))):
                ws[p] = rng.choice(["", "changed", ws[p] + " added"])
            texts.append("before it " + " ".join(ws) + " and after")
        found = decontamination.matches(pa.array(texts), own, tables, flags, 0.2)
        assert sum((i, i) in found for i in range(len(items))) >= least * len(items)


def test_recall_does_not_depend_on_other_items():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(20000)]
    weights = np.cumsum(1 / np.arange(1, 20001)).tolist()

    def draw(n):
        return rng.choices(vocabulary, cum_weights=weights, k=n)

    items = [draw(rng.randint(15, 60)) for _ in range(20000)]
    held = {}
    for x in items:
        for y in set(x):
            held[y] = held.get(y, 0) + 1
    w, f, _ = decontamination.words_of(pa.array([" ".join(x) for x in items]))
    own = [w[f[i]:f[i + 1]] for i in range(len(items))]
    tables = decontamination.build_tables(own)
    flags = decontamination.first_flags(tables)
    picked = rng.sample(range(len(items)), 300)
    for kind in ("rarest of both halves", "any"):
        texts = []
        for i in picked:
            x, half = list(items[i]), len(items[i]) // 2
            ends = [sorted(p, key=lambda j: held[x[j]]) for p in (range(half), range(half, len(x)))]
            most = int(0.2 * len(x))
            at = [j for p in zip(*ends) for j in p][:most] if kind != "any" else rng.sample(range(len(x)), most)
            for j in at:
                x[j] = rng.choice(["", "changed", x[j] + " added"])
            texts.append(" ".join(draw(40) + x + draw(40)))
        found = decontamination.matches(pa.array(texts), own, tables, flags, 0.2)
        assert sum((r, i) in found for r, i in enumerate(picked)) >= 0.97 * len(picked), kind


def piece_matches(items, texts, rate):
    """Exact yardstick: k edits leave one of an item's k + 1 pieces unchanged."""
    pieces = {}
    for i, x in enumerate(items):
        k = int(rate * len(x)) + 1
        cuts = [len(x) * j // k for j in range(k + 1)]
        for a, b in zip(cuts, cuts[1:]):
            pieces.setdefault((b - a, tuple(x[a:b])), []).append((i, a))
    out = {}
    for d, t in enumerate(texts):
        for size in {n for n, _ in pieces}:
            for p in range(len(t) - size + 1):
                for i, a in pieces.get((size, tuple(t[p:p + size])), ()):
                    k, at = int(rate * len(items[i])), p - a
                    if (d, i) not in out:
                        dist = infix(items[i], t[max(0, at - k):max(0, at + len(items[i]) + k)])
                        if dist <= k:
                            out[(d, i)] = dist
    return out


def test_walks_find_what_the_pieces_find():
    rng = random.Random(12)
    items, docs = leaky(rng, 60, 400)
    w, f, _ = decontamination.words_of(pa.array(items))
    own = [w[f[i]:f[i + 1]] for i in range(len(items))]
    tables = decontamination.build_tables(own)
    got = decontamination.matches(pa.array(docs), own, tables, decontamination.first_flags(tables), 0.2)
    want = piece_matches([words(x) for x in items], [words(t) for t in docs], 0.2)
    assert set(got) <= set(want) and {k for k, v in want.items() if v == 0} <= set(got)
    assert len(got) >= 0.99 * len(want) > 150
    for (d, i), (k, a) in got.items():
        text, item = words(docs[d]), words(items[i])
        assert infix(item, text[a:a + len(item) + k]) == k
        assert infix(item, text[max(0, a - 1):]) <= k and (k or text[a:a + len(item)] == item)


def test_repetitions_are_measured():
    """More edits or a higher recall take more repetitions; exact items take one; where
    edits are most of an item, fewer places are sampled."""
    count = decontamination.measured_repetitions
    assert count(16, False, 0.0, 5, 0.99)[0] == 1
    assert count(16, True, 0.1, 5, 0.9)[0] <= count(16, True, 0.2, 5, 0.9)[0] <= count(16, True, 0.2, 5, 0.99)[0]
    assert count(8, True, 0.2, 5, 0.99)[1] == decontamination.SAMPLES > count(8, True, 0.8, 5, 0.99)[1]


def test_starts_are_drawn_from_all_positions():
    rng = np.random.default_rng(3)
    items = [rng.integers(1, 2 ** 63, 24).astype(np.uint64) for _ in range(300)]
    at = np.zeros(24, int)
    for r in range(20):
        table = decontamination.sample_items(items, np.arange(300), 16, r)
        np.add.at(at, 23 - table.starts if table.backward else table.starts, 1)
    assert at.min() > 0.6 * at.mean() and at.max() < 1.6 * at.mean()


def test_short_items_and_scripts_without_spaces(spark):
    items = ["forty two", "Yes", "中华人民共和国首都是哪里？", "日本の首都はどこですか。", "เมืองหลวงของประเทศไทย", "東京", "?!", "𠀀𠀁"]
    docs = ["the answer is Forty-two.", "forty and two", "yesterday", "oh yes!", "问：中华人民共和国首都是哪里", "答：中华人民共和国首都在哪里",
            "では、日本の首都はどこですか？", "ถาม เมืองหลวงของประเทศไทย คือ", "私は東京に住む", "京東", "x𠀀𠀁y", "中文 plain text 5 % é", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for rate in (0.2, 0.6):       # short items stay exact
        got = {(r["doc_id"], r["item_id"]): r["distance"]
               for r in decontamination.find_contamination(df, bench, max_rate=rate).collect()}
        assert {k: d for k, d in got.items() if k[1] not in (2, 3, 4) or rate == 0.2} == \
            {(0, 0): 0, (3, 1): 0, (8, 5): 0, (10, 7): 0, **({(4, 2): 0, (5, 2): 1, (6, 3): 0, (7, 4): 0} if rate == 0.2 else {})}
    kept = decontamination.remove_contaminated(df, bench).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 9, 11, 12]


def test_cut_characters_keeps_rows_apart():
    texts = ["", "a中b", "中", "", "é,中国 x", "ไทย", "plain"]
    w, f, _ = decontamination.words_of(pa.array(texts))
    assert np.diff(f).tolist() == [0, 3, 1, 0, 4, 3, 1]
    assert w[1] == w[3] == w[5]


def test_join_names_what_it_counts(spark):
    texts = [" ".join(f"w{i}" for i in range(60))] + [" ".join(f"w{i}" for i in range(60)) + f" end{k}" for k in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joined = ngram_join.join_components(df)
    assert joined.columns == ["doc_id", "th", "n_shingles", "component_id", "n_tested_links"]
    rows = joined.collect()
    assert {r["component_id"] for r in rows} == {0} and all(1 <= r["n_tested_links"] <= 3 for r in rows)
