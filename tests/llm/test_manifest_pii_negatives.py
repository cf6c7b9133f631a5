"""Merkle manifest, personal data and hard negatives against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import hard_negatives, merkle, pii
from lexiforge.llm.common import fold, word_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i:i + 16]
            for j in range(len(run)):
                for x in members[i + j]:
                    paths[x].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha(*run))
            below.append(sum(members[i:i + 16], []))
        nodes, members = up, below
    return nodes[0], paths


def brute_manifest(rows):
    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, t, lang, source, n in rows:
        leaf = sha(*map(value, (i, source, lang, n, t)))
        bad = leaf
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0:
            bad = sha(*map(value, (i, source, lang, n, None if t is None else t.translate(UPPER))))
        groups.setdefault(source, []).append(((i is not None, i or 0), leaf, bad, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots, paths = {}, {}
    for s in order:
        groups[s].sort(key=lambda x: x[:2])
        roots[s], paths[s] = brute_tree([x[1] for x in groups[s]])
    root, tops = brute_tree([roots[s] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, leaf, bad, i), path in zip(groups[s], paths[s]):
            got = bad
            for a, b in path + top:
                got = sha(a, got, b)
            out.append((str(i), leaf, roots[s], root, sha(*[a + b for a, b in path + top]), got, got == root))
    return sorted(out)


def manifest_rows(docs):
    leaves = merkle.document_leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", "text",
                                    fold("doc_id", 5) == 0)
    out = merkle.verify(merkle.build(leaves, "doc_id", "leaf", "source"), "doc_id", "leaf", "source", "claimed")
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect())


def some_docs(n, sources, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["Some Text", "lower only", "ÄÖ é", "", None, "x" * 20_000]), rng.choice(["en", None]),
             sources(rng, i), rng.choice([None, 7, 0])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [
    [(1, "Only", "en", "a", 4)],
    some_docs(17, lambda r, i: "a"),
    some_docs(300, lambda r, i: r.choice([None, "", "b", "ä", "z", "Z"])),
    some_docs(700, lambda r, i: f"s{i % 290}"),
    some_docs(40, lambda r, i: "a") * 2 + [(None, "Null Id", None, None, None)] * 3 + [(5, "Other", "en", "a", 1)],
], ids=["one", "seventeen", "null source", "many sources", "repeated rows"])
def test_manifest_equals_brute_force(spark, rows):
    assert manifest_rows(spark.createDataFrame(rows, DOCS)) == brute_manifest(rows)


def test_manifest_of_several_block_levels(spark, monkeypatch):
    """Blocks of 16 leaves, so that 5,000 leaves of one source need several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    import sys

    from lexiforge.session import ship_by_value
    ship_by_value("lexiforge.llm.merkle")
    from pyspark import cloudpickle
    try:
        rows = some_docs(5_000, lambda r, i: "hot" if i % 3 else f"s{i % 40}")
        assert manifest_rows(spark.createDataFrame(rows, DOCS)) == brute_manifest(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules["lexiforge.llm.merkle"])


def test_manifest_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert manifest_rows(empty) == []
    clash = spark.createDataFrame([(i, "T", "en", "s", 1, 0, 0, "x") for i in range(20)],
                                  DOCS + ", pos int, n int, grp string")
    assert manifest_rows(clash) == brute_manifest([(i, "T", "en", "s", 1) for i in range(20)])


def test_witnesses_grow_with_appends():
    """Witnesses of an accumulator equal those of the whole tree at every size."""
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 700):
        nodes = [sha(str(i)) for i in range(n)]
        root, paths = brute_tree(nodes)
        tree = merkle.Witnesses(merkle.levels_of(n))
        for x in nodes:
            tree.append(x.encode())
        assert tree.finish().decode() == root
        for node, got, want in zip(nodes, tree.witness(), paths):
            assert [(a.decode(), b.decode()) for a, b in got] == want
            assert merkle.fold(node.encode(), got).decode() == root
            assert merkle.unpack_path(merkle.pack_path(got)) == got


# ---------------------------------------------------------------- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            ok = [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and total % 10 == 0,
                  10 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled_examples(spark))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(4)
    pieces = ["a@b.c", "@", "x.y@z", ".", "..", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "00001.2.3.4", "+1 (22) 333-4444", "+", "+1",
              "4111 1111 1111 1111", "4111111111111111", "378282246310005", "-", " ", "  ", "é", "12", "0", "a+b%c@d-e.f.g", "(", ")", "\n"]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_base_spans_of_long_runs_are_linear():
    for unit in ("1", "a", "1.", "a@", "+1 ", "1 ", "a.", "(", "+1("):
        pii.base_spans(unit * 300_000)


def whole_viterbi(model, scores):
    t = model.transitions
    best, back = scores[0], []
    for s in scores[1:]:
        both = best[:, None] + t
        back.append(both.argmax(axis=0))
        best = both.max(axis=0) + s
    y = [int(best.argmax())]
    for b in reversed(back):
        y.append(int(b[y[-1]]))
    return y[::-1], float(best.max())


def path_score(model, scores, labels):
    return sum(scores[i][y] for i, y in enumerate(labels)) + sum(model.transitions[a][b] for a, b in zip(labels, labels[1:]))


def test_windows_decode_as_whole_texts(field):
    rng = random.Random(2)
    parts = ["(437) 555-1234", "jane (at) host (dot) org", "word", "Word,", "12.5", "123-45-6789", "DE89370400440532013000", "***", "Mr. Karl Weber", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "é"]
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, row = word_spans(buf, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    scores = field.scores(buf, starts, ends, row)
    labels = field.decode(scores, row)
    for i, r in enumerate(raw):
        own = row == i
        if not own.any():
            continue
        one = np.frombuffer(r, np.uint8)
        s, e, z = word_spans(one, np.array([0, len(r)]))
        alone = field.scores(one, s, e, z)
        assert np.allclose(alone, scores[own])
        _, best = whole_viterbi(field, scores[own])
        assert abs(path_score(field, scores[own], labels[own].tolist()) - best) < 1e-6
    # random scores leave few words outside: long windows
    noise = np.random.default_rng(3).normal(0, 6, scores.shape)
    labels = field.decode(noise, row)
    for i in range(len(raw)):
        own = row == i
        if own.any():
            assert abs(path_score(field, noise[own], labels[own].tolist()) - whole_viterbi(field, noise[own])[1]) < 1e-6


def test_gradient_of_training_fits_the_examples(spark, field):
    """Held-out examples: precision and recall over whole spans."""
    hit = found = wanted = 0
    for r in pii.labelled_examples(spark, rows=300, seed=99).collect():
        got = {(s, k, e) for s, k, e, _ in next(pii.all_spans(field, pa.array([r.text])))}
        want = {(x.start, pii.KINDS.index(x.kind), x.end) for x in r.spans}
        hit, found, wanted = hit + len(got & want), found + len(got), wanted + len(want)
    assert hit / wanted >= 0.95 and hit / found >= 0.97


def test_find_pii(spark, field):
    texts = ["Call (437) 555-1234 now", "write jane.doe (at) example (dot) org please", "é a@b.example.com, 10.0.0.1 and 4111-1111-1111-1111",
             "", None, "plain words only. Version 1.2.3 of 2021-03-04", "my ssn 123-45-6789", "Dr. Elena Torres said"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, texts[0], "x", "y"), (2, texts[2], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, spans string")
    found = pii.find_pii(docs, field)
    out = pii.digest_spans(found).collect()
    assert len(out) == len(rows)
    spans = {r.doc_id: r.spans for r in out}
    assert spans[0] == "phone:5:19" and spans[None] == "phone:5:19"
    assert spans[1] == "email:6:37"
    assert spans[2] == "email:2:17,ip:19:27,card:32:51"
    assert spans[3] == spans[4] == spans[5] == ""
    assert spans[6] == "ssn:7:18" and spans[7] == "name:4:16"
    two = [r for r in out if r.doc_id == 2]
    assert len(two) == 2 and two[0] == two[1] and (two[0].n_email, two[0].n_ip, two[0].n_card, two[0].n_phone) == (1, 1, 1, 0)
    assert two[0].base_sha256 == hashlib.sha256(b"email:2:17,ip:19:27,card:32:51").hexdigest()
    red = {r.doc_id: r for r in pii.redact(docs, field).collect()}
    assert red[2].text == "é [EMAIL], [IP] and [CARD]" and red[4].text is None and red[2].id == "x" and red[2].spans == "y"
    assert pii.find_pii(docs.limit(0), field).count() == 0


def test_query_equals_plain_patterns(spark):
    from lexiforge.llm.queries import op12_pii
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op12_pii(spark, d).collect():
        base = plain_spans(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))


# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, every=5, scale=256):
    good = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.setdefault(i, []).append((y, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    out = []
    for a in sorted(good):
        if a % every:
            continue
        y, v = min(good[a], key=lambda r: (str(r[0]), r[1]))
        same, other = {}, {}
        for b in good:
            if b != a:
                for yb, w in good[b]:
                    s = sum(p * q for p, q in zip(v, w))
                    side = same if yb == y else other
                    side[b] = max(side.get(b, s), s)
        for p, ps in sorted(same.items(), key=lambda x: (-x[1], x[0]))[:5]:
            fit = sorted(((s, n) for n, s in other.items() if 50 * ps <= 100 * s <= 95 * ps), key=lambda x: (-x[0], x[1]))[:3]
            out += [(a, p, k + 1, n, ps, s) for k, (s, n) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, schema=VECTORS, **options):
    df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 5 == 0, scale=256, **options).collect())


def some_vectors(n, labels=4, width=8, seed=0, spread=0.4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, width))
    out = []
    for i in range(n):
        y = int(rng.integers(labels))
        v = centers[y] * 0.7 + rng.normal(size=width) * spread
        out.append((i, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)], y))
    return out


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 4_000}], ids=["one slice", "many slices"])
def test_negatives_equal_brute_force(spark, options):
    rows = some_vectors(600)
    got = mined(spark, rows, **options)
    assert got == brute_negatives(rows) and len(got) > 300


def test_negatives_with_ties_and_bad_rows(spark):
    rows = some_vectors(200, seed=3)
    rows += [(1000 + i, rows[7][1], rows[7][2] if i % 3 else (rows[7][2] + 1) % 4) for i in range(60)]    # one hot vector
    rows += [(5, rows[5][1], rows[5][2]), (8, rows[9][1], rows[9][2])]                                   # repeated ids
    rows += [(None, rows[0][1], 1), (2001, None, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1),
             (2004, [None] * 8, 1), (2005, rows[0][1], None), (2006, [], 1), (2010, [0.5], 0), (2015, rows[1][1] + [0.25], 1)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_edges(spark):
    assert mined(spark, spark.createDataFrame([], VECTORS)) == []
    assert mined(spark, [(5, [1.0], 0)]) == []
    assert mined(spark, [(5, [1.0], 0), (6, [1.0], 0), (7, [0.75], 1)]) == [(5, 6, 1, 7, 65536, 49152)]
    clash = spark.createDataFrame([(5, [1.0], 0, "x", 1), (6, [1.0], 0, "y", 2), (7, [0.75], 1, "z", 3)], VECTORS + ", vector string, id int")
    assert mined(spark, clash) == [(5, 6, 1, 7, 65536, 49152)]


def test_tree_bounds_hold_and_prune():
    """Every score lies in its bounds, and near anchors spare inner products."""
    rng = np.random.default_rng(1)
    a = np.floor(256 * (rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(64, 16))))
    order, parent, edge = hard_negatives.spanning_tree(a)
    assert sorted(order.tolist()) == list(range(64)) and all(p < k for k, p in enumerate(parent[1:].tolist(), 1))
    lengths = np.linalg.norm(a[order[1:]] - a[order[parent[1:]]], axis=1)
    assert np.allclose(lengths, edge[1:])
    # no shorter tree: compare with Kruskal
    pairs = sorted((np.linalg.norm(a[i] - a[j]), i, j) for i, j in itertools.combinations(range(64), 2))
    root = list(range(64))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    total = 0.0
    for d, i, j in pairs:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert abs(total - edge.sum()) < 1e-6 * total
    tree = hard_negatives.Tree("0", np.arange(64), a[order], parent, edge)
    c = np.floor(256 * rng.normal(size=(3000, 16)))
    lists = [[(-np.inf, np.inf, hard_negatives.Best(5))] for _ in range(64)]
    ids = np.arange(100, 3100)
    n = hard_negatives.scan(tree, c[:1000], np.linalg.norm(c[:1000], axis=1), ids[:1000], lists.__getitem__)
    n += hard_negatives.scan(tree, c[1000:], np.linalg.norm(c[1000:], axis=1), ids[1000:], lists.__getitem__)
    for j in range(64):
        s = (c @ tree.a[j]).astype(np.int64)
        want = sorted(zip((-s).tolist(), ids.tolist()))[:5]
        assert [(-x, i) for x, i in zip(lists[j][0][2].score.tolist(), lists[j][0][2].id.tolist())] == want
    assert n < 0.6 * 64 * 3000


def test_large_scores_are_exact_or_refused():
    big = np.array([[2.0 ** 29, 3.0], [2.0 ** 29, -1.0]])
    assert hard_negatives.products(big, big).tolist() == [[2 ** 58 + 9, 2 ** 58 - 3], [2 ** 58 - 3, 2 ** 58 + 1]]
    with pytest.raises(ValueError):
        hard_negatives.products(big * 16, big)
