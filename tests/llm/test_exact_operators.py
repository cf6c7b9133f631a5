"""BPE, WARC, chat formatting, quality rules and URL filters against brute force."""

import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiforge.llm import bpe, chat_format, quality_rules, url_filters, warc

SPEC = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the ", "a", "é", "ß", "   ", "\n", "\t", "'s", "'ll", "'", "12", "3", "!?", "<|endoftext|>", "<|", "日本", "😀",
          "\u0085", "\u00a0", "x" * 40, "ab" * 30, "\r\n", ".", "Ünï", "\u200d", "000"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(SPEC)


@pytest.fixture(scope="module")
def small_leaves():
    return bpe.TreeBpe(bpe.load_spec(SPEC), leaf_chars=7, window=2)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.text(max_size=20))
def test_tree_concatenation_is_exact(reference, small_leaves, pieces, tail):
    text = "".join(pieces) + tail
    ids = small_leaves.encode(text)
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert small_leaves.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_long_unsplit_runs(reference):
    codec = bpe.TreeBpe(bpe.load_spec(SPEC), leaf_chars=64)
    rng = random.Random(1)
    for alphabet in ("ab", "abcdefghij", "é", "0123456789", " ", "!?.", "日本語", "'s"):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        assert codec.encode(text) == reference.encode(text, add_special_tokens=False).ids, alphabet


def test_every_character_splits_alike(reference):
    codec = bpe.TreeBpe(bpe.load_spec(SPEC))
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x11000), *range(0x1F300, 0x1F700)]]
    for i in range(0, len(chars), 512):
        text = "".join(f"a{c}b {c}{c} 1{c}2" for c in chars[i:i + 512])
        assert codec.encode(text) == reference.encode(text, add_special_tokens=False).ids, hex(ord(chars[i]))


def test_encode_documents_edges(spark, reference):
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(5000))
    texts = [None, "", "one", "one", long, "x" * 9000, long + "<|endoftext|>" + long, " " * 3000]
    df = spark.createDataFrame([(i // 2, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in bpe.encode_documents(df, SPEC, leaf_chars=512, long_chars=4000).collect())
    want = []
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((i // 2, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    real = bpe.encode_documents(df, SPEC, with_ids=True).where("doc_id = 1").first()
    assert np.frombuffer(real["ids"], "<u4").tolist() == reference.encode("one").ids and real["decoded"] == "one"
    assert bpe.encode_documents(df.limit(0), SPEC).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 2000 + "</p>"
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40 + "\r\n\r\n"
    rows = [(1, "http://a/x", big), (2, None, big), (3, "http://b/", big), (4, "http://c/", None), (5, "http://d", "s"),
            (6, "http://e", "s"), (7, "http://f\n", tricky), (7, "http://f\n", tricky), (None, "http://g", big),
            (6, "http://h", tricky)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("x"))
    out = warc.captures(df, str(tmp_path / "w"), with_payload=True, records_per_file=2, large_bytes=3000)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        key = r["metadata"]["fields"]["key"]
        src = [x for x in rows if str(x[0]) == key or (x[0] is None and key == "null")][0]
        body = (src[2] or "").encode()
        assert r["request"]["concurrent_to"] == r["capture_id"] == r["main"]["record_id"]
        if key == "6":      # one page id, two pages
            src = (6, "http://h", tricky) if len(body) != int(r["metadata"]["fields"]["payloadLength"]) else src
            body = src[2].encode()
        if src == (6, "http://h", tricky):      # refers to one of the two rows of page 7
            first = [x for x in got if x["main"]["record_id"] == r["main"]["refers_to"]]
            assert r["record_type"] == "revisit" and len(first) == 1 and first[0]["metadata"]["fields"]["key"] == "7"
            continue
        assert r["main"]["payload_digest"] == hashlib.sha1(body).hexdigest()
        assert int(r["metadata"]["fields"]["payloadLength"]) == len(body)
        revisit = src[2] == big and src[0] != 3
        assert r["record_type"] == ("revisit" if revisit else "response")
        if revisit:
            first = [x for x in got if x["main"]["record_id"] == r["main"]["refers_to"]]      # a record of the archive
            assert len(first) == 1 and first[0]["metadata"]["fields"]["key"] == "3" and r["main"]["payload"] is None
        else:
            assert bytes(r["main"]["payload"]) == body
    assert warc.captures(df.limit(0), str(tmp_path / "none")).count() == 0


def test_parse_records_rejects_cut_files():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [bytes(b) for _, b in warc.parse_records(one + one)] == [b"hello", b"hello"]
    with pytest.raises(ValueError):
        list(warc.parse_records(one[:-8]))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"junk" + one))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\im_endstart>a\n", max_size=40))
def test_escape_is_reversible_and_holds_no_marks(text):
    e = chat_format.escape(text)
    assert chat_format.unescape(e) == text and "<|" not in e
    turns = [("user", text), ("assistant", text), (text.replace("\n", ""), "")]
    assert chat_format.read_back(chat_format.render(turns)[0]) == turns


def test_chat_masks(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(30):
        turns = []
        for turn in range(rng.randint(1, 6)):
            text = "".join(rng.choice(["\n", " ", "word", ".<|im_end|>", "é", "日", "'s", "<\\|", "\n\n"])
                           for _ in range(rng.randint(0, 12)))
            turns.append((rng.choice(["user", "assistant", "system"]), text))
            rows.append((conv, turn, *turns[-1]))
        want[conv] = turns
    rows += [(99, 0, "user", None), (99, 1, None, "x"), (98, 0, "assistant", None)]
    want |= {99: [("user", ""), ("", "x")], 98: [("assistant", "")]}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0))
    full = chat_format.format_conversations(df, SPEC)
    got = {r["conv_id"]: r for r in chat_format.digest_formatted(full).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        h = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(turns), h, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in full.collect():
        assert len(r["ids"]) == len(r["loss_mask"])
    assert chat_format.format_conversations(df.limit(0), SPEC).count() == 0


def test_align_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 40, 12))
        offsets = np.stack([cuts[:-1], cuts[1:]], axis=1)
        ends = np.unique(rng.integers(0, 40, 6))
        spans = [(int(a), int(b)) for a, b in zip(ends[::2], ends[1::2])]
        mask = chat_format.align(offsets, spans)
        assert mask.tolist() == [any(a < y and x < b for a, b in spans) for x, y in offsets]


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_rules(spark):
    rng = random.Random(2)
    vocab = ["the", "of", "a", "é", "x|", "#", "\n", "\u000b", "\u00a0", "word", "\r\n", "and", "\u0085"]
    texts = [None, "", " ", "\n\n"] + [
        rng.choice([" ", "\n", "  "]).join(rng.choice(vocab[:rng.randint(2, len(vocab))])
                                           for _ in range(rng.randint(1, 120))) for _ in range(200)]
    texts += ["same " * 300, " ".join(f"w{i}" for i in range(30000)), texts[-1], texts[-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash")) \
        .withColumn("_w", F.lit(1)).withColumn("_t", F.lit("t")).withColumn("_row", F.lit(2)).withColumn("_text", F.lit("u"))
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert {(r["_w"], r["_t"], r["_row"], r["_text"]) for r in got.values()} == {(1, "t", 2, "u")}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                r["base_failed"]) == brute_counts(t), t
        assert not (r["kept"] and r["base_failed"])
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_rules_table(spark):
    good = " ".join(["the", "house", "of", "many", "windows", "stands", "by", "a", "river"] + [f"word{i}" for i in range(60)])
    bad = {"symbols": " ".join(w + "$$$" for w in good.split()), "marks": " ".join(w + "!!" for w in good.split()),
           "shout": good.upper(), "pipes": " | ".join(good.split()),
           "stops": " ".join(f"word{i}" for i in range(70)), "lines": "the line of it\n" * 2 + good.replace(" ", " ")}
    df = spark.createDataFrame([("good", good), *bad.items()], "doc_id string, text string")
    kept = {r["doc_id"]: r["failed_rules"] for r in quality_rules.judge(df).collect()}
    assert kept["good"] == [] and kept["lines"] == []
    assert "symbol_ratio" in kept["symbols"] and "mark_ratio" in kept["marks"]
    assert kept["shout"] == ["shout_ratio"] and "pipe_ratio" in kept["pipes"] and kept["stops"] == ["stop_ratio"]


def test_stop_words_of_other_languages(spark):
    texts = {
        "ru": "Дом у реки стоит давно и окна его смотрят на воду где летом плавают лодки ",
        "el": "Το σπίτι στέκεται κοντά στο ποτάμι και τα παράθυρα κοιτάζουν το νερό ",
        "pl": "Dom stoi nad rzeką od wielu lat i jest duży ale nie ma okien po drugiej stronie ",
        "nl": "Het huis staat al jaren aan het water maar niemand woont er met zijn kinderen ",
        "junk": "xq zzkw brrt plonk vrrm qqt wzx krrp ", "digits": "12 34 56 78 90 ",
    }
    rows = [(k, " ".join(w + str(i) if j % 3 == 0 else w for i in range(8) for j, w in enumerate(t.split())))
            for k, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    failed = {r["doc_id"]: "stop_ratio" in r["failed_rules"] for r in quality_rules.judge(df).collect()}
    assert failed == {"ru": False, "el": False, "pl": False, "nl": False, "junk": True, "digits": True}
    russian = quality_rules.judge(df, stop_words={"ru": ["ни", "бы"]}).where("doc_id = 'ru'").first()
    assert "stop_ratio" in russian["failed_rules"]      # its script has stop words now


URLS = ["http://A.Example.COM/en/x?y", "https://www.example.com/en/", "ftp://x.net/fr/1#f", "net/fr/", None, "",
        "http://example.com", "http://example.com?q=/en/", "http://notexample.com/en/a", "http://net/es/", "a://b://net/es/",
        "http://ÄX.net/es/é", "http://xnet/es/"]


def split_url(u):
    if not u or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    h = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), h), re.match(r"[^?#]*", rest[len(h):])[0]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)] * 2, "page_id long, url string, html string") \
        .withColumn("host", F.lit("clash"))
    for c in ("node", "_r", "_n", "_alias", "row", "u"):
        df = df.withColumn(c, F.lit(c))
    df = df.withColumn("html", F.when(F.col("page_id") == 6, F.lit("<link rel=canonical href=http://example.com/other>")))
    got = url_filters.filter_urls(df).collect()
    assert len(got) == 2 * len(URLS) and all(r[c] == c for r in got for c in ("node", "_r", "_n", "_alias", "row", "u"))
    for r in got:
        host, path = split_url(URLS[r["page_id"]])
        fit = [x for x in url_filters.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.name if best else None), URLS[r["page_id"]]
        assert r["verdict"] == (best.verdict if best else "allow")
    assert url_filters.filter_urls(df.limit(0)).count() == 0


def test_url_aliases(spark):
    def link(href):
        return f"<head><link href='{href}' rel=\"canonical\"></head>"
    pages = [
        (0, "http://a.org/1", link("http://b.net/fr/2")),                      # alias of a blocked url
        (1, "http://b.net/fr/2#x", None),
        (2, "http://c.org/3", '<META content="0; url=/4" http-equiv=refresh>'),   # chain over 4 to a blocked url
        (3, "http://c.org/4", link("http://b.net/es/9?a=1&amp;b=2")),
        (4, "http://d.org/5", link("http://b.net/fr/2") + '<meta http-equiv="refresh" content="1;url=http://e.com/6">'),
        (5, "http://e.com/6", None),                                           # allowed: its aliases are
        (6, "http://f.org/7", link("//f.org/8")), (7, "http://f.org/8", "<p>"), (8, None, link("http://b.net/fr/2")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in url_filters.filter_urls(df).collect()}
    # 0, 1 and 4 are one component with 5, which is allowed by rule; 1 keeps its own rule
    assert got == {0: ("allow", "alias"), 1: ("block", "rule"), 2: ("block", "alias"), 3: ("block", "alias"),
                   4: ("allow", "alias"), 5: ("allow", "rule"), 6: ("allow", "default"), 7: ("allow", "default"),
                   8: ("allow", "default")}
    moved = spark.createDataFrame([("http://f.org/8", "HTTP://B.net/fr/2")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(
        df.where("page_id in (1, 6, 7)"), redirects=moved).collect()}
    assert got == {1: "block", 6: "block", 7: "block"}


def test_links_in_all_forms(spark):
    pages = [
        ("http://a.org/1", "<link rel=canonical href=https://b.net/fr/1>"),
        ("http://a.org/2", "<LINK href=//b.net/fr/2 rel=canonical><link rel='canonical' href='/x2' />"),
        ("http://a.org/3", '<link rel="canonical"href="/x3">\n<link rel=stylesheet href=no.css><link rel=canonical href=x4>'),
        ("http://a.org/4", "<meta http-equiv=refresh content=0;url=/y4><meta http-equiv='refresh' content='1; url=/z4'>"),
        ("http://a.org/5", "<link rel=canonical data-href=/no href=/q?href=1&amp;b=2><meta http-equiv=refresh content='0'>"),
        ("http://a.org/6", "<link rel=canonical href=''><link rel=canonical href><link rel=icon href=/no>"),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {(r["src"], r["dst"]) for r in url_filters.page_edges(df).collect()}
    assert got == {("http://a.org/1", "https://b.net/fr/1"), ("http://a.org/2", "http://b.net/fr/2"),
                   ("http://a.org/2", "http://a.org/x2"), ("http://a.org/3", "http://a.org/x3"),
                   ("http://a.org/3", "http://a.org/x4"), ("http://a.org/4", "http://a.org/y4"),
                   ("http://a.org/4", "http://a.org/z4"), ("http://a.org/5", "http://a.org/q?href=1&b=2")}
    judged = {r["url"]: (r["verdict"], r["decided_by"]) for r in url_filters.filter_urls(df).collect()}
    assert judged["http://a.org/1"] == judged["http://a.org/2"] == ("block", "alias")


def test_template_vocabulary_has_its_marks():
    t = chat_format.load_tokenizer(open(SPEC, encoding="utf-8").read())
    ids = t.encode("<|im_start|>x<|im_end|>", add_special_tokens=False).ids
    assert len(ids) == 3 and json.loads(open(SPEC, encoding="utf-8").read())["model"]["type"] == "BPE"
