"""The pipeline against a plain, single-machine run of its five steps."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from lexiforge.llm import decontamination, quality_cnn, quality_rules
from lexiforge.llm.common import fold, table
from tests.conftest import SF
from tests.llm.test_exact_operators import brute_counts
from tests.llm.test_learned_operators import chunk_features
from tests.llm.test_search_operators import brute_join, words


def passes_rules(text):
    """The threshold table by plain Python."""
    t = text or ""
    w = regex.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in t)
    again = [False] * len(w)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for places in seen.values():
        for i in places if len(places) > 1 else ():
            again[i:i + 3] = [True] * 3
    repeats = sum(again)
    if len(w) < 50 or 100 * repeats > 50 * len(w):
        return False
    bare = [x.lower().rstrip(".,;:!?") for x in w]
    letters = regex.findall(r"\p{L}", t)
    stop = {x for ws in quality_rules.STOP_WORDS.values() for x in ws}
    further = {x for ws in quality_rules.FURTHER_WORDS.values() for x in ws} - stop
    dup = len(lines) - len(set(lines))
    value = {
        "mean_word_chars": sum(map(len, w)) / len(w), "symbol_ratio": symbols / len(w),
        "mark_ratio": sum(c in "!?" for c in t) / len(w), "pipe_ratio": w.count("|") / len(w),
        "shout_ratio": sum(bool(regex.match(r"\p{Lu}", c)) for c in letters) / len(letters) if letters else 0.0,
        "stop_ratio": sum(x in stop for x in bare) / len(w), "dup_line_ratio": dup / len(lines),
        "repeat_ratio": repeats / len(w)}
    for r in quality_rules.RULES:
        v = value[r.metric]
        if r.high is not None and v > r.high:
            return False
        if r.low is not None and v < r.low:
            foreign = sum(not regex.match(r"\p{Script=Latin}", c) for c in letters)
            spared = r.metric == "stop_ratio" and (
                2 * foreign > len(letters) or sum(x in further for x in bare) >= r.low * len(w))
            if not spared:
                return False
    return True


def brute_pipeline(docs, items, net):
    """(doc_id, text) -> what each step keeps, and the last step's digests."""
    kept = [[(d, t) for d, t in docs if passes_rules(t)]]
    kept.append([(d, t) for d, t in kept[-1] if net.head(chunk_features(net, t)[None])[0] >= 0.3])
    groups = brute_join(kept[-1])
    kept.append([(d, t) for d, t in kept[-1] if groups[d][0] == 0 or groups[d][1] == d])
    number = {}

    def coded(text):
        return np.array([number.setdefault(w, len(number) + 1) for w in words(text)], np.uint64)

    own = [coded(x) for x in items if words(x)]

    def clean(text):
        t = coded(text)
        return not any(len(t) and decontamination.infix_distance(x, t) <= (int(0.2 * len(x)) if len(x) >= 5 else 0)
                       for x in own)

    kept.append([(d, t) for d, t in kept[-1] if clean(t)])
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    out = {}
    for d, t in kept[-1]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        said = tokenizer.decode(ids, skip_special_tokens=False)
        out[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(said.encode()).hexdigest())
    return [sorted(d for d, _ in step) for step in kept], out


def test_pipeline_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    net = quality_cnn.learn(table(spark, SF, "documents"), table(spark, SF, "labels").where(fold("doc_id", 5) != 0))
    steps, want = brute_pipeline(docs, items, net)
    assert len(docs) > len(steps[0]) > len(steps[2]) > len(steps[3]) > 0       # the fixture reaches every step
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_brute_rules_count_as_the_operator_does(spark):
    docs = table(spark, SF, "documents")
    for r in quality_rules.judge(docs).select("text", "n_words", "n_repeat_words", "kept").collect():
        assert brute_counts(r["text"])[0] == r["n_words"] and passes_rules(r["text"]) == r["kept"]


def test_pipeline_over_empty_tables_and_odd_rows(spark, tmp_path):
    """Empty tables, no labels, null and repeated rows, and columns that stages could clash with."""
    sizes = {"documents": pq.read_table(f"{SF}/documents.parquet"), "labels": pq.read_table(f"{SF}/labels.parquet"),
             "benchmark": pq.read_table(f"{SF}/benchmark.parquet")}
    for name, t in sizes.items():
        pq.write_table(t.slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    body = " ".join(f"the river{i} of hill{i}" for i in range(40))
    given = [(1, body), (1, body), (2, None), (None, body + " other end of it"), (3, ""), (None, None)]
    kind = sizes["documents"].schema
    rows = pa.table({"doc_id": pa.array([d for d, _ in given], kind.field("doc_id").type),
                     "text": pa.array([t for _, t in given], kind.field("text").type),
                     "lang": pa.array([None] * 6, kind.field("lang").type), "source": pa.array([None] * 6, kind.field("source").type),
                     "n_chars": pa.array([None] * 6, kind.field("n_chars").type), "score": ["s"] * 6, "kept": ["k"] * 6})
    odd = tmp_path / "odd"
    odd.mkdir()
    pq.write_table(rows, odd / "documents.parquet")
    for name in ("labels", "benchmark"):
        pq.write_table(sizes[name].slice(0, 0), odd / f"{name}.parquet")
    docs = table(spark, str(odd), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(odd))
        assert docs.columns == rows.schema.names
    assert [(r["doc_id"], r["score"], r["kept"]) for r in docs.collect()] == [(1, "s", "k")]
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, str(odd)).collect()] == [1]
