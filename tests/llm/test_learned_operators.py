"""Quality network, language identification and toxicity: held-out accuracy and
edge cases; the pipeline against a brute-force run of its parts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import langid, quality_cnn, toxicity
from lexiforge.llm.common import fold, table
from tests.conftest import SF

DATA = SF.replace("sf0.001", "sf0.01")


def test_fold(spark):
    df = spark.createDataFrame([(0,), (17,), (123456,)], "doc_id long")
    got = [r[0] for r in df.select(fold("doc_id", 5)).collect()]
    assert got == [zlib.crc32(str(d).encode()) % 5 for d in (0, 17, 123456)]


def chunk_features(net, text):
    """The network's features by plain loops."""
    b = text.encode() + bytes(quality_cnn.WIDTH)
    reach = max(len(text.encode()) - quality_cnn.WIDTH + 1, 1)
    z = np.array([sum(net.filters[j][b[i + j]] for j in range(quality_cnn.WIDTH)) for i in range(reach)])
    hops = np.array([z[i:i + quality_cnn.HOP].max(axis=0) for i in range(0, reach, quality_cnn.HOP)])
    a = np.tanh(hops)
    chunks = np.array([np.maximum(a[i], a[i + 1]) for i in range(len(a) - 1)]) if len(a) > 1 else a
    f = quality_cnn.fill(np.array([len(text.encode())]))[0]
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0),
                           (1 - f[0]) * chunks.mean(axis=0), f])


def test_network_scores_whole_texts():
    rng = np.random.default_rng(1)
    k, h = quality_cnn.FILTERS, quality_cnn.HIDDEN
    net = quality_cnn.Network(rng.normal(0, 0.5, (quality_cnn.WIDTH, 256, k)).astype(np.float32),
                              rng.normal(0, 0.5, (4 * k + quality_cnn.FILLS, h)), np.zeros(h), rng.normal(0, 1, h), 0.1)
    texts = ["", "a", "abcd", "é" * 100, "x" * 255, "y" * 256, "word " * 51 + "end", "the quick brown fox " * 200, "z" * 70000]
    got = quality_cnn.Scorer(net, block=1000).score(pa.array([*texts, None]))
    want = net.head(np.array([chunk_features(net, t) for t in [*texts, ""]]))
    assert np.allclose(got, want, atol=1e-4)


def test_quality_network_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    net = quality_cnn.learn(docs, labels.where(fold("doc_id", 5) != 0))
    out = quality_cnn.score_quality(docs, net).join(labels, "doc_id").where(fold("doc_id", 5) == 0)
    rows = [(r["quality"], r["score"] >= 0.3) for r in out.collect()]
    assert np.mean([y == p for y, p in rows]) >= 0.93
    extra = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (1, "", "y")], "doc_id long, text string, score string")
    got = quality_cnn.score_quality(extra, net).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    kept = quality_cnn.keep_good(docs, net)
    assert kept.columns == docs.columns
    assert quality_cnn.score_quality(docs.limit(0), net).count() == 0
    nothing = quality_cnn.learn(docs, labels.limit(0))
    assert quality_cnn.score_quality(extra, nothing).first()["score"] == 0.5


def test_language_held_out(spark):
    docs = table(spark, DATA, "documents")
    filters = langid.learn(docs.where(fold("doc_id", 3) != 1))
    out = langid.identify(docs, filters).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 3) == 1)
    rows = out.where("lang IS NOT NULL").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
    odd = spark.createDataFrame([(1, None, "l"), (2, "", "l"), (3, "12 !", "l"), (4, "é", "l"), (4, "é", "l")],
                                "doc_id long, text string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"] == "und", r["score"]) for r in langid.identify(odd, filters).collect()]
    assert got[:3] == [(1, True, 0.0), (2, True, 0.0), (3, True, 0.0)]
    assert not got[3][1] and got[3] == got[4]
    assert langid.identify(odd.limit(0), filters).count() == 0
    empty = langid.learn(docs.limit(0))
    assert langid.identify(odd, empty).where("lang_pred != 'und'").count() == 0


def test_gram_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y"]), "".join(rng.choice("abÉ ") for _ in range(rng.randint(0, 20)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {(r["lang"], r["gram"]): r["n"] for r in langid.gram_counts(df, "text", "lang").collect()}
    want = {}
    for lang, t in rows:
        b = t.lower().encode()
        for i in range(len(b) - 3):
            k = (lang, int.from_bytes(b[i:i + 4], "big"))
            want[k] = want.get(k, 0) + 1
    assert got == want


def members(spark, grams):
    """(level, lang, gram): all grams at level 0, every third at level 1 too."""
    parts = [(pa.array(np.full(len(g), t, np.int32)), pa.array([k] * len(g)), pa.array(g.astype(np.int64)))
             for k, own in grams.items() for t, g in ((0, own), (1, own[::3]))]
    return spark.createDataFrame(pa.concat_tables(
        [pa.Table.from_arrays(list(p), ["level", "lang", "gram"]) for p in parts]))


@pytest.mark.parametrize("n_languages,n_grams,most", [(3, 300, 1 << 27), (70, 300, 1 << 27), (5, 4000, 1 << 15)])
def test_filters_hold_all_their_grams(spark, n_languages, n_grams, most):
    """Also where the tables are too small for the grams: only false positives grow."""
    rng = np.random.default_rng(2)
    grams = {f"l{i:02}": np.unique(rng.integers(0, 2 ** 32, n_grams)) for i in range(n_languages)}
    f = langid.build_filters(members(spark, grams), {k: 1 for k in grams}, max_bytes=most)
    assert f.slots.nbytes <= most
    other = rng.integers(0, 2 ** 32, 20000)
    for i, name in enumerate(f.languages):
        for t, own in ((0, grams[name]), (1, grams[name][::3])):
            masks = f.masks(own, i // 64)[t]
            kind = masks.dtype.type
            assert (((masks >> kind(i % 64)) & kind(1)) == 1).all()
            seen = ((f.masks(other, i // 64)[t] >> kind(i % 64)) & kind(1)).mean()
            assert abs(seen - f.false_rate[t, i]) < 0.03


def test_a_hundred_languages_of_50000_grams(spark):
    grams = {f"l{i:03}": np.unique(np.random.default_rng(i).integers(0, 2 ** 32, 50_000)) for i in range(100)}
    f = langid.build_filters(members(spark, grams), {k: 1 for k in grams})
    assert f.slots.nbytes <= langid.MAX_BYTES and f.false_rate.max() < 0.05
    for i in (0, 63, 64, 99):
        masks = f.masks(grams[f.languages[i]], i // 64)[0]
        assert ((masks >> np.uint64(i % 64)) & np.uint64(1)).all()


def test_rare_grams_are_known(spark):
    """A gram of one row among many is held, for every language that has it."""
    rows = [("x", "aaaa bbbb " * 3000), ("y", "cccc dddd " * 3000), ("x", "qxqxq"), ("y", "zyzyz"), ("y", "bbbb")]
    f = langid.learn(spark.createDataFrame(rows, "lang string, text string"), min_rate=0.01)
    got, score = langid.identify_texts(pa.array(["qxqxq", "zyzyz", "aaaa bbbb", "wholly unknown"]), f)
    assert got == ["x", "y", "x", "y"] and min(score[:3]) > 0.5 and score[3] == 0
    both = f.masks(np.array([int.from_bytes(b"bbbb", "big")]), 0)
    assert both[0][0] == 3 and both[1][0] == 1


@pytest.mark.parametrize("reverse", [False, True])
def test_contradictory_labels_take_the_larger(spark, reverse):
    rows = [(i, y) for i in range(40) for y in ((0, 1) if i % 2 else (0, 0))]
    labels = spark.createDataFrame(rows[::-1] if reverse else rows, "doc_id long, toxic int").repartition(7)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    got = {r["key"]: r["y"] for r in toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic").collect()}
    assert got == {i: i % 2 for i in range(40)}
    net = quality_cnn.learn(docs, labels.withColumnRenamed("toxic", "quality").where("doc_id % 2 = 1"))
    assert net.prior == 1.0


def test_folding():
    fold_text = toxicity.Folder()
    assert fold_text("IDIOT") == fold_text("1d10t") == fold_text("i.d.i.o.t") == fold_text("ıdiot".replace("ı", "i"))
    assert fold_text("іdіоt") == " idiot "          # Cyrillic letters
    assert fold_text("ｉｄｉｏｔ") == " idiot "          # full width
    assert fold_text("$tupid idi0t!") == " stupid idiot "
    assert fold_text("born 1984, room 7") .split() == ["born", "room"]
    assert fold_text(None or "").strip() == ""


def test_matches_by_brute_force():
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " lowe": 2.0, " loweiz": 3.0, " trash ": 3.5})
    m = toxicity.Matcher(lexicon)
    assert sorted(m.hits(m.folder("an idiot, lowei loweizen below idiots trash")).values()) == [2.0, 3.0, 3.5, 4.0]
    assert m.hits(m.folder("put it in the trash can")) == {}
    assert m.score("")[0] == m.score(None)[0] < m.score("idiot")[0]
    assert m.score("idiot " + "word " * 1000)[0] < m.score("idiot word")[0]


def test_toxicity_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    lexicon = toxicity.learn(docs, labels.where(fold("doc_id", 3) != 1))
    out = toxicity.score_toxicity(docs, lexicon).join(labels, "doc_id").where(fold("doc_id", 3) == 1)
    rows = [(r["toxic"], int(r["score"] >= 0.7)) for r in out.collect()]
    assert np.mean([y == p for y, p in rows]) >= 0.95
    assert not any(p for y, p in rows if y == 0)
    odd = spark.createDataFrame([(1, None, 1), (1, "", 1), (1, "", 1)], "doc_id long, text string, n_hits int")
    got = toxicity.score_toxicity(odd, lexicon).collect()
    assert len({(r["score"], r["n_hits"]) for r in got}) == 1 and got[0]["score"] < 0.7
    assert toxicity.score_toxicity(odd.limit(0), lexicon).count() == 0
    assert toxicity.learn(docs, labels.where("toxic = 0")).weights == {}
    assert toxicity.learn(docs.limit(0), labels).weights == {}


def test_sample_is_bounded(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    picked = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 10, 20)
    n = {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 10, 0: 20}
    assert picked.select("key").distinct().count() == 30


def test_copies_and_rare_words_in_the_toxicity_sample(spark):
    rng = random.Random(8)

    def coin():
        return "".join(rng.choice("abcdefghklmnoprstuvwxyz") for _ in range(8))

    common, real, rare = [coin() for _ in range(60)], [coin() for _ in range(10)], [coin() for _ in range(3)]
    long = " ".join(coin() for _ in range(1500))
    toxic = [long] * 150 + [" ".join(rng.choices(common, k=30) + rng.sample(real, 2)) for _ in range(241)]
    toxic += [" ".join(rng.choices(common, k=30) + [w]) for w in rare for _ in range(3)]
    clean = [" ".join(rng.choices(common, k=32)) for _ in range(1000)]
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(docs.drop("toxic"), docs.drop("text"))
    m = toxicity.Matcher(lexicon)
    assert all(m.hits(m.folder(w)) for w in real + rare)
    assert sum(m.score(t)[0] >= 0.7 for t in toxic[150:391]) == 241
    assert not any(m.score(t)[0] >= 0.7 for t in clean)


def test_cover_passes_over_words_of_one_text_and_keeps_longer_words():
    texts = [[" idiot ", f" own{i} "] for i in range(5)] + [[" idiotic "]] * 2 + [[" lowe", " loweiz"]] * 2
    candidates = {t: (1, 1.0) for x in texts for t in x}
    assert toxicity.cover(texts, candidates) == [" idiot ", " lowe", " idiotic "]
