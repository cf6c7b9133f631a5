"""Typed readers (S-1, S-8) and the checkpoint-folder rule."""

import json

import pytest

from lexiforge.sources import cards as src


def test_read_printings_csv_keeps_text(spark, tmp_dir):
    path = f"{tmp_dir}/printings.csv"
    with open(path, "w") as f:
        f.write("uuid,name,manaValue,power\nu1,Alpha,3.0,*\nu2,Beta,,1\n")
    df = src.read_printings(spark, path, fmt="csv")
    rows = {r.uuid: r for r in df.collect()}
    assert rows["u1"].manaValue == "3.0" and rows["u1"].power == "*"   # never cast
    assert rows["u2"].manaValue is None
    assert dict(df.dtypes)["edhrecRank"] == "int"


def test_read_static_qa_json(spark, tmp_dir):
    path = f"{tmp_dir}/rules.json"
    with open(path, "w") as f:
        json.dump([{"question": "What is a turn?", "answer": "Phases in order."},
                   {"question": "Who goes first?", "answer": "The starting player."}], f, indent=1)
    df = src.read_static_qa(spark, path)
    assert df.columns == ["question", "answer"] and df.count() == 2


def test_checkpoint_folder_from_session(spark):
    from lexiforge.session import ensure_checkpoint_dir
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_materialize_cuts_lineage(spark):
    from lexiforge.session import materialize
    df = spark.range(10).selectExpr("id * 2 AS x")
    m = materialize(df, "t")
    assert sorted(r.x for r in m.collect()) == list(range(0, 20, 2))
    assert "Range" not in m._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bad", ["", None])
def test_static_pairs_shape(spark, bad):
    from lexiforge.operators.qa import static_pairs
    t = spark.createDataFrame([("q", bad)], "question string, answer string")
    assert static_pairs(t, "rules").columns == ["builder", "question", "answer"]


def test_streaming_keep_first_matches_batch(spark, tmp_dir):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lexiforge.streaming.keep_first import maintain_canonical, read_canonical
    from tests.fixtures import printings_df
    first = printings_df(spark, [dict(uuid="u5", name="A"), dict(uuid="u3", name="B", side="a"),
                                 dict(uuid="u9", name="C")])
    second = printings_df(spark, [dict(uuid="u1", name="A"), dict(uuid="u7", name="B", side="a"),
                                  dict(uuid="u2", name="B", side="b"), dict(uuid="u0", name="D")])
    src, target = f"{tmp_dir}/src", f"{tmp_dir}/canon"
    first.write.parquet(f"{src}/b1")
    maintain_canonical(spark, f"{src}/*", first.schema, target, f"{tmp_dir}/ck", buckets=4) \
        .awaitTermination(120)
    second.write.parquet(f"{src}/b2")
    maintain_canonical(spark, f"{src}/*", first.schema, target, f"{tmp_dir}/ck", buckets=4) \
        .awaitTermination(120)
    got = sorted((r.name, r.side, r.uuid) for r in read_canonical(spark, target).collect())
    allrows = first.unionByName(second)
    w = Window.partitionBy("name", "side").orderBy("uuid")
    want = sorted((r.name, r.side, r.uuid) for r in
                  allrows.withColumn("rn", F.row_number().over(w)).where("rn = 1").collect())
    assert got == want


def test_broken_combo_document_is_reported(spark, tmp_dir):
    from lexiforge.sources import combos
    for name, text in (("good.json", json.dumps({"variants": [{"id": "1"}, {"id": "2"}]})), ("bad.json", "{broken")):
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
    assert combos.read_variants_json(spark, f"{tmp_dir}/good.json").count() == 2
    assert combos.broken_documents(spark, f"{tmp_dir}/good.json").count() == 0
    broken = combos.broken_documents(spark, tmp_dir).collect()
    assert len(broken) == 1 and broken[0].path.endswith("bad.json")
    with pytest.raises(Exception, match="broken combo document"):
        combos.read_variants_json(spark, tmp_dir).collect()


def test_versions_ask_the_file_system(spark, tmp_dir):
    from lexiforge.versions import versions
    assert versions(spark, tmp_dir) == versions(spark, f"file://{tmp_dir}/none") == []
    with pytest.raises(Exception, match="nosuchscheme"):
        versions(spark, "nosuchscheme://host/x")


@pytest.mark.parametrize("stop", ["write", "publish"])
def test_keep_first_survives_a_stop(spark, tmp_dir, monkeypatch, stop):
    """A batch that stops before or after its files are written loses no stored row,
    and its replay gives the whole result."""
    from lexiforge.streaming import keep_first
    from tests.fixtures import printings_df
    target = f"{tmp_dir}/canon"
    first = printings_df(spark, [dict(uuid=f"u{i}", name=f"N{i}") for i in range(20)])
    second = printings_df(spark, [dict(uuid=f"a{i}", name=f"N{i}") for i in range(0, 20, 2)] + [dict(uuid="z", name="new")])
    keep_first.merge_batch(first, target, buckets=4)

    def rows():
        return sorted((r.name, r.uuid) for r in keep_first.read_canonical(spark, target).collect())
    before = rows()
    with monkeypatch.context() as m:
        def stopped(*args, **kwargs):
            raise RuntimeError("stopped")
        m.setattr(keep_first, "publish" if stop == "publish" else "new_folder", stopped)
        with pytest.raises(RuntimeError, match="stopped"):
            keep_first.merge_batch(second, target, buckets=4)
    assert rows() == before
    want = sorted([(f"N{i}", f"a{i}" if i % 2 == 0 else f"u{i}") for i in range(20)] + [("new", "z")])
    for _ in range(2):       # a batch may be replayed after its publish, too
        keep_first.merge_batch(second, target, buckets=4)
        assert rows() == want
    assert sorted((r.name, r.uuid) for r in keep_first.read_canonical(spark, target, 1).collect()) == before
    with pytest.raises(FileNotFoundError):
        keep_first.read_canonical(spark, f"{tmp_dir}/none")


def test_store_of_snapshots(spark, tmp_dir):
    from lexiforge.operators import corpus
    kind = "group string, builder string, conversations array<struct<role:string,content:string>>"
    def qa(group, n):
        return spark.createDataFrame([(group, "b", [("user", f"q{i}"), ("assistant", None if i else "yes")]) for i in range(n)], kind)
    path = f"{tmp_dir}/qa"
    assert corpus.corpus_groups(spark, path) == []
    counts = corpus.write_corpus(qa("a/b=c", 3).unionByName(qa("cards", 2)), path)
    assert counts == {"a/b=c": {"rows": 3, "chars": 9}, "cards": {"rows": 2, "chars": 7}}
    corpus.write_corpus(qa("cards", 4), path, mode="append")
    assert corpus.corpus_manifest(spark, path)["cards"]["rows"] == 6
    assert corpus.load_corpus(spark, path, "cards").count() == 6 and corpus.load_corpus(spark, path, "cards", "a/b=c", "cards").count() == 9
    corpus.write_corpus(qa("rules", 1), path)
    assert corpus.corpus_groups(spark, path) == ["rules"]
    assert corpus.load_corpus(spark, path, "cards", version=1).count() == 2       # earlier versions stay
    with pytest.raises(ValueError, match="no such group"):
        corpus.load_corpus(spark, path, "cards")
    with pytest.raises(ValueError, match="without a group"):
        corpus.write_corpus(qa(None, 1), path)
    assert corpus.corpus_groups(spark, path) == ["rules"]
    with pytest.raises(ValueError, match="mode"):
        corpus.write_corpus(qa("rules", 1), path, mode="ignore")
    assert corpus.load_corpus(spark, path, "rules").columns == ["builder", "conversations", "group"]
