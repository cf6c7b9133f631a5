"""Canonical rows (J-1, J-2, W-1, A-1, E-2), typed scan (S-4) and lookups
(E-3..E-9, A-2, A-4) on card-shaped edge rows; plan-shape checks."""

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import lookup
from lexiforge.operators.canonical import canonical_rows, typed_cards
from tests.fixtures import legal_df, printings_df, rulings_df


def _explain(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    pr = printings_df(spark, [
        # row 1: same name, side null; only the higher uuid is legal
        dict(uuid="u1", name="Alpha", manaValue="3.0"),
        dict(uuid="u2", name="Alpha", manaValue="3.0"),
        # row 2: both legal; rulings only on the higher one
        dict(uuid="b1", name="Beta", manaValue="0.0"),
        dict(uuid="b2", name="Beta", manaValue="1.0"),
        # row 3: duplicate legality rows for one uuid
        dict(uuid="c1", name="Gamma", manaValue="2.0", edhrecRank=40000),
        # row 4: split card, two sides
        dict(uuid="d1", name="X // Y", side="a", manaValue="1.0"),
        dict(uuid="d2", name="X // Y", side="b", manaValue="2.0"),
        # not legal at all
        dict(uuid="e1", name="Delta"),
    ])
    leg = legal_df(spark, [("u1", "Banned"), ("u2", "Legal"), ("b1", "Legal"), ("b2", "Legal"),
                           ("c1", "Legal"), ("c1", "Legal"), ("d1", "Legal"), ("d2", "Legal"),
                           ("e1", "Banned")])
    rul = rulings_df(spark, [("b2", "only on b2"), ("c1", "second"), ("c1", "first"),
                             ("c1", None), ("d1", "split rule")])
    return pr, leg, rul


def test_canonical_rows(spark, tables):
    rows = {r.uuid: r for r in canonical_rows(*tables).collect()}
    assert set(rows) == {"u2", "b1", "c1", "d1", "d2"}          # filter before rank, one per (name, side)
    assert rows["b1"].rulings is None                          # rulings of b2 do not attach (J-2)
    assert rows["c1"].rulings == "first\nsecond"               # nulls skipped, fixed order (A-1)
    assert rows["d1"].rulings == "split rule"
    assert rows["c1"].edhrecRank == 40000


def test_typed_cards(spark, tables):
    t = typed_cards(canonical_rows(*tables))
    assert "cmc" in t.columns and "manaValue" not in t.columns
    got = {r.uuid: r.cmc for r in t.collect()}
    assert got == {"u2": 3, "b1": 0, "c1": 2, "d1": 1, "d2": 2}
    assert dict(t.schema.fields[t.columns.index("cmc")].jsonValue())["type"] == "integer"


def test_canonical_plan_shape(spark, tables):
    plan = _explain(canonical_rows(*tables))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    df = canonical_rows(*tables)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in final or "WindowGroupLimit" in plan


def test_lookups(spark, tables):
    cards = typed_cards(canonical_rows(*tables)).cache()
    assert lookup.card_by_id(cards, "c1").first().name == "Gamma"
    assert lookup.card_by_id(cards, "zz").count() == 0
    assert lookup.card_by_name(cards, "X // Y").first().uuid == "d1"  # first = lowest key
    with pytest.raises(ValueError):
        lookup.card_by_name(cards, "")
    assert sorted(r.uuid for r in lookup.cards_by_cmc(cards, 2).collect()) == ["c1", "d2"]
    assert [r.cmc for r in lookup.distinct_sorted(cards).collect()] == [0, 1, 2, 3]
    req = spark.createDataFrame([("X // Y",), ("Nope",)], "q string")
    assert [r.uuid for r in lookup.first_by_name(cards, req, "q").collect()] == ["d1"]
    ids = spark.createDataFrame([("c1",), ("c1",), ("zz",)], "q string")
    assert lookup.cards_by_ids(cards, ids, "q").count() == 2
    cards.unpersist()


def test_value_counts(spark):
    df = spark.createDataFrame([("normal",), ("split",), ("normal",), (None,)], "layout string")
    assert [tuple(r) for r in lookup.value_counts(df, "layout").collect()] == [("normal", 2), ("split", 1)]


def test_code_searches(spark):
    from tests.fixtures import cards_df
    cards = cards_df(spark, [dict(uuid="1", colorIdentity="W"), dict(uuid="2", colorIdentity="WU"),
                             dict(uuid="3", colorIdentity="WUB"), dict(uuid="4", colorIdentity="WRG"),
                             dict(uuid="5", manaCost="{2}{W}", colors="W, U", type="Basic Land — Island"),
                             dict(uuid="6", manaCost="{W}", type="Island")])
    ids = lambda df: sorted(r.uuid for r in df.collect())
    assert ids(lookup.cards_by_color_identity(cards, "WB")) == []
    assert ids(lookup.cards_by_color_identity(cards, "Azorius")) == ["2", "3"]
    assert ids(lookup.cards_by_mana_cost(cards, "{2}{W}")) == ["5"]
    assert ids(lookup.cards_by_color(cards, "Blue")) == ["5"]
    assert ids(lookup.cards_by_type(cards, "land")) == ["5", "6"]
    assert ids(lookup.cards_by_type(cards, "land", word=True)) == ["5"]
    m = lookup.multi_search(cards, [({"s": "wu"}, lookup.identity_predicate("WU")),
                                    ({"s": "land"}, lookup.type_predicate("Land"))], keep=["uuid"])
    assert sorted((r.s, r.uuid) for r in m.collect()) == [
        ("land", "5"), ("land", "6"), ("wu", "2"), ("wu", "3")]
    assert "Union" not in _explain(m)


def test_filtered_cards_sink_roundtrip(spark, tables, tmp_dir):
    from lexiforge.sources import cards as src
    pr, leg, rul = tables
    pr.write.parquet(f"{tmp_dir}/p")
    leg.write.parquet(f"{tmp_dir}/l")
    rul.write.parquet(f"{tmp_dir}/r")
    src.build_filtered_cards(spark, f"{tmp_dir}/p", f"{tmp_dir}/l", f"{tmp_dir}/r", f"{tmp_dir}/out")
    src.build_filtered_cards(spark, f"{tmp_dir}/p", f"{tmp_dir}/l", f"{tmp_dir}/r", f"{tmp_dir}/out")  # skipped
    cards = src.read_cards(spark, f"{tmp_dir}/out")
    assert cards.count() == 5 and "colorIdentityName" in cards.columns
    assert cards.where(F.col("uuid") == "u2").first().cmc == 3
