"""Combos re-assembled by one grouping; rows with null or repeated ids stay."""

from pyspark.sql import functions as F

from lexiforge.operators import qa
from lexiforge.operators.nest import ComboTables, nest_combos


def tables(spark):
    combos = spark.createDataFrame(
        [("c1", "m", "U", "s1\ns2", None), ("c2", "m", "W", None, "x"), ("c2", "n", "B", None, None), (None, "q", None, None, None)],
        "combo_id string, manaNeeded string, identity string, steps string, otherPrerequisites string")
    cards = spark.createDataFrame(
        [("c1", 1, "k2", "Beta", ["G", "E"]), ("c1", 0, "k1", "Alpha", ["B"]), ("c2", 0, "k9", "Gamma", ["H"]),
         (None, 0, "k0", "Lost", ["B"]), ("c7", 0, "k7", "Alone", ["B"])],
        "combo_id string, pos int, card_id string, card_name string, zone_locations array<string>")
    requires = spark.createDataFrame([("c1", 0, 5, "Any")], "combo_id string, pos int, require_id long, require_name string")
    features = spark.createDataFrame([("c1", 0, 1, "ETB"), ("c2", 1, 3, "LTB"), ("c2", 0, 2, "Win")],
                                     "combo_id string, pos int, feature_id long, feature_name string")
    return ComboTables(combos, cards, requires, features)


def test_null_and_repeated_ids(spark):
    rows = nest_combos(tables(spark)).select(
        "combo_id", "manaNeeded", F.col("cards.card_name").alias("c"), F.col("features.feature_name").alias("f"),
        F.col("requires.require_name").alias("r")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        ("c1", "m", ["Alpha", "Beta"], ["ETB"], ["Any"]), ("c2", "m", ["Gamma"], ["Win", "LTB"], None),
        ("c2", "n", ["Gamma"], ["Win", "LTB"], None), (None, "q", [], [], None)], key=str)


def test_one_shuffle_of_the_fields_used(spark):
    pairs = qa.combo_pairs(tables(spark))
    assert pairs.count() == 4
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1 and "require_id" not in plan.split("Aggregate")[1].split("\n")[0]
