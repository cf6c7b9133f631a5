"""QA builders (B-1..B-19), registry (X-1), union and corpus store (U-1, U-2,
S-5..S-8), combo shred/nest (S-2, N-1..N-4, J-3) and streaming equivalence."""

import json

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import qa
from lexiforge.operators.canonical import typed_cards
from lexiforge.operators.corpus import corpus_groups, load_corpus, write_corpus
from lexiforge.operators.nest import nest_combos
from lexiforge.sources.combos import load_combos, read_variants_json
from tests.fixtures import cards_df

CARDS = [
    # row 7: manaCost null with Land / without
    dict(uuid="1", name="Plains Field", type="Basic Land — Plains", manaValue="0.0", side=None),
    dict(uuid="2", name="Odd Spell", type="Instant", manaValue="2.0"),
    dict(uuid="3", name="Knight", type="Creature — Knight", manaCost="{1}{W}", manaValue="2.0",
         power="*", toughness="2", colors="W, U", colorIdentity="U, W", rarity="rare",
         rulings="b rule\na rule\n", text="Flying"),
    # row 4/5 split names
    dict(uuid="4", name="Fire // Ice", side="a", manaCost="{1}{R}", manaValue="2.0", colorIdentity=""),
    dict(uuid="5", name="Fire // Ice", side="b", manaCost="{1}{U}", manaValue="2.0"),
    dict(uuid="6", name="Odd//Name", side="b", manaValue="4.0", loyalty="3"),
]


@pytest.fixture
def cards(spark):
    return typed_cards(cards_df(spark, CARDS))


def pairs(df, builder):
    return sorted((r.uuid, r.question, r.answer) for r in df.where(F.col("builder") == builder).collect())


def test_fanout_default(spark, cards):
    out = qa.fanout(cards, qa.card_templates(False), keep=["uuid"]).cache()
    mana = pairs(out, "mana_cost")
    assert ("1", "What is the mana cost of Plains Field?",
            "Plains Field is a land and land cards have no mana cost") in mana
    assert ("2", "Can you tell me the mana cost of Odd Spell?", "Odd Spell has no mana cost") in mana
    assert ("4", "What is the mana cost of Fire?", "{1}{R}") in mana
    assert ("5", "What's the card mana cost for Ice?", "{1}{U}") in mana
    assert len([p for p in mana if p[0] == "3"]) == 3          # one answer per phrasing
    assert ("3", "What is the power of Knight?", "*") in pairs(out, "power")
    assert ("2", "What is the power of Odd Spell?", "Odd Spell has no power") in pairs(out, "power")
    assert ("3", "What is the color of Knight?", "W|U") in pairs(out, "colors")
    ident = pairs(out, "color_identity")
    assert {p[0] for p in ident} == {"3"} and ident[0][2] == "WU"   # "" and null dropped
    assert len(pairs(out, "text")) == 4                              # four phrasings for text
    rul = pairs(out, "rulings")
    assert rul[0][2] == "0. b rule\n1. a rule"                       # stored order, 0-based
    assert ("6", "What is a card with converted mana cost (cmc) 4?", "Odd//Name") in pairs(out, "card_with_cmc")
    assert ("2", "What is the converted mana cost of Odd Spell?", "2") in pairs(out, "cmc")
    side = pairs(out, "side_name")
    assert ("5", "What is the name of side b of Ice?", "Ice") in side
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    out.unpersist()


def test_fanout_compat(spark, cards):
    out = qa.fanout(cards, qa.card_templates(True), keep=["uuid"]).cache()
    mana = pairs(out, "mana_cost")
    assert not [p for p in mana if p[0] in ("1", "2")]                # null costs get nothing
    knight = [p[2] for p in mana if p[0] == "3"]
    assert sorted(set(knight)) == ["Knight has no mana cost", "{1}{W}"]  # contradictory pair
    assert ("3", "What is the color of Knight?", "W|,| |U") in pairs(out, "colors")
    ident = {p[0]: p[2] for p in pairs(out, "color_identity")}
    assert ident["2"] == "nan" and "4" not in ident
    cmc = pairs(out, "card_with_cmc")
    assert {p[0] for p in cmc} == {"5", "6"}                          # only b-faces of split names
    out.unpersist()


def test_registry_rules():
    reg = qa.QaRegistry()
    reg.register("cards", 0)(lambda t: None)
    reg.register("cards", 0)(lambda t: None)
    with pytest.raises(ValueError):
        reg.register("cards", 1)(lambda t: None)      # same group, other order
    with pytest.raises(ValueError):
        reg.register("rules", 0)(lambda t: None)      # order used by another group (first registration too)
    reg.register("rules", 1)(lambda t: None)
    assert reg.groups() == ["cards", "rules"]


def test_union_groups_and_store(spark, cards, tmp_dir):
    rules = spark.createDataFrame([("What is a turn?", "A sequence of phases.")], "question string, answer string")
    reg = qa.default_registry(rule_tables=["turns"], with_combos=False)
    built = reg.build({"cards": cards, "turns": rules})
    counts = {r.group: r["count"] for r in built.groupBy("group").count().collect()}
    assert counts["rules"] == 1 and counts["cards"] > 0
    conv = qa.to_conversations(built)
    first = conv.where(F.col("group") == "rules").first().conversations
    assert [m.role for m in first] == ["user", "assistant"]
    write_corpus(conv, f"{tmp_dir}/qa")
    assert corpus_groups(spark, f"{tmp_dir}/qa") == ["cards", "rules"]
    assert corpus_groups(spark, f"{tmp_dir}/missing") == []
    assert load_corpus(spark, f"{tmp_dir}/qa", "rules").count() == 1
    assert load_corpus(spark, f"{tmp_dir}/qa", "rules", "cards").count() == counts["rules"] + counts["cards"]
    with pytest.raises(ValueError):
        load_corpus(spark, f"{tmp_dir}/qa")
    with pytest.raises(ValueError):
        load_corpus(spark, f"{tmp_dir}/qa", "unknown")


def _variant(vid, uses, produces, requires=(), other=None, steps="Step one\nStep two"):
    return {"id": vid, "manaNeeded": "{1}{U}", "manaValueNeeded": 2, "identity": "UB",
            "variantCount": 1, "otherPrerequisites": other, "description": steps, "notes": "",
            "of": [{"id": 7}, {"id": 3}], "includes": [{"id": 9}],
            "uses": [{"card": {"oracleId": f"o{i}", "name": n}, "zoneLocations": z,
                      "battlefieldCardState": "", "exileCardState": "", "libraryCardState": "",
                      "mustBeCommander": False, "quantity": 1} for i, (n, z) in enumerate(uses)],
            "requires": [{"template": {"id": 1, "name": r}, "zoneLocations": ["B"],
                          "battlefieldCardState": "", "exileCardState": "", "libraryCardState": "",
                          "graveyardCardState": "", "mustBeCommander": False, "quantity": 1}
                         for r in requires],
            "produces": [{"feature": {"id": i, "name": f, "uncountable": False}, "quantity": 1}
                         for i, f in enumerate(produces)]}


@pytest.fixture
def combo_json(tmp_dir):
    doc = {"variants": [
        _variant("c1", [("Alpha", ["B"]), ("Beta", ["B"])], ["Infinite ETB", "Infinite LTB"]),
        _variant("c2", [("Alpha", ["B"]), ("Gamma", ["G", "E"])], ["ETB and LTB"],
                 requires=["A creature"], other="Opponent has a creature\nYou have priority"),
        _variant("c3", [("Delta", ["H"])], [], steps=None),
    ]}
    path = f"{tmp_dir}/combos.json"
    with open(path, "w") as f:
        json.dump(doc, f, indent=2)
    return path


def test_shred_nest_roundtrip(spark, combo_json, tmp_dir):
    t = load_combos(spark, combo_json, f"{tmp_dir}/variants")
    assert t.combos.count() == 3 and t.cards.count() == 5 and t.features.count() == 3
    assert t.requires.count() == 1
    assert sorted(r.combo_id for r in t.index().collect()) == ["c1", "c2", "c3"]
    head = t.combos.where(F.col("combo_id") == "c1").first()
    assert head["of"] == "7,3" and head["includes"] == "9" and head["steps"] == "Step one\nStep two"
    nested = {r.combo_id: r for r in nest_combos(t).collect()}
    assert [c.card_name for c in nested["c2"].cards] == ["Alpha", "Gamma"]
    assert nested["c1"].requires is None and len(nested["c2"].requires) == 1
    assert nested["c3"].features == []
    assert t.cards_for("c2").count() == 2 and t.combo("c9").count() == 0
    # the original JSON round-trips through shred + nest
    src = read_variants_json(spark, combo_json).where(F.col("id") == "c2").first()
    assert [u.card.name for u in src.uses] == [c.card_name for c in nested["c2"].cards]


def test_combo_answer_text(spark, combo_json, tmp_dir):
    t = load_combos(spark, combo_json, f"{tmp_dir}/variants")
    got = {r.combo_id: r for r in qa.combo_pairs(t).collect()}
    assert got["c1"].question == "How can you create a combo with Alpha, Beta?"
    assert got["c1"].answer == (
        "[START OF COMBO]This combo can be formed with Alpha, Beta\n\n"
        "Color identity: UB\nMana cost: {1}{U}\n"
        "Steps:\n  1. Step one\n  2. Step two[END OF COMBO STEPS]\n\n"
        "Result:\n  - Infinite enters the battlefield\n  - Infinite leaves the battlefield"
        "[END OF COMBO RESULT][END OF COMBO]\n\n"
        "Other prerequisites:\n  - All permanants must be on the battlefield\n"
        "[END OF COMBO PREREQUISITES]")
    assert got["c2"].answer.endswith(
        "Other prerequisites:\n  - Alpha must be on the battlefield\n"
        "  - Gamma must be in the graveyard or exiled\n"
        "  - Opponent has a creature\n  - You have priority\n[END OF COMBO PREREQUISITES]")
    assert "  - ETB and leaves the battlefield" in got["c2"].answer
    assert "Steps:\n[END OF COMBO STEPS]" in got["c3"].answer
    plain = {r.combo_id: r for r in qa.combo_pairs(t, markers=False).collect()}
    assert "[" not in plain["c1"].answer.replace("{1}{U}", "")


@pytest.mark.parametrize("uses, produces, message", [
    ([("Alpha", ["X"]), ("Beta", ["X"])], [], "unknown zone code X in combo c1"),            # one shared zone
    ([("Alpha", ["B"]), ("Beta", ["G", "X"])], [], "unknown zone code X in combo c1"),       # one line a card
    ([("Alpha", ["B"]), ("Beta", [None, "G"])], [], "unknown zone code null in combo c1"),
    ([("Alpha", []), ("Beta", [])], [], "unknown zone code null in combo c1"),
    ([("Alpha", None), ("Beta", ["B"])], [], "null zones in combo c1"),
    ([("Alpha", ["B"]), (None, ["B"])], [], "null card name in combo c1"),
    ([("Alpha", ["B"])], [None, "Infinite ETB"], "null feature name in combo c1"),
])
def test_unknown_zones_and_null_names_raise(spark, tmp_dir, uses, produces, message):
    with open(f"{tmp_dir}/combos.json", "w") as f:
        json.dump({"variants": [_variant("c0", [("Alpha", ["B"])], []), _variant("c1", uses, produces)]}, f, indent=2)
    t = load_combos(spark, f"{tmp_dir}/combos.json", f"{tmp_dir}/variants")
    with pytest.raises(Exception, match=message):
        qa.combo_pairs(t).collect()
    assert "on the battlefield" in qa.combo_pairs(t).where("combo_id = 'c0'").first().answer


def test_streaming_equals_batch(spark, cards, tmp_dir):
    from lexiforge.streaming.qa_stream import stream_pairs
    raw = cards_df(spark, CARDS)
    raw.write.parquet(f"{tmp_dir}/src")
    q = stream_pairs(spark, f"{tmp_dir}/src", raw.schema, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    q.awaitTermination(120)
    streamed = spark.read.parquet(f"{tmp_dir}/sink")
    batch = qa.fanout(typed_cards(raw), qa.card_templates(), keep=["uuid"])
    cols = ["uuid", "builder", "question", "answer"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_build_corpus_observes_counts(spark, cards, tmp_dir):
    reg = qa.default_registry(with_combos=False)
    stats = qa.build_corpus(reg, {"cards": cards}, f"{tmp_dir}/corpus")
    back = load_corpus(spark, f"{tmp_dir}/corpus", "cards")
    assert stats["rows"] == back.count() > 0
    want = sum(len(m.content) for r in back.collect() for m in r.conversations)
    assert stats["chars"] == want
