"""Question/answer corpus builders (P-19..P-21, B-1..B-19, U-1, X-1, X-2).

A card builder is a declarative ``QaTemplate``: predicate, question phrasings,
answer expression. All card templates of a group are fused into ONE narrow
projection: each row yields an array of (builder, question, answer) structs,
null where a template's predicate fails, and one ``explode`` fans it out. The
card table is scanned once however many builders are registered; there is no
shuffle and no per-row Python.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.codes import color_list_delimited
from lexiforge.functions.predicates import not_empty_keep_null
from lexiforge.functions.text import (
    expand_abbreviations, explode_computed, face_name, ordinal_lines, split_lines,
)
from lexiforge.operators.nest import ComboTables, nest_combos
from lexiforge.schemas import (
    COMBO_ALL_ZONE, COMBO_FORMED, COMBO_IDENTITY, COMBO_MANA, COMBO_PREREQ, COMBO_RESULT,
    COMBO_STEPS, LAND_NO_MANA_COST, MARKERS, NO_MANA_COST, NO_POWER,
    NO_TOUGHNESS, QUESTIONS, ZONE_PHRASES,
)


def render(template: str, **values: Column) -> Column:
    """``"What is {name}?"`` -> ``concat(lit("What is "), name, lit("?"))``."""
    parts: list[Column] = []
    for literal, fld, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if fld is not None:
            parts.append(values[fld].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def chat_pair(question: Column, answer: Column) -> Column:
    """P-20: ``[{user, q}, {assistant, a}]``."""
    return F.array(
        F.struct(F.lit("user").alias("role"), question.alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


@dataclass(frozen=True)
class QaTemplate:
    """One card builder: rows passing ``predicate`` yield one pair per question."""

    name: str
    questions: list[str]
    answer: Callable[[], Column]
    predicate: Callable[[], Column] | None = None
    value: Callable[[], Column] | None = None     # fills ``{value}``
    subject: Callable[[], Column] | None = None   # fills ``{name}``; face name default


def _face() -> Column:
    return F.col("_face")


def fanout(df: DataFrame, templates: list[QaTemplate], keep: list[str] | None = None) -> DataFrame:
    """P-21: one pass over ``df`` -> (keep..., builder, question, answer).

    The face name is computed once per row; each template contributes one
    struct (its answer evaluated once, its phrasings as an array), null when
    its predicate fails. Two narrow explodes follow. Keeping the generated
    expression small matters as much as the row count: it is compiled once per
    stage.
    """
    keep = keep or []
    base = df.withColumn("_face", face_name("name", "side")) if "name" in df.columns else df
    entries = []
    for t in templates:
        subject = (t.subject or _face)()
        vals = {"name": subject}
        if t.value is not None:
            vals["value"] = t.value()
        pred = t.predicate() if t.predicate is not None else F.lit(True)
        entries.append(F.when(pred, F.struct(
            F.lit(t.name).alias("builder"), t.answer().cast("string").alias("answer"),
            F.array(*[render(q, **vals) for q in t.questions]).alias("questions"))))
    per_template = (base.select(*keep, explode_computed(F.array(*entries)).alias("_t"))
                    .where(F.col("_t").isNotNull()))
    return per_template.select(*keep, F.col("_t.builder").alias("builder"),
                               F.explode("_t.questions").alias("question"),
                               F.col("_t.answer").alias("answer"))


# --- the card builders (B-1..B-15) -----------------------------------------

def card_templates(compat: bool = False) -> list[QaTemplate]:
    """The fifteen card builders in registration order.

    ``compat=False`` follows the evident intent; ``compat=True`` reproduces the
    observed source behaviour (B-1 second branch on non-null, B-4 per-character
    join, B-5 null kept as ``nan``, B-14 only b-faces of split names).
    """
    col = F.col
    nn = lambda c: (lambda: col(c).isNotNull())
    face = _face

    if compat:
        mana = [
            QaTemplate("mana_cost", QUESTIONS["mana_cost"], lambda: col("manaCost"), nn("manaCost")),
            QaTemplate("mana_cost", QUESTIONS["mana_cost"],
                       lambda: F.when(col("type").contains("Land"),
                                      render(LAND_NO_MANA_COST, name=face()))
                       .otherwise(render(NO_MANA_COST, name=face())), nn("manaCost")),
        ]
    else:
        mana = [QaTemplate(
            "mana_cost", QUESTIONS["mana_cost"],
            lambda: F.when(col("manaCost").isNotNull(), col("manaCost"))
            .when(F.coalesce(col("type").contains("Land"), F.lit(False)),
                  render(LAND_NO_MANA_COST, name=face()))
            .otherwise(render(NO_MANA_COST, name=face())))]

    if compat:
        identity = QaTemplate("color_identity", QUESTIONS["color_identity"],
                              lambda: F.coalesce(col("colorIdentity"), F.lit("nan")),
                              lambda: not_empty_keep_null("colorIdentity"))
        cmc_pred = lambda: (col("cmc").isNotNull() & (col("side") == "b")
                            & col("name").contains("//"))
    else:
        identity = QaTemplate("color_identity", QUESTIONS["color_identity"],
                              lambda: col("colorIdentity"),
                              lambda: col("colorIdentity").isNotNull() & (col("colorIdentity") != ""))
        cmc_pred = nn("cmc")

    return [
        *mana,
        QaTemplate("cmc", QUESTIONS["cmc"], lambda: col("cmc").cast("string"), nn("cmc")),
        QaTemplate("keywords", QUESTIONS["keywords"], lambda: col("keywords"), nn("keywords")),
        QaTemplate("colors", QUESTIONS["colors"],
                   lambda: color_list_delimited("colors", compat=compat), nn("colors")),
        identity,
        QaTemplate("ascii_name", QUESTIONS["ascii_name"], lambda: col("asciiName"), nn("asciiName")),
        QaTemplate("type", QUESTIONS["type"], lambda: col("type"), nn("type")),
        QaTemplate("power", QUESTIONS["power"],
                   lambda: F.coalesce(col("power"), render(NO_POWER, name=face()))),
        QaTemplate("text", QUESTIONS["text"], lambda: col("text"), nn("text")),
        QaTemplate("loyalty", QUESTIONS["loyalty"], lambda: col("loyalty"), nn("loyalty")),
        QaTemplate("rarity", QUESTIONS["rarity"], lambda: col("rarity"), nn("rarity")),
        QaTemplate("toughness", QUESTIONS["toughness"],
                   lambda: F.coalesce(col("toughness"), render(NO_TOUGHNESS, name=face()))),
        QaTemplate("rulings", QUESTIONS["rulings"], lambda: ordinal_lines("rulings", start=0),
                   nn("rulings"), subject=lambda: col("name")),
        QaTemplate("card_with_cmc", QUESTIONS["card_with_cmc"], face, cmc_pred,
                   value=lambda: col("cmc")),
        QaTemplate("side", QUESTIONS["side"], lambda: col("side"), nn("side")),
        QaTemplate("side_name", QUESTIONS["side_name"], face, nn("side"),
                   value=lambda: col("side")),
    ]


# --- static rule tables (B-16..B-18) ----------------------------------------

def static_pairs(table: DataFrame, builder: str) -> DataFrame:
    """A user-supplied (question, answer) table as a builder output."""
    return table.select(F.lit(builder).alias("builder"), "question", "answer")


# --- combos (B-19, P-17..P-19) ----------------------------------------------

def needed(value: Column, *message: Column) -> Column:
    """``value``; a null raises ``message``."""
    parts = [F.coalesce(m.cast("string"), F.lit("null")) for m in message]
    return F.coalesce(value, F.raise_error(F.concat(*parts)))


def combo_pairs(t: ComboTables, markers: bool = True,
                zone_phrases: dict[str, str] | None = None) -> DataFrame:
    """One (question, answer) per combo from the re-assembled combo rows. Unknown or
    missing zones and null card or feature names raise, as in the source."""
    zones = zone_phrases or ZONE_PHRASES
    zmap = F.create_map(*[F.lit(x) for kv in zones.items() for x in kv])
    mk = (lambda i: F.lit(MARKERS[i])) if markers else (lambda i: F.lit(""))
    end_steps, end_result, end_prereq, start, end_combo = (mk(i) for i in range(5))

    # Only the fields the texts hold, and those that order them, travel through the grouping.
    nested = nest_combos(ComboTables(
        t.combos.select("combo_id", "identity", "manaNeeded", "steps", "otherPrerequisites"),
        t.cards.select("combo_id", "pos", "card_id", "card_name", "zone_locations"),
        t.requires,
        t.features.select("combo_id", "pos", "feature_id", "feature_name")), ("cards", "features"))
    of_combo = (F.lit(" in combo "), F.col("combo_id"))
    card_name = lambda c: needed(c["card_name"], F.lit("null card name"), *of_combo)
    names = F.array_join(F.transform("cards", card_name), ", ")
    feats = F.array_join(
        F.transform("features", lambda f: F.concat(F.lit("  - "), expand_abbreviations(
            needed(f["feature_name"], F.lit("null feature name"), *of_combo)))),
        "\n")
    steps = F.coalesce(ordinal_lines("steps", start=1, indent="  "), F.lit(""))
    phrase = lambda z: needed(F.try_element_at(zmap, z), F.lit("unknown zone code "), z, *of_combo)

    # Texts that are used twice are columns of a projection of their own, computed once.
    zone_tuples = F.array_distinct("cards.zone_locations")
    made = nested.select(
        "combo_id", "identity", "manaNeeded", "otherPrerequisites", "cards", names.alias("_names"),
        feats.alias("_feats"), steps.alias("_steps"), zone_tuples.alias("_zones"))

    # P-18: one distinct zone tuple -> one line using its first zone only;
    # otherwise one line per card with its zones joined by " or ".
    single = F.array(F.concat(F.lit(COMBO_ALL_ZONE), phrase(F.get(F.get(F.col("_zones"), 0), 0))))
    per_card = F.transform("cards", lambda c: F.concat(
        F.lit("  - "), card_name(c), F.lit(" must be "),
        F.array_join(F.transform(needed(c["zone_locations"], F.lit("null zones"), *of_combo), phrase), " or ")))
    zone_lines = (F.when(F.size("_zones") == 1, single)
                  .when(F.size(F.col("cards")) == 0, F.array().cast("array<string>"))
                  .otherwise(per_card))
    other = F.transform(F.coalesce(split_lines("otherPrerequisites"), F.array().cast("array<string>")),
                        lambda x: F.concat(F.lit("  - "), x))
    made = made.select("combo_id", "identity", "manaNeeded", "_names", "_feats", "_steps",
                       F.concat(zone_lines, other).alias("_prereq"))
    prereq_text = F.when(
        F.size("_prereq") > 0,
        F.concat(F.lit("\n\n" + COMBO_PREREQ), F.array_join("_prereq", "\n"), F.lit("\n"), end_prereq)
        if markers else
        F.concat(F.lit("\n\n" + COMBO_PREREQ), F.array_join("_prereq", "\n"))).otherwise(F.lit(""))

    answer = F.concat(
        start, F.lit(COMBO_FORMED), F.col("_names"), F.lit("\n\n"),
        F.lit(COMBO_IDENTITY), F.coalesce(F.col("identity"), F.lit("")), F.lit("\n"),
        F.lit(COMBO_MANA), F.coalesce(F.col("manaNeeded"), F.lit("")), F.lit("\n"),
        F.lit(COMBO_STEPS), F.col("_steps"), end_steps, F.lit("\n\n"),
        F.lit(COMBO_RESULT), F.col("_feats"), end_result, end_combo, prereq_text)
    question = render(QUESTIONS["combo"][0], value=F.col("_names"))
    return made.select("combo_id", F.lit("combo").alias("builder"),
                       question.alias("question"), answer.alias("answer"))


# --- registry (X-1) and corpus build (U-1, X-2) -----------------------------

@dataclass
class _Entry:
    group: str
    name: str
    source: str | None = None
    template: QaTemplate | None = None
    fn: Callable[[dict[str, Any]], DataFrame] | None = None


@dataclass
class QaRegistry:
    """Builders by group, each group with one training order.

    Registering a group with a second order, or an order another group already
    uses, raises ``ValueError`` -- checked on every registration, including
    the first of a group.
    """

    group_order: dict[str, int] = field(default_factory=dict)
    entries: list[_Entry] = field(default_factory=list)

    def _check(self, group: str, train_order: int) -> None:
        if group in self.group_order and self.group_order[group] != train_order:
            raise ValueError(f"{group!r} trains at place {self.group_order[group]}, so a builder cannot give it {train_order}")
        for g, o in self.group_order.items():
            if g != group and o == train_order:
                raise ValueError(f"place {train_order} belongs to {g!r}, so {group!r} needs another")
        self.group_order[group] = train_order

    def register(self, group: str, train_order: int, name: str | None = None):
        """Decorator for ``fn(tables) -> DataFrame[builder?, question, answer]``."""
        def deco(fn):
            self._check(group, train_order)
            self.entries.append(_Entry(group, name or fn.__name__, fn=fn))
            return fn
        return deco

    def register_template(self, group: str, train_order: int, template: QaTemplate,
                          source: str = "cards") -> None:
        self._check(group, train_order)
        self.entries.append(_Entry(group, template.name, source=source, template=template))

    def groups(self) -> list[str]:
        return sorted(self.group_order, key=self.group_order.get)

    def build(self, tables: dict[str, Any], groups: list[str] | None = None,
              keep: list[str] | None = None) -> DataFrame:
        """U-1: union of every builder's pairs with (group, train_order, builder).

        Templates over the same source are fused into one pass (``fanout``).
        """
        wanted = groups or self.groups()
        parts: list[DataFrame] = []
        for g in wanted:
            if g not in self.group_order:
                raise ValueError(f"unknown group {g!r}")
            entries = [e for e in self.entries if e.group == g]
            by_source: dict[str, list[QaTemplate]] = {}
            for e in entries:
                if e.template is not None:
                    by_source.setdefault(e.source, []).append(e.template)
            for src, temps in by_source.items():
                parts.append(_tag(fanout(tables[src], temps, keep), g, self.group_order[g], keep))
            for e in entries:
                if e.fn is not None:
                    out = e.fn(tables)
                    if "builder" not in out.columns:
                        out = out.withColumn("builder", F.lit(e.name))
                    parts.append(_tag(out, g, self.group_order[g], keep))
        result = parts[0]
        for p in parts[1:]:
            result = result.unionByName(p, allowMissingColumns=True)
        return result


def _tag(df: DataFrame, group: str, order: int, keep: list[str] | None) -> DataFrame:
    cols = [F.lit(group).alias("group"), F.lit(order).alias("train_order"), "builder",
            "question", "answer"]
    extra = [c for c in (keep or []) if c in df.columns]
    return df.select(*cols, *extra)


def default_registry(compat: bool = False, rule_tables: list[str] | None = None,
                     with_combos: bool = True) -> QaRegistry:
    """cards (order 0): the card templates over ``tables["cards"]``;
    rules (order 1): each named static (question, answer) table;
    combos (order 2): ``tables["combos"]`` (a :class:`ComboTables`)."""
    reg = QaRegistry()
    for t in card_templates(compat):
        reg.register_template("cards", 0, t, source="cards")
    for name in rule_tables or []:
        reg.register("rules", 1, name=name)(lambda tables, n=name: static_pairs(tables[n], n))
    if with_combos:
        reg.register("combos", 2, name="combo")(
            lambda tables: combo_pairs(tables["combos"]).drop("combo_id"))
    return reg


def to_conversations(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pairs -> the stored QA shape: (group, builder, conversations)."""
    keep = keep or []
    return pairs.select("group", "builder", *keep,
                        chat_pair(F.col("question"), F.col("answer")).alias("conversations"))


def build_corpus(registry: QaRegistry, tables: dict[str, Any], path: str,
                 groups: list[str] | None = None, mode: str = "overwrite") -> dict[str, int]:
    """X-2: run every builder, write one data set per group (S-5), and report rows
    and characters (A-8) as the store counted them from what was written."""
    from lexiforge.operators.corpus import write_corpus
    counts = write_corpus(to_conversations(registry.build(tables, groups)), path, mode).values()
    return {k: sum(c[k] for c in counts) for k in ("rows", "chars")}
