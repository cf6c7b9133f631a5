"""Nested combo documents: shred into keyed tables and re-assemble (S-2, N-1..N-4,
J-3, A-3, A-5, A-6).

Shredding is three ``posexplode``s over one source; the position is carried
so re-assembly can restore source order (a collected list has no guaranteed
order). Re-assembly groups the header and the child rows by ``combo_id`` in one
aggregate, which moves a row per combo and file and needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ComboTables:
    """The four keyed tables of a combo document (N-3)."""

    combos: DataFrame    # combo_id
    cards: DataFrame     # (combo_id, pos) -> card_id, ...
    requires: DataFrame  # (combo_id, pos) -> require_id, ...
    features: DataFrame  # (combo_id, pos) -> feature_id, ...

    def index(self) -> DataFrame:
        """Combo ids (N-3); a DataFrame, not a driver-side list."""
        return self.combos.select("combo_id")

    def cards_for(self, combo_id: str) -> DataFrame:
        """N-4."""
        return self.cards.where(F.col("combo_id") == combo_id)

    def features_for(self, combo_id: str) -> DataFrame:
        return self.features.where(F.col("combo_id") == combo_id)

    def requires_for(self, combo_id: str) -> DataFrame:
        return self.requires.where(F.col("combo_id") == combo_id)

    def combo(self, combo_id: str) -> DataFrame:
        """J-3 for one combo: the nested row, or no row when absent."""
        return nest_combos(self).where(F.col("combo_id") == combo_id)


def _id_list(col: str) -> F.Column:
    """A-5: ``[{id: 1}, {id: 2}]`` -> ``"1,2"`` in source order."""
    return F.array_join(F.transform(F.col(col), lambda x: x["id"].cast("string")), ",")


def shred_variants(variants: DataFrame) -> ComboTables:
    """N-1/N-2: one row per variant (columns of the variant struct) -> four tables.

    Persist or materialize ``variants`` first when it is expensive to
    recompute: it feeds four branches.
    """
    combos = variants.select(
        F.col("id").alias("combo_id"), "manaNeeded", "manaValueNeeded", "identity",
        "variantCount", "otherPrerequisites", F.col("description").alias("steps"), "notes",
        _id_list("of").alias("of"), _id_list("includes").alias("includes"))

    cards = (variants.select(F.col("id").alias("combo_id"), F.posexplode("uses").alias("pos", "u"))
             .select("combo_id", "pos",
                     F.col("u.card.oracleId").alias("card_id"),
                     F.col("u.card.name").alias("card_name"),
                     F.col("u.zoneLocations").alias("zone_locations"),
                     F.col("u.battlefieldCardState").alias("battlefield_card_state"),
                     F.col("u.exileCardState").alias("exile_card_state"),
                     F.col("u.libraryCardState").alias("library_card_state"),
                     F.col("u.mustBeCommander").alias("must_be_commander"),
                     F.col("u.quantity").alias("quantity")))

    requires = (variants.select(F.col("id").alias("combo_id"),
                                F.posexplode("requires").alias("pos", "r"))
                .select("combo_id", "pos",
                        F.col("r.template.id").alias("require_id"),
                        F.col("r.template.name").alias("require_name"),
                        F.col("r.zoneLocations").alias("zone_locations"),
                        F.col("r.battlefieldCardState").alias("battlefield_card_state"),
                        F.col("r.exileCardState").alias("exile_card_state"),
                        F.col("r.libraryCardState").alias("library_card_state"),
                        F.col("r.graveyardCardState").alias("graveyard_card_state"),
                        F.col("r.mustBeCommander").alias("must_be_commander"),
                        F.col("r.quantity").alias("quantity")))

    features = (variants.select(F.col("id").alias("combo_id"),
                                F.posexplode("produces").alias("pos", "p"))
                .select("combo_id", "pos",
                        F.col("p.feature.id").alias("feature_id"),
                        F.col("p.feature.name").alias("feature_name"),
                        F.col("p.feature.uncountable").alias("uncountable"),
                        F.col("p.quantity").alias("quantity")))
    return ComboTables(combos, cards, requires, features)


def nest_combos(t: ComboTables, parts: tuple[str, ...] = ("cards", "features", "requires")) -> DataFrame:
    """J-3: header + ordered arrays of the child tables ``parts``.

    Combos without cards or features get empty arrays; without requires, null
    (requires are optional in the source model). Header and child rows share one
    grouping; a header row without an id, or with one that repeats, stays a row.
    """
    children = {p: getattr(t, p) for p in parts}
    tables = {"_head": t.combos, **{p: c.where(F.col("combo_id").isNotNull()) for p, c in children.items()}}

    def tagged(own: str) -> DataFrame:
        payload = lambda df: F.struct(*[c for c in df.columns if c != "combo_id"])
        return tables[own].select("combo_id", *[
            (payload(df) if name == own else F.lit(None).cast(f"struct<{_ddl(df)}>")).alias(name)
            for name, df in tables.items()])

    rows = reduce(DataFrame.unionByName, map(tagged, tables))
    lists = {p: F.sort_array(F.collect_list(p)) for p in parts}     # 'pos' first => sort key
    if "requires" in lists:
        lists["requires"] = F.when(F.size(lists["requires"]) > 0, lists["requires"])
    return (rows.groupBy("combo_id").agg(F.collect_list("_head").alias("_heads"), *[c.alias(p) for p, c in lists.items()])
            .select("combo_id", F.explode("_heads").alias("_head"), *parts)
            .select("combo_id", *[F.col("_head")[c].alias(c) for c in t.combos.columns if c != "combo_id"], *parts))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}"
                     for f in df.schema.fields if f.name != "combo_id")
