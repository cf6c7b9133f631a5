"""One canonical row per entity (S-1, S-4, E-2, J-1, J-2, W-1, A-1, P-1..P-6).

Plan shape (checked in ``tests/test_canonical.py``):

  legalities --filter(fmt = legal)--> distinct keys (partial aggregate map-side)
  printings  --left_semi(keys)--> WindowGroupLimit(partial, per map task)
             --exchange(name, side)--> WindowGroupLimit(final) --> rn = 1
  rulings    --left_semi(representative keys)--> group by key, ordered join
  representatives --left join(rulings)--> projection

The per-(name, side) partial limit runs before the shuffle, so even a name that
holds a third of all rows sends at most one row per map task through the
exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.codes import (
    float_text_to_int, identity_name, is_fractional_text, normalize_color_code,
)
from lexiforge.schemas import CARD_COLUMNS


def legal_keys(legalities: DataFrame, fmt: str = "modern", legal_value: str = "Legal",
               key: str = "uuid") -> DataFrame:
    """Distinct keys legal in ``fmt`` (E-2). Duplicate legality rows collapse
    in the map-side partial aggregate, so the semi-join is exact (J-1)."""
    return legalities.where(F.col(fmt) == legal_value).select(key).distinct()


def representatives(printings: DataFrame, keys: DataFrame, key: str = "uuid",
                    name: str = "name", side: str = "side") -> DataFrame:
    """Keep printings whose key is in ``keys``, then the lowest key per
    (name, side) (W-1). Null sides form one group, as SQL PARTITION BY does."""
    w = Window.partitionBy(name, side).orderBy(F.col(key).asc())
    return (printings.join(keys, key, "left_semi")
            .withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1)
            .drop("_rn"))


def aggregate_rulings(rulings: DataFrame, keys: DataFrame | None = None, key: str = "uuid",
                      text: str = "text", out: str = "rulings", sep: str = "\n") -> DataFrame:
    """``GROUP_CONCAT(text, sep) GROUP BY key`` with a fixed order (A-1).

    Nulls are skipped; lines are joined in ascending text order (the source
    system leaves the order unspecified, we fix it). When ``keys`` is given the
    rulings are semi-filtered to those keys first, so only needed groups are
    aggregated (J-2).
    """
    # A collected list shrinks nothing map-side: hash by key first (the one
    # shuffle the aggregate needs anyway) so lists are built by parallel
    # reducers. Done before the semi-join, a sort-merge semi-join reuses this
    # partitioning and a broadcast one keeps it: one shuffle of rulings.
    r = rulings.select(key, text).repartition(key)
    if keys is not None:
        r = r.join(keys, key, "left_semi")
    return r.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(text)), sep).alias(out))


def canonical_rows(printings: DataFrame, legalities: DataFrame, rulings: DataFrame,
                   fmt: str = "modern", legal_value: str = "Legal", key: str = "uuid",
                   name: str = "name", side: str = "side", ruling_text: str = "text",
                   columns: list[str] | None = None) -> DataFrame:
    """The filtered card relation: legal printings, one per (name, side), with
    their rulings string-aggregated, projected to ``columns`` + ``rulings``
    (P-1). Only rulings of the chosen representative attach (J-2)."""
    keys = legal_keys(legalities, fmt, legal_value, key)
    reps = representatives(printings, keys, key, name, side)
    cols = columns if columns is not None else [c for c in CARD_COLUMNS if c in printings.columns]
    return attach_rulings(reps, rulings, key, ruling_text, cols)


def attach_rulings(reps: DataFrame, rulings: DataFrame, key: str = "uuid", ruling_text: str = "text",
                   columns: list[str] | None = None) -> DataFrame:
    """Representatives with their rulings (J-2). ``reps`` feeds both the
    semi-join and the left join: write it once first where it is costly."""
    agg = aggregate_rulings(rulings, reps.select(key), key, ruling_text)
    return reps.select(*(columns or reps.columns)).join(agg, key, "left")


def typed_cards(cards: DataFrame, compat: bool = False) -> DataFrame:
    """Typed, normalised card relation (S-4 after the read).

    * ``manaValue`` / ``faceConvertedManaCost``: whole-float text -> int (P-3);
      fractional text becomes null and is flagged in ``_bad_numeric``.
    * ``colorIndicator`` / ``colorIdentity``: separators stripped, WUBRGC order
      (P-4, P-5).
    * ``colorIdentityName`` from the identity code (P-6).
    * ``manaValue`` renamed ``cmc`` (P-2).
    """
    out = cards
    bad = F.lit(False)
    for c in ("manaValue", "faceConvertedManaCost"):
        if c in out.columns:
            bad = bad | is_fractional_text(F.col(c))
            out = out.withColumn(c, float_text_to_int(F.col(c)))
    for c in ("colorIndicator", "colorIdentity"):
        if c in out.columns:
            out = out.withColumn(c, normalize_color_code(F.col(c)))
    if "colorIdentity" in out.columns:
        out = out.withColumn("colorIdentityName", identity_name(F.col("colorIdentity"), compat))
    out = out.withColumn("_bad_numeric", bad)
    if "manaValue" in out.columns:
        out = out.withColumnRenamed("manaValue", "cmc")
    return out
