"""Card lookups (E-3..E-9) and small reports (A-2, A-4, A-8).

Single-value lookups are plain filters (pushed into the scan). Their batch
forms take a table of requests and join, so many lookups cost one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.codes import card_type_get, color_get, color_identity_get
from lexiforge.functions.text import explode_computed
from lexiforge.functions.predicates import code_match, contains_ci, contains_regex, contains_word


def card_by_id(cards: DataFrame, uuid, key: str = "uuid") -> DataFrame:
    """First card with this key (E-3); empty result when absent."""
    return cards.where(F.col(key) == uuid).orderBy(key).limit(1)


def cards_by_ids(cards: DataFrame, requests: DataFrame, request_col: str,
                 key: str = "uuid") -> DataFrame:
    """Batch E-3: every request row joined to its card (inner)."""
    return requests.join(cards, requests[request_col] == cards[key], "inner")


def card_by_name(cards: DataFrame, name: str, key: str = "uuid",
                 name_col: str = "name") -> DataFrame:
    """Exact name lookup, first match = lowest key (E-4)."""
    if not name:
        raise ValueError("name cannot be empty")
    return cards.where(F.col(name_col) == name).orderBy(key).limit(1)


def first_by_name(cards: DataFrame, requests: DataFrame, request_col: str,
                  key: str = "uuid", name_col: str = "name") -> DataFrame:
    """Batch E-4: for each requested name, the card with the lowest key.

    The min-by aggregate is partial (map-side), so a name held by a third of
    all rows still shuffles one row per map task.
    """
    firsts = (cards.groupBy(name_col)
              .agg(F.min_by(F.struct(*[F.col(c) for c in cards.columns]), F.col(key)).alias("_c"))
              .select("_c.*"))
    return requests.join(firsts, requests[request_col] == firsts[name_col], "inner")


def identity_predicate(identity: str, mode: str = "contains", col: str = "colorIdentity"):
    return code_match(col, color_identity_get(identity), mode)


def mana_cost_predicate(mana_cost: str, regex: bool = False, col: str = "manaCost"):
    return contains_regex(col, mana_cost) if regex else contains_ci(col, mana_cost)


def color_predicate(color: str, col: str = "colors"):
    return contains_ci(col, color_get(color))


def type_predicate(card_type: str, word: bool = False, col: str = "type"):
    t = card_type_get(card_type)
    return contains_word(col, t) if word else contains_ci(col, t)


def cards_by_color_identity(cards: DataFrame, identity: str, mode: str = "contains",
                            col: str = "colorIdentity") -> DataFrame:
    """E-5: case-insensitive substring of the canonical code (default)."""
    return cards.where(code_match(col, color_identity_get(identity), mode))


def cards_by_mana_cost(cards: DataFrame, mana_cost: str, regex: bool = False,
                       col: str = "manaCost") -> DataFrame:
    """E-6: literal, case-insensitive substring (``{2}{W}`` is text, not a
    pattern); ``regex=True`` opts in to pattern search."""
    pred = contains_regex(col, mana_cost) if regex else contains_ci(col, mana_cost)
    return cards.where(pred)


def cards_by_color(cards: DataFrame, color: str, col: str = "colors") -> DataFrame:
    """E-7: substring of the raw colour list, case-insensitive; null -> no."""
    return cards.where(contains_ci(col, color_get(color)))


def cards_by_type(cards: DataFrame, card_type: str, word: bool = False,
                  col: str = "type") -> DataFrame:
    """E-8: substring of the type line (``Land`` also hits ``Island``);
    ``word=True`` matches whole words only."""
    t = card_type_get(card_type)
    return cards.where(contains_word(col, t) if word else contains_ci(col, t))


def cards_by_cmc(cards: DataFrame, cmc: int, col: str = "cmc") -> DataFrame:
    """E-9: equality."""
    return cards.where(F.col(col) == cmc)


def multi_search(cards: DataFrame, searches: list[tuple[dict[str, str], F.Column]],
                 keep: list[str]) -> DataFrame:
    """Many searches in one pass: each row yields one output row per search it
    matches, tagged with that search's labels. One scan and one narrow
    ``explode`` instead of a union of filtered copies of the input."""
    entries = [F.when(pred, F.struct(*[F.lit(v).alias(k) for k, v in labels.items()]))
               for labels, pred in searches]
    label_cols = list(searches[0][0])
    return (cards.select(*keep, explode_computed(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("_m"))
            .where(F.col("_m").isNotNull())
            .select(*[F.col(f"_m.{k}") for k in label_cols], *keep))


def distinct_sorted(df: DataFrame, col: str = "cmc") -> DataFrame:
    """A-2 + T-4: distinct non-null values, ascending."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """A-4: count per non-null value, descending, ties by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
            .orderBy(F.col(out).desc(), F.col(col)))
