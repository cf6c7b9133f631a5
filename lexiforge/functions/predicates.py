"""Row predicates (E-1, E-5..E-8, E-10..E-12) as ``Column`` expressions.

They are plain filters, so Catalyst pushes the simple ones (``isNotNull``,
equality, ``isin``) into the Parquet scan.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def not_empty_keep_null(col: Column | str) -> Column:
    """``x != ""`` as a dataframe library evaluates it: null rows pass (E-1)."""
    return ~_c(col).eqNullSafe(F.lit(""))


def not_empty_sql(col: Column | str) -> Column:
    """``x != ""`` with SQL three-valued logic: null rows are dropped (E-1)."""
    return F.coalesce(_c(col) != F.lit(""), F.lit(False))


def contains_ci(col: Column | str, needle: str) -> Column:
    """Case-insensitive literal substring test; null -> False (E-5..E-8)."""
    return F.coalesce(F.upper(_c(col)).contains(needle.upper()), F.lit(False))


def contains_cs(col: Column | str, needle: str) -> Column:
    """Case-sensitive literal substring test; null -> False (E-11, E-12)."""
    return F.coalesce(_c(col).contains(needle), F.lit(False))


def contains_word(col: Column | str, word: str, case_sensitive: bool = False) -> Column:
    """Whole-word match (``Land`` hits ``Basic Land`` but not ``Island``)."""
    flags = "" if case_sensitive else "(?i)"
    return F.coalesce(_c(col).rlike(f"{flags}\\b{re.escape(word)}\\b"), F.lit(False))


def contains_regex(col: Column | str, pattern: str) -> Column:
    """Opt-in regex search, case-insensitive (E-6 with ``regex=True``)."""
    return F.coalesce(_c(col).rlike(f"(?i){pattern}"), F.lit(False))


def code_match(col: Column | str, code: str, mode: str = "contains") -> Column:
    """Match a canonical colour code against a requested code (E-5).

    ``contains``: contiguous substring, case-insensitive (``WU`` hits ``WUB``,
    ``WB`` does not). ``exact``: equality. ``subset``: every colour of the
    card is in the request. ``superset``: the card has every requested colour.
    """
    c = F.upper(_c(col))
    code = code.upper()
    chars = F.split(c, "")
    req = F.split(F.lit(code), "")
    if mode == "contains":
        return F.coalesce(c.contains(code), F.lit(False))
    if mode == "exact":
        return F.coalesce(c == F.lit(code), F.lit(False))
    if mode == "subset":
        return F.coalesce(F.size(F.array_except(chars, req)) == 0, F.lit(False))
    if mode == "superset":
        return F.coalesce(F.size(F.array_except(req, chars)) == 0, F.lit(False))
    raise ValueError(f"unknown mode {mode!r}")


# --- metadata filters (E-10) -----------------------------------------------

_OPS = {
    "$eq": lambda c, v: c == v, "==": lambda c, v: c == v,
    "$ne": lambda c, v: c != v, "!=": lambda c, v: c != v,
    "$lt": lambda c, v: c < v, "<": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v, "<=": lambda c, v: c <= v,
    "$gt": lambda c, v: c > v, ">": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v, ">=": lambda c, v: c >= v,
    "$in": lambda c, v: c.isin(list(v)), "in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
}


def compile_filters(filters: dict[str, Any] | None, fields: list[str],
                    prefix: str = "") -> Column:
    """Compile a filter dict to one ``Column`` predicate.

    Forms: ``{"field": value}`` (equality), ``{"field": [v1, v2]}`` (``isin``),
    ``{"field": {"$lte": 3, ...}}`` (comparisons), and the logical keys
    ``$and`` / ``$or`` (lists of filter dicts) and ``$not`` (one dict).
    ``{"field": None}`` keeps rows whose field is null; any other comparison with
    a null is unknown, also under ``$not``, and unknown rows are not kept.
    Unknown fields raise, so a typo never silently matches everything.
    """
    # Only the whole predicate turns unknown into false: inside, ``$not`` of an
    # unknown comparison stays unknown.
    return F.coalesce(_predicate(filters, fields, prefix), F.lit(False))


def _predicate(filters: dict[str, Any] | None, fields: list[str], prefix: str) -> Column:
    if not filters:
        return F.lit(True)
    preds: list[Column] = []
    for key, value in filters.items():
        if key in ("$and", "AND"):
            preds.append(_all([_predicate(f, fields, prefix) for f in value]))
            continue
        if key in ("$or", "OR"):
            parts = [_predicate(f, fields, prefix) for f in value]
            out = parts[0]
            for p in parts[1:]:
                out = out | p
            preds.append(out)
            continue
        if key in ("$not", "NOT"):
            preds.append(~_predicate(value, fields, prefix))
            continue
        if key not in fields:
            raise ValueError(f"unknown filter field {key!r}; known: {sorted(fields)}")
        col = F.col(f"{prefix}{key}")
        if isinstance(value, dict):
            for op, v in value.items():
                if op not in _OPS:
                    raise ValueError(f"unknown filter operator {op!r}")
                preds.append(_OPS[op](col, v))
        elif isinstance(value, (list, tuple, set)):
            preds.append(col.isin(list(value)))
        elif value is None:
            preds.append(col.isNull())
        else:
            preds.append(col == value)
    return _all(preds)


def _all(preds: list[Column]) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out
