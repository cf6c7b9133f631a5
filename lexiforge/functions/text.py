"""Text expressions: face names, line splitting, ordinal lists, abbreviation
expansion, tokenisation and hash buckets (P-11, P-15..P-17, M-2, M-3).

All are built-in Spark expressions; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.schemas import ABBREVIATIONS, MARKERS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


FACE_SEPARATOR = " // "


def face_name(name: Column | str, side: Column | str) -> Column:
    """Name of one face of a multi-face card (P-11).

    Side ``a`` of a name containing ``//`` takes the part before ``" // "``,
    side ``b`` the part after it; a ``//`` without the surrounding spaces has
    no second part, so the full name is kept. Other sides keep the full name.
    """
    n, s = _c(name), _c(side)
    parts = F.split(n, FACE_SEPARATOR)
    multi = n.contains("//")
    return (F.when((s == "a") & multi, F.get(parts, 0))
             .when((s == "b") & multi, F.coalesce(F.get(parts, 1), n))
             .otherwise(n))


# Line boundaries of Python's str.splitlines, as a Java regex class.
_BREAK_CLASS = "\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029"
LINE_BREAK = f"\\r\\n|[{_BREAK_CLASS}]"
_OTHER_BREAK = f"[{_BREAK_CLASS.removeprefix(chr(92) + 'n')}]"


def split_lines(col: Column | str) -> Column:
    """Split into lines like ``str.splitlines()`` (P-16): one trailing break is
    dropped, ``""`` gives ``[]``, ``\\r\\n`` counts once; null stays null."""
    c = _c(col)
    # Only a text that ends in a break is rewritten, and one whose breaks are all \\n is
    # split at that character, for which no pattern is compiled per row.
    body = (F.when(F.right(c, F.lit(1)).rlike(f"[{_BREAK_CLASS}]"), F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", ""))
             .otherwise(c))
    return (F.when(c == "", F.array().cast("array<string>"))
             .when(c.rlike(_OTHER_BREAK), F.split(body, LINE_BREAK))
             .otherwise(F.split(body, "\n")))


def ordinal_lines(col: Column | str, start: int = 0, indent: str = "") -> Column:
    """Number every line: ``"{indent}{i}. {line}"`` joined by newlines (P-15).

    ``start=0`` gives the rulings form, ``start=1, indent="  "`` the steps form.
    """
    return number_lines(split_lines(col), start, indent)


def number_lines(lines: Column | str, start: int = 0, indent: str = "") -> Column:
    """P-15 over an already split ``array<string>`` (split once, render twice)."""
    lines = _c(lines)
    return F.array_join(
        F.transform(lines, lambda x, i: F.concat(F.lit(indent), (i + start).cast("string"),
                                                   F.lit(". "), x)),
        "\n")


def expand_abbreviations(col: Column | str) -> Column:
    """``LTB`` -> "leaves the battlefield", otherwise ``ETB`` -> "enters the
    battlefield"; only the first abbreviation that occurs is expanded (P-17)."""
    c = _c(col)
    (a1, e1), (a2, e2) = ABBREVIATIONS
    return (F.when(c.contains(a1), F.replace(c, F.lit(a1), F.lit(e1)))
             .when(c.contains(a2), F.replace(c, F.lit(a2), F.lit(e2)))
             .otherwise(c))


# --- tokens ----------------------------------------------------------------

# Lexical tokens for BM25 (R-2): lower-cased runs of letters, digits and
# underscore of length >= 2. Same meaning in Java and RE2.
WORD_TOKEN = "[\\p{L}\\p{N}_]{2,}"


def _escape(s: str) -> str:
    return "".join("\\" + ch if ch in "[](){}.*+?|^$\\" else ch for ch in s)


# Training tokens (M-2, M-4): marker strings and chat header tokens first, so
# they stay atomic; then words; then any single other non-space character.
MARKER_ALTERNATION = "|".join(_escape(m) for m in sorted(MARKERS, key=len, reverse=True))
TRAIN_TOKEN = (f"{MARKER_ALTERNATION}|<\\|[a-z_]+\\|>|[\\p{{L}}\\p{{N}}_]+"
               "|[^ \\t\\n\\r\\p{L}\\p{N}_]")


def word_tokens(col: Column | str) -> Column:
    """Array of BM25 tokens of a text."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_TOKEN), 0)


def train_tokens(col: Column | str) -> Column:
    """Array of training tokens of a rendered text (case kept)."""
    return F.regexp_extract_all(_c(col), F.lit(TRAIN_TOKEN), 0)


def explode_computed(arr: Column) -> Column:
    """``explode`` for an array computed in the same projection (tokens,
    fanned-out pairs). A plain inner ``explode`` makes Catalyst infer a
    ``size(arr) > 0`` filter *below* the projection, which evaluates the whole
    array expression (a regex over the document, every template) a second
    time. ``explode_outer`` infers nothing; callers drop its null row."""
    return F.explode_outer(arr)


def md5_bucket(col: Column | str, buckets: int) -> Column:
    """Stable bucket in ``[0, buckets)`` from the first 32 bits of md5 of the
    key's text. The same integer is computable in any SQL engine, and it does
    not depend on partitioning or the number of tasks."""
    h = F.conv(F.substring(F.md5(_c(col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets))
