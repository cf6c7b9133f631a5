"""Golden tests for the Column functions (P-3..P-22, E-1..E-12) on card-shaped
edge rows (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import codes, predicates as P, text as X


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_strip_and_sort_colors(spark):
    # row 8: null, "", "U, W", "W, U"
    vals = [None, "", "U, W", "W, U", "GWU", "CW", "WW, U"]
    assert one_col(spark, vals, codes.strip_commas) == [None, "", "UW", "WU", "GWU", "CW", "WWU"]
    assert one_col(spark, vals, codes.normalize_color_code) == [None, "", "WU", "WU", "WUG", "WC", "WWU"]


def test_sort_colors_strict_raises(spark):
    with pytest.raises(Exception):
        one_col(spark, ["WX"], lambda c: codes.sort_colors(c, strict=True))


def test_strip_brackets(spark):
    assert one_col(spark, ["{2}{W}", "[a](b)", None], codes.strip_brackets) == ["2W", "ab", None]


def test_identity_name_default_and_compat(spark):
    vals = [None, "", "W", "WU", "WUBRG", "UBRG", "C", "XYZ"]
    assert one_col(spark, vals, codes.identity_name) == [
        "Colorless", "Colorless", "Mono White", "Azorius", "Five Color", "Glint Eye", "Colorless", None]
    assert one_col(spark, vals, lambda c: codes.identity_name(c, compat=True)) == [
        None, "Colorless", "Mono White", "Azorius", "Five Color", "Glint Eye", "Colorless", None]


def test_color_list_delimited(spark):
    # row 9: default W|U, compat W|,| |U
    assert one_col(spark, ["W, U", "G", None], codes.color_list_delimited) == ["W|U", "G", None]
    assert one_col(spark, ["W, U"], lambda c: codes.color_list_delimited(c, compat=True)) == ["W|,| |U"]


def test_float_text_to_int(spark):
    # row 10: '3.0' -> 3, '0.5' -> quarantined, null -> null; row 11 fits int;
    # text that is no number, or too large a one, is flagged as well
    vals = ["3.0", "0.5", None, "40000.0", "abc", "9e12"]
    assert one_col(spark, vals, codes.float_text_to_int) == [3, None, None, 40000, None, None]
    assert one_col(spark, vals, codes.is_fractional_text) == [False, True, False, False, True, True]


def test_enum_lookups():
    # row 27
    assert codes.color_get("white") == "W" and codes.color_get("u") == "U"
    with pytest.raises(ValueError):
        codes.color_get("purple")
    assert codes.color_identity_get("Mono White") == "W"
    assert codes.color_identity_get("Mono-White") == "W"
    assert codes.color_identity_get("wu") == "WU"
    assert codes.color_identity_get("Five-Color") == "WUBRG"
    assert codes.card_type_get("land") == "Land"
    with pytest.raises(ValueError):
        codes.card_type_get("Legendary")
    with pytest.raises(ValueError):
        codes.color_identity_get("nope")


def test_enum_lookup_columns(spark):
    assert one_col(spark, ["white", "u", "x"], codes.color_code) == ["W", "U", None]
    assert one_col(spark, ["Mono White", "Mono-White", "wu", "Esper"],
                   codes.color_identity_code) == ["W", "W", "WU", "WUB"]
    assert one_col(spark, ["land", "Legendary"], codes.card_type_value) == ["Land", None]


def test_face_name(spark):
    # rows 4-6
    df = spark.createDataFrame([
        (0, "X // Y", "a"), (1, "X // Y", "b"), (2, "X//Y", "b"), (3, "A // B // C // D // E", "c"),
        (4, "Plain", None), (5, "X//Y", "a"), (6, "X // Y", None)], "i int, name string, side string")
    got = [r[0] for r in df.orderBy("i").select(X.face_name("name", "side")).collect()]
    assert got == ["X", "Y", "X//Y", "A // B // C // D // E", "Plain", "X//Y", "X // Y"]


def test_split_lines_like_python(spark):
    # row 13: two lines, trailing newline, CRLF, empty
    vals = ["a\nb", "a\nb\n", "a\r\nb", "", "a\n\n", "x y\x0bz", "solo"]
    got = one_col(spark, vals, X.split_lines)
    assert got == [v.splitlines() for v in vals]


def test_ordinal_lines(spark):
    got = one_col(spark, ["first\nsecond\n", "", None], lambda c: X.ordinal_lines(c, 0))
    assert got == ["0. first\n1. second", "", None]
    got = one_col(spark, ["a\nb"], lambda c: X.ordinal_lines(c, 1, "  "))
    assert got == ["  1. a\n  2. b"]


def test_expand_abbreviations(spark):
    # row 19: ETB, LTB, both (LTB wins, ETB left as is)
    got = one_col(spark, ["Infinite ETB", "Infinite LTB", "ETB and LTB", "none"], X.expand_abbreviations)
    assert got == ["Infinite enters the battlefield", "Infinite leaves the battlefield",
                   "ETB and leaves the battlefield", "none"]


def test_tokens(spark):
    got = one_col(spark, ["Héllo wörld, a b_c 12"], X.word_tokens)
    assert got == [["héllo", "wörld", "b_c", "12"]]
    got = one_col(spark, ["<|start_header_id|>user [END OF COMBO STEPS]x, y"], X.train_tokens)
    assert got == [["<|start_header_id|>", "user", "[END OF COMBO STEPS]", "x", ",", "y"]]


def test_md5_bucket_stable(spark):
    import hashlib
    got = one_col(spark, ["12", "0", "abc"], lambda c: X.md5_bucket(c, 100))
    want = [int(hashlib.md5(v.encode()).hexdigest()[:8], 16) % 100 for v in ["12", "0", "abc"]]
    assert got == want


def test_null_predicates(spark):
    vals = [None, "", "x"]
    assert one_col(spark, vals, P.not_empty_keep_null) == [True, False, True]
    assert one_col(spark, vals, P.not_empty_sql) == [False, False, True]


def test_code_match_modes(spark):
    # row 15: W, WU, WUB, WRG; search WB (contains) hits nothing
    vals = ["W", "WU", "WUB", "WRG", None]
    assert one_col(spark, vals, lambda c: P.code_match(c, "WB")) == [False] * 5
    assert one_col(spark, vals, lambda c: P.code_match(c, "wu")) == [False, True, True, False, False]
    assert one_col(spark, vals, lambda c: P.code_match(c, "WUB", "subset")) == [True, True, True, False, False]
    assert one_col(spark, vals, lambda c: P.code_match(c, "WU", "superset")) == [False, True, True, False, False]
    assert one_col(spark, vals, lambda c: P.code_match(c, "WU", "exact")) == [False, True, False, False, False]


def test_literal_and_word_contains(spark):
    # row 16: {2}{W} is literal text; row 14: Land vs Island
    assert one_col(spark, ["{2}{W}{W}", "{2}{U}"], lambda c: P.contains_ci(c, "{2}{w}")) == [True, False]
    types = ["Basic Land — Island", "Island", "Creature"]
    assert one_col(spark, types, lambda c: P.contains_ci(c, "Land")) == [True, True, False]
    assert one_col(spark, types, lambda c: P.contains_word(c, "Land")) == [True, False, False]


def test_compile_filters(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), ("c", None, "x")], "k string, n int, t string")
    f = P.compile_filters({"t": "x", "n": {"$lte": 3}}, df.columns)
    assert [r.k for r in df.where(f).collect()] == ["a"]
    f = P.compile_filters({"k": ["a", "b"]}, df.columns)
    assert sorted(r.k for r in df.where(f).collect()) == ["a", "b"]
    f = P.compile_filters({"$or": [{"k": "c"}, {"n": {"$gt": 4}}]}, df.columns)
    assert sorted(r.k for r in df.where(f).collect()) == ["b", "c"]
    f = P.compile_filters({"$not": {"t": "x"}}, df.columns)
    assert [r.k for r in df.where(f).collect()] == ["b"]
    with pytest.raises(ValueError):
        P.compile_filters({"colors": ["R"]}, df.columns)
