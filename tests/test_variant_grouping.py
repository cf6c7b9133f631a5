"""Nested variants by one grouping of orders and lines; lines split without a pattern per row."""

import datetime as dt

from pyspark.sql import functions as F

from lexiforge.functions.text import split_lines
from lexiforge.plans import analogs as A

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_linestatus string")


def write(spark, folder):
    day = dt.date(1995, 1, 1)
    spark.createDataFrame([(1, "O", "1-URGENT", day), (2, "F", "2-HIGH", day), (3, "P", None, day), (3, "F", "5-LOW", day),
                           (None, "F", "5-LOW", day)],
                          "o_orderkey long, o_orderstatus string, o_orderpriority string, o_orderdate date").write.parquet(
        f"{folder}/orders.parquet")
    spark.createDataFrame([(1, 7, 70, 2, 3.0, 1.0, "A", "O"), (1, 8, 80, 1, 2.0, 1.0, "R", "F"), (1, 8, 80, 1, 2.0, 1.0, "R", "F"),
                           (3, 7, 71, None, None, 1.0, None, None), (None, 7, 72, 1, 1.0, 1.0, "N", "O"),
                           (9, 7, 73, 1, 1.0, 1.0, "N", "O"), (2, None, 74, 1, 1.0, 1.0, "N", "O")], LINE).write.parquet(
        f"{folder}/lineitem.parquet")
    spark.createDataFrame([(7, "nut", "TIN"), (8, None, None)], "p_partkey long, p_name string, p_type string").write.parquet(
        f"{folder}/part.parquet")
    return A.variants(spark, folder)


def test_null_and_repeated_keys(spark, tmp_dir):
    rows = write(spark, tmp_dir).collect()
    short = sorted(((r["id"], r["manaNeeded"], r["variantCount"], r["description"], [u["card"]["name"] for u in r["uses"]],
                     [u["zoneLocations"] for u in r["uses"]], [u["mustBeCommander"] for u in r["uses"]],
                     [(q["template"]["id"], q["template"]["name"]) for q in r["requires"]],
                     [(p["feature"]["id"], p["feature"]["name"], p["feature"]["uncountable"], p["quantity"]) for p in r["produces"]],
                     [x["id"] for x in r["of"]], [x["id"] for x in r["includes"]]) for r in rows), key=str)
    three = (1, "", ["nut"], [["H"]], [None], [], [(None, "ETB then LTB", None, None)], [71], [7])
    none = (0, None, [], [], [], [], [], [], [])
    assert short == sorted([
        ("1", "1-URGENT", 3, "Use nut x3", [None, None, "nut"], [["B"], ["B"], ["G", "E"]], [True, True, False],
         [(2, "Any TIN")], [(1, "Infinite LTB", False, 2), (1, "Infinite LTB", False, 2), (2, "ETB then LTB", True, 3)],
         [80, 80, 70], [8, 8, 7]),
        ("2", "2-HIGH", *none), ("3", None, *three), ("3", "5-LOW", *three), (None, "5-LOW", *none)], key=str)


def test_one_join_and_no_interpreted_structs(spark, tmp_dir):
    plan = write(spark, tmp_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "lambdafunction(named_struct" not in plan and "lambdafunction(struct" not in plan


def test_orders_without_a_key_pass_beside_the_grouping(spark, tmp_dir):
    plan = write(spark, tmp_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(o_orderkey" in plan and "isnotnull(o_orderkey" in plan.split("Aggregate")[1]


def test_lines_split_like_python(spark):
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    texts = ["", "a", "\n\n", "\n\r", "a\r\r\n", "\r\r\n\n", "a\nb", "a\nb\n\n", None]
    texts += [f"{x}a{x}{y}b{y}" for x in breaks for y in breaks] + [f"a{x}" for x in breaks] + breaks
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines("t").alias("s")).collect()
    assert [r["s"] for r in rows] == [None if r["t"] is None else r["t"].splitlines() for r in rows]


def test_plain_lines_need_no_pattern(spark):
    plan = spark.range(1).select(split_lines(F.col("id").cast("string")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert "split(" in plan and plan.count("regexp_replace") <= plan.count("RLIKE")
