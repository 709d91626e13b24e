import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from voltlane.operators import quality, rows, summaries
from voltlane.operators.storage import materialize, shared_dir


def test_keep_latest_orders_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", None, 1), ("a", 2, 9), ("a", 2, 3), (None, None, 7), (None, None, 4)], "k string, t int, id int")
    got = {r["k"]: r["id"] for r in rows.keep_latest(df, ["k"], ["t"], ["id"]).collect()}
    assert got == {"a": 3, None: 4}


def test_keep_latest_default_is_the_same_for_any_partitioning(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    one = sorted(rows.keep_latest(df.repartition(1), ["k"]).collect())
    many = sorted(rows.keep_latest(df.repartition(13, "v"), ["k"]).collect())
    assert one == many and len(one) == 7


def test_keep_latest_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), F.col("id").alias("t"))
    plan = rows.keep_latest(df, [F.col("k") % 2], ["t"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_top_n_is_not_a_full_sort(spark):
    plan = rows.top_n(spark.range(100), "id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert [r["id"] for r in rows.top_n(spark.range(5), "id", 2, ascending=True).collect()] == [0, 1]
    assert rows.arg_best(spark.range(5), "id").first()["id"] == 4


def test_global_rank_large_equals_small(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("score"))
    order = [F.desc("score"), F.asc("id")]
    small = {r["id"]: r["rank"] for r in rows.global_rank(df, order, small=True).collect()}
    large = rows.global_rank(df.repartition(8), order)
    assert {r["id"]: r["rank"] for r in large.collect()} == small
    assert "SinglePartition" not in large._jdf.queryExecution().executedPlan().toString().split("Window")[0]


def test_attach_scalars_rejects_two_rows(spark):
    ok = rows.attach_scalars(spark.range(2), spark.range(1).select(F.lit(7).alias("x"), F.lit("y").alias("z")))
    assert [tuple(r) for r in ok.collect()] == [(0, 7, "y"), (1, 7, "y")]
    assert "Join" not in ok._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception):
        rows.attach_scalars(spark.range(2), spark.range(2).select(F.col("id").alias("x"))).collect()


def test_ensure_keyed_and_required(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    assert {(r["k"], r["row_count"]) for r in rows.ensure_keyed(df, "k").collect()} == {("a", 2), (None, 1)}
    required = rows.require_columns(df, ["k"])
    assert not required.schema["k"].nullable
    with pytest.raises(Exception, match="null in required column"):
        required.collect()


def test_changes_since(spark):
    old = spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "c", "c"), (4, "d", "d")], "id int, p string, q string")
    new = spark.createDataFrame([(1, "a", None), (2, "x", None), (4, "d", "e"), (5, "n", None)], "id int, p string, q string")
    assert {(r[0], r[1]) for r in rows.changes_since(old, new, "id").collect()} == {(2, "update"), (3, "delete"), (4, "update"), (5, "insert")}
    assert rows.changes_since(old, new.withColumn("q", F.lit("z")), "id", ignore=["q"]).filter("id = 1").count() == 0


RULES = {"in_range": "x BETWEEN 0 AND 10", "named": "n IS NOT NULL"}


def test_expectations_treat_null_as_failed(spark):
    df = spark.createDataFrame([(0, "a"), (10, "b"), (11, "c"), (None, "d"), (5, None)], "x int, n string")
    seen = Observation("rules")
    kept = quality.expect_all_or_drop(df, RULES, seen)
    assert sorted(r["n"] for r in kept.collect()) == ["a", "b"]
    assert seen.get == {"rows": 5, "in_range_passed": 3, "in_range_dropped": 2, "named_passed": 4, "named_dropped": 1}
    assert {tuple(r) for r in quality.expectation_report(df, RULES).collect()} == {("in_range", 3, 2), ("named", 4, 1)}
    good, bad = quality.split_quarantine(df, RULES)
    assert good.count() == 2
    assert {(r["x"], tuple(r["failed_rules"])) for r in bad.collect()} == {(11, ("in_range",)), (None, ("in_range",)), (5, ("named",))}


def test_rules_on_unknown_columns_fail(spark):
    with pytest.raises(Exception):
        quality.expect_all_or_drop(spark.range(1), {"r": "missing > 0"}).collect()


def test_dq_report_on_an_empty_table(spark):
    df = spark.createDataFrame([], "f boolean, s boolean")
    assert [tuple(r) for r in quality.dq_report(df, ["f"], ["s"]).collect()] == [("f", 0, 0, 0.0), ("s", 0, 0, 0.0)]


def test_flagged_sample(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, None if i == 3 else True) for i in range(30)], "id int, f boolean, g boolean")
    assert [r["id"] for r in quality.flagged_sample(df, ["f", "g"], ["id"], 3).collect()] == [1, 3, 5]


def test_parity(spark):
    a, b = spark.range(100), spark.range(106)
    got = {r["check"]: r["passed"] for r in quality.parity_report(a, b, {"r": "id >= 0"}).collect()}
    assert got == {"row_count_drift": False, "same_schema": True, "pass_rate": True}
    got = {r["check"]: r["passed"] for r in quality.parity_report(a, spark.range(95).select(F.col("id").cast("int")), {"r": "id >= 5"}).collect()}
    assert got == {"row_count_drift": True, "same_schema": False, "pass_rate": False}
    assert {r["check"]: r["passed"] for r in quality.parity_report(spark.range(0), spark.range(0)).collect()}["row_count_drift"]


def test_table_counts_tolerates_missing_tables(spark):
    spark.range(3).createOrReplaceTempView("tc_a")
    spark.range(4).createOrReplaceTempView("tc_b")
    got = {r["table_name"]: r["row_count"] for r in quality.table_counts(spark, ["tc_a", "tc_none", "tc_b"]).collect()}
    assert got == {"tc_a": 3, "tc_none": None, "tc_b": 4, "total": 7}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 9.9, 10.0, None]], "v double")
    assert {r["bin"]: r["row_count"] for r in summaries.histogram(df, "v", 10).collect()} == {1: 1, 2: 1, 10: 2}
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [tuple(r) for r in summaries.histogram(flat, "v", 4).collect()] == [(1, 5.0, 2)]


def test_shares(spark):
    df = spark.createDataFrame([(True, 3), (False, 1), (None, 4)], "f boolean, x int")
    assert tuple(summaries.share_by(df, "f", "x").first()) == (3, 5, 37.5, 62.5)
    counts = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n int")
    assert {r["k"]: r["pct"] for r in summaries.with_pct(counts, "n").collect()} == {"a": 25.0, "b": 75.0}


def test_materialize_uses_the_folder_of_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(base)
    df = materialize(spark.range(5).withColumn("r", F.rand()))
    assert df.collect() == df.collect() and base in df.inputFiles()[0]
