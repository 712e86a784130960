import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierworks.operators import profile, quality


def test_profile_counts_blank_and_null(spark):
    df = spark.createDataFrame(
        [("a", 1.0), (None, -0.0), ("  ", 0.0), ("", None), ("a", 2.0)], "t string, n double"
    )
    got = {r["column_name"]: r for r in profile.columns(df, "t").collect()}
    assert (got["t"]["row_count"], got["t"]["null_count"], got["t"]["distinct_count"]) == (5, 3, 3)
    assert got["t"]["completeness_pct"] == 40.0 and got["t"]["data_type"] == "string"
    # Both zeros are one value, as in a distinct count.
    assert got["n"]["distinct_count"] == df.agg(F.count_distinct("n")).first()[0] == 3
    blank = {r["column_name"]: r for r in profile.columns(df, "t", blank_is_value=True).collect()}
    assert blank["t"]["distinct_count"] == 3 and blank["t"]["null_count"] == 3


def test_profile_keeps_long_texts_apart(spark):
    df = spark.createDataFrame([("x" * 500 + str(i % 3),) for i in range(9)] + [(" " * 500,)], "t string")
    got = profile.columns(df, "t").first()
    assert got["distinct_count"] == 4 and got["null_count"] == 1


def test_profile_approximate(spark):
    df = spark.range(500).select((F.col("id") % 20).cast("string").alias("k"))
    exact, near = profile.columns(df, "t").first(), profile.columns(df, "t", approx=True).first()
    assert exact["distinct_count"] == 20 and abs(near["distinct_count"] - 20) <= 2
    assert (near["row_count"], near["null_count"]) == (500, 0)


def test_empty_table_is_rejected(spark):
    empty = spark.createDataFrame([], "a string, b int")
    got = quality.score(empty, "none").first()
    assert (got["row_count"], got["column_count"], got["quality_score"], got["status"]) == (0, 2, 0.0, "REJECT")
    assert profile.columns(empty, "none").count() == 2
    assert quality.gate(empty, quality.score(empty, "none")).count() == 0


@pytest.mark.parametrize(
    "score, want", [(80.0, "PASS"), (79.99, "QUARANTINE"), (60.0, "QUARANTINE"), (59.99, "REJECT")]
)
def test_gate_limits(spark, score, want):
    assert spark.range(1).select(quality.status(F.lit(score))).first()[0] == want


def test_gate_is_part_of_the_query(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("c", "y")], "k string, v string")
    kept = quality.gate(df, quality.score(df, "t"))
    assert rows(kept.select("k", "quality_status")) == [("a", "PASS"), ("b", "PASS"), ("c", "PASS")]
    bad = spark.createDataFrame([(None, None), (None, "x")], "k string, v string")
    assert quality.gate(bad, quality.score(bad, "t")).collect() == []


def test_combined_rules(spark):
    scores = spark.createDataFrame(
        [("a", 10, 2, 100.0, "PASS"), ("b", 5, 2, 30.0, "REJECT")],
        "table_name string, row_count bigint, column_count int, quality_score double, status string",
    )
    mean, either = quality.combine(scores, "u").first(), quality.combine(scores, "u", "any").first()
    assert (mean["row_count"], mean["quality_score"], mean["status"]) == (15, 65.0, "QUARANTINE")
    assert either["status"] == "PASS"


def test_profile_of_a_hot_value(spark):
    """A column with one value for most rows sends one row per task, not the rows."""
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    got = profile.columns(df.repartition(8), "t").first()
    assert got["row_count"] == 20000 and got["distinct_count"] == 6668
    plan = profile.columns(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_profile_of_nested_nulls(spark):
    df = spark.createDataFrame([([1], {"a": 1}, (1,)), (None, None, None), (None, None, None)], "arr array<int>, m map<string,int>, s struct<x:int>")
    got = {r["column_name"]: (r["null_count"], r["distinct_count"]) for r in profile.columns(df, "t").collect()}
    assert got == {"arr": (2, 1), "m": (2, 1), "s": (2, 1)}
    assert {r["column_name"]: r["null_count"] for r in profile.completeness(df, "t").collect()} == {"arr": 2, "m": 2, "s": 2}
