from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierworks.functions import (
    achievement,
    as_bool,
    blank,
    code_lookup,
    grain_id,
    half_up,
    layer_of,
    percent,
    quota_status,
    ratio,
    table_part,
    year_of,
)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_blank(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("a",)], "v string")
    assert [r[0] for r in df.select(blank("v")).collect()] == [True, True, True, False]


def test_ties_round_up(spark):
    assert one(spark, half_up(F.lit(0.285), 2)) == 0.29
    assert one(spark, half_up(F.lit(2.675), 2)) == 2.68
    assert one(spark, percent("n", "d"), n=9, d=800) == 1.13


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(0, 10**9)), min_size=1, max_size=20))
def test_percent_is_exact(spark, pairs):
    from decimal import ROUND_HALF_UP, Decimal
    from fractions import Fraction

    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    text = df.select(percent("n", "d").alias("a"), percent(F.col("n"), F.col("d")).alias("b"), ratio("n", "d", 4).alias("r"))
    for (n, d), row in zip(pairs, text.collect()):
        hundredths = Fraction(n * 10000, max(d, 1))
        want = float(Decimal(int(hundredths + Fraction(1, 2))) / 100)
        assert row["a"] == row["b"] == want
        assert row["r"] == float((Decimal(n) / max(d, 1)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def test_achievement_without_target(spark):
    known = one(spark, achievement(F.lit(39.0), F.lit(78.0)))
    assert known == 50.0
    none = F.lit(None).cast("double")
    assert one(spark, achievement(F.lit(28.9491), none)) is None
    # The compatible form divides by the floor of 1.
    assert one(spark, achievement(F.lit(28.9491), none, unknown="floor")) == 2894.91


def test_status_limits(spark):
    values = [(50.0, "Tercapai"), (40.0, "On Track"), (39.99, "Tidak Tercapai"), (None, None)]
    df = spark.createDataFrame([(v,) for v, _ in values], "v double")
    assert [r[0] for r in df.select(quota_status("v", F.lit(50.0))).collect()] == [s for _, s in values]


def test_lookup_keeps_missing_keys_null(spark):
    df = spark.createDataFrame([("FS",), ("JTK",), (None,), ("it's",)], "k string")
    table = {"FS": "Science", "it's": "quo'ted\\"}
    got = [r[0] for r in df.select(code_lookup("k", table)).collect()]
    assert got == ["Science", None, None, "quo'ted\\"]
    assert [r[0] for r in df.select(code_lookup("k", table, F.lit("?"))).collect()][1] == "?"


def test_bad_text_is_null_not_an_error(spark):
    df = spark.createDataFrame([("2024-05-06",), ("x",), ("",), (None,)], "d string")
    assert [r[0] for r in df.select(year_of("d")).collect()] == [2024, None, None, None]
    flags = spark.createDataFrame([("True",), ("False",), ("maybe",), (None,)], "b string")
    assert [r[0] for r in flags.select(as_bool("b")).collect()] == [True, False, None, None]


def test_names(spark):
    rows = [("silver.silver_dosen@store", None), ("plain", "gold"), ("x.y.z@s", ""), ("staging.raw@store", "bronze")]
    df = spark.createDataFrame(rows, "q string, l string")
    got = [tuple(r) for r in df.select(table_part(F.col("q")), layer_of(F.col("q"), F.col("l"))).collect()]
    assert got == [("silver_dosen", "silver"), ("plain", "gold"), ("y.z", "unknown"), ("raw", "bronze")]


def test_grain_id_does_not_depend_on_layout(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    ids = lambda d: {r[0] for r in d.select(grain_id("a", "b")).collect()}
    assert ids(df.repartition(1)) == ids(df.repartition(13)) and len(ids(df)) == 1000


def test_dates_are_dates(spark):
    assert one(spark, F.try_to_date(F.lit("2024-01-02"))) == date(2024, 1, 2)
