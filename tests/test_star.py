"""Cleaning, dimensions, KPI facts and OLAP on small inline tables."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierworks.operators import gold, kpi, olap, silver
from tierworks.operators.joins import matched_pairs, orphan_keys, sum_by_attribute
from tierworks.operators.shape import ensure_column, first_of_duplicate_columns, keep_one, sample_rows


def test_keep_one_is_the_same_on_every_layout(spark):
    df = spark.createDataFrame([(i % 5, i % 3, f"p{i % 7}") for i in range(300)], "k int, d int, p string")
    first = rows(keep_one(df.repartition(1), ["k"], [F.desc("d")]))
    assert first == rows(keep_one(df.repartition(11), ["k"], [F.desc("d")])) and len(first) == 5
    assert all(r[1] == 2 and r[2] == "p0" for r in first)


def test_keep_one_cuts_hot_keys_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id"))
    plan = keep_one(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before_exchange and "Partial" in before_exchange


def test_latest_valid_keeps_the_end_date_and_breaks_ties(spark):
    df = spark.createDataFrame(
        [("P1", "2020-01-01", "2024-06-30", "a"), ("P1", "2020-01-01", "2025-01-01", "b"),
         ("P2", "2023-01-01", "2024-06-29", "c"), ("P3", "2019-01-01", "2024-06-30", "d")],
        "prodi string, sk string, until string, body string",
    )
    got = silver.latest_valid(df, ["prodi"], "sk", "until", "2024-06-30")
    assert rows(got.select("prodi", "body")) == [("P1", "a"), ("P3", "d")]


def test_lookup_keeps_rows_without_a_match(spark):
    df = spark.createDataFrame([(1, "A", None), (1, "A", None), (2, "Z", "own"), (3, None, None)], "id int, k string, f string")
    ref = spark.createDataFrame([("A", "ref", "Name A"), ("A", "ref2", "Name A2")], "k string, rf string, n string")
    got = silver.enrich_lookup(
        df, ref, "k", ["id"], filled=[silver.Filled("f", own="f", ref="rf"), silver.Filled("label", ref="n", code="k", names={"Z": "Zed"})]
    )
    assert rows(got.select("id", "f", "label")) == [(1, "ref", "Name A"), (2, "own", "Zed"), (3, None, None)]


def test_union_and_flags(spark):
    a = spark.createDataFrame([("1", "True")], "a_id string, r string")
    b = spark.createDataFrame([("1", "x"), ("2", "False")], "b_id string, r string")
    part = lambda df, k, t: silver.Part(df, t, {"id": F.col(k), "r": F.col("r").try_cast("boolean")})
    got = silver.union_tagged([part(a, "a_id", "A"), part(b, "b_id", "B")], "kind", ["id"])
    assert len(rows(got)) == 2 and got.filter("id = '2'").first()["r"] is False


def test_duplicate_columns_and_defaults(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    assert first_of_duplicate_columns(df, ["b", "a", "zzz"]).first().asDict() == {"b": 2, "a": 1}
    assert ensure_column(df.toDF("a", "b", "c"), "s", "Aktif").first()["s"] == "Aktif"


def test_sample_is_capped_and_repeatable(spark):
    df = spark.range(5000)
    a, b = rows(sample_rows(df.repartition(3), 100, ["id"])), rows(sample_rows(df.repartition(9), 100, ["id"]))
    assert a == b and 50 <= len(a) <= 100
    assert sample_rows(df, 10000, ["id"]).count() == 5000


def test_calendar(spark):
    cal = gold.dim_calendar(spark, 2020, 2025)
    assert cal.count() == 72
    got = {r["waktu_id"]: r for r in cal.collect()}
    assert got[202001]["semester"] == "Ganjil" and got[202002]["semester"] == "Genap" and got[202008]["semester"] == "Ganjil"
    assert got[202412]["triwulan"] == 4 and got[202412]["nama_bulan"] == "Desember" and got[202407]["semester"] == "Genap"
    dated = spark.createDataFrame([("2021-03-04",), (None,)], "d string").select(F.to_date("d").alias("d"))
    assert gold.dim_calendar_of(dated, "d").count() == 12
    assert gold.dim_calendar_of(dated.filter("d > '2030-01-01'"), "d").count() == 0


def flags(**kv):
    return {k: F.col(v) for k, v in kv.items()}


def test_sum_of_flags_can_exceed_all_rows(spark):
    df = spark.createDataFrame([("A", True, True), ("A", True, None), ("B", False, None)], "u string, x boolean, y boolean")
    got = {r["u"]: r for r in kpi.flag_sum_fact(df, "u", "n", flags(nx="x", ny="y"), "met", "p").collect()}
    assert (got["A"]["met"], got["A"]["p"]) == (3, 150.0)
    either = {r["u"]: r for r in kpi.flag_sum_fact(df, "u", "n", flags(nx="x", ny="y"), "met", "p", "any").collect()}
    assert (either["A"]["met"], either["A"]["p"], either["B"]["p"]) == (2, 100.0, 0.0)


def test_denominator_of_active_or_all(spark):
    act = spark.createDataFrame([(1, 2024, "Q"), (1, 2024, "Z"), (2, 2024, "Z")], "d int, y int, k string")
    parent = spark.createDataFrame([(1, "P"), (2, "P"), (3, "P"), (4, "P")], "d int, u string")
    kinds = {"q": F.col("k") == "Q"}
    active = kpi.any_flag_fact(act, parent, "d", "y", "u", kinds, "n", "met", "p").first()
    everyone = kpi.any_flag_fact(act, parent, "d", "y", "u", kinds, "n", "met", "p", "all").first()
    assert (active["n"], active["met"], active["p"]) == (2, 1, 50.0)
    assert (everyone["n"], everyone["p"]) == (4, 25.0)


def test_year_without_target(spark):
    df = spark.createDataFrame([(2024, 50.0), (2019, 50.0)], "tahun int, p double")
    goals = kpi.target_for("tahun", {2024: 40})
    got = {r["tahun"]: r for r in kpi.scored(df, "p", goals).collect()}
    assert got[2024]["capaian_iku"] == 125.0 and got[2019]["target_iku"] is None and got[2019]["capaian_iku"] is None
    old = {r["tahun"]: r for r in kpi.scored(df, "p", goals, unknown_target="floor").collect()}
    assert old[2019]["capaian_iku"] == 5000.0


def test_recap_falls_back(spark):
    fact = spark.createDataFrame([(202112, 10.0, 20.0), (202112, 20.0, 20.0), (202312, 40.0, 30.0)], "waktu_id int, v double, target_iku double")
    lines = [kpi.Indicator("K1", "one", fact, "v"), kpi.Indicator("K2", "two", None, "v")]
    table = {"K1": {2021: 1, 2024: 2}, "K2": {2021: 100, 2022: 200, 2024: 50}}
    got = {(r["iku_kode"], r["waktu_id"]): r for r in kpi.recap(spark, lines, table, [2021, 2022, 2023], 2024).collect()}
    assert got["K1", 202112]["nilai_capaian"] == 15.0 and got["K1", 202112]["nilai_target"] == 20.0
    assert got["K1", 202112]["status_capaian"] == "Tidak Tercapai"
    # No rows in 2022: the mean of the whole fact.
    assert got["K1", 202212]["nilai_capaian"] == 23.33 and got["K1", 202212]["status_capaian"] == "Tercapai"
    # No fact: the default line, and the target of the fallback year where the year has none.
    assert got["K2", 202112]["nilai_capaian"] == 85.0 and got["K2", 202212]["nilai_capaian"] == 176.0
    assert got["K2", 202312]["nilai_target"] == 50.0 and got["K2", 202312]["status_capaian"] == "On Track"
    assert [r["fact_id"] for r in sorted(got.values(), key=lambda r: r["fact_id"])] == [1, 2, 3, 4, 5, 6]


def test_entity_share_repeats_or_follows_the_year(spark):
    everyone = spark.createDataFrame([(i,) for i in range(8)], "k int")
    hits = spark.createDataFrame([(1, 2021), (1, 2022), (2, 2022)], "k int, y int")
    args = (everyone, hits, "k", "n", "met", "p", {2021: 10, 2022: 50})
    assert rows(kpi.entity_share_by_year(*args).select("tahun", "met", "p")) == [(2021, 2, 25.0), (2022, 2, 25.0)]
    assert rows(kpi.entity_share_by_year(*args, year="y").select("tahun", "met", "p")) == [(2021, 1, 12.5), (2022, 2, 25.0)]


def hot_rows(spark, n=3000):
    """A third of the rows at one key."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 4).alias("y"))


@pytest.mark.parametrize("broadcast", [True, False])
def test_sum_by_attribute_both_ways(spark, broadcast):
    df = hot_rows(spark)
    ref = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("u"))
    one = F.lit(1).cast("bigint")
    want = rows(df.join(ref, "k").groupBy("u", "y").count())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = sum_by_attribute(df, ref, "k", ["y"], ["u"], {"n": one})
        assert rows(got) == want
        # Rows are summed per key before the first shuffle.
        if not broadcast:
            assert "partial_sum" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pairs_of_a_hot_key_without_the_pairs(spark):
    a, b = hot_rows(spark).select("k"), hot_rows(spark, 900).select("k")
    want = rows(a.join(b, "k").groupBy("k").count())
    got = matched_pairs(a, b, "k")
    assert rows(got.withColumn("cnt", F.col("cnt").cast("bigint"))) == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_beyond_a_long(spark):
    """Two keys of four thousand million rows each; the counts stand in for the rows."""
    big = spark.range(2).select("id", F.lit(4_000_000_000).cast("bigint").alias("n"))
    from unittest.mock import patch

    from tierworks.operators import joins

    with patch.object(joins.F, "count", lambda _: F.max("n")):
        got = matched_pairs(big, big, "id").agg(F.sum("cnt")).first()[0]
    assert got == 2 * 4_000_000_000**2


def test_orphans_and_star_check(spark):
    fact = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int")
    dim = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(orphan_keys(fact.filter("k IS NOT NULL"), dim, "k")) == [(9,)]
    got = dict(rows(olap.check_star(fact, dim, "k")))
    assert got == {"n_fact": 4, "n_dim": 2, "n_join": 2, "min_fact_key": 1, "max_fact_key": 9, "min_dim_key": 1, "max_dim_key": 2, "n_orphan_keys": 1}


def test_rollup_classes_and_parity(spark):
    df = spark.createDataFrame([("A", 1, 50.0, "x"), ("A", 3, 100.0, "y"), ("B", 1, 0.0, "z")], "u string, n int, p double, g string")
    got = olap.rollup(df, ["u"], {"n": olap.ADDITIVE, "p": olap.SEMI_ADDITIVE, "g": olap.NON_ADDITIVE})
    assert rows(got) == [("A", 4, 75.0, "y"), ("B", 1, 0.0, "z")]
    with pytest.raises(ValueError):
        olap.rollup(df, ["u"], {"n": "other"})
    assert rows(olap.parity(df, df.filter("n = 1").union(df.filter("n = 1")))) == [("OFF", 3, 1), ("ON", 4, 2)]
