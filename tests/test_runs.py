"""Layer tables, runs, scenarios, ledger, skew and prediction."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierworks.operators import ledger, predict, quality, scenario, skew
from tierworks.plans.run import Spec, run_layer
from tierworks.session import new_work_path
from tierworks.sources import append_batch, read_layer, read_raw_csv, staging_inventory, write_layer
from tierworks.sources.layers import MissingLayerTable, layer_name
from tierworks.sources.raw import inventory_totals
from tierworks.streaming import ingest_new_files


def test_csv_is_text_and_bad_inputs_are_skipped(spark):
    path = new_work_path(spark, "csv")
    spark.createDataFrame([("1", "x, y"), ("02", "")], "id string, t string").write.option("header", True).csv(path)
    df = read_raw_csv(spark, path, ["id", "t"])
    assert [t for _, t in df.dtypes] == ["string", "string"] and rows(df.select("id")) == [("02",), ("1",)]
    assert read_raw_csv(spark, path).columns == ["id", "t"]
    assert read_raw_csv(spark, path + "-none") is None
    empty = new_work_path(spark, "csv-empty")
    spark.createDataFrame([], "id string").write.option("header", True).csv(empty)
    assert read_raw_csv(spark, empty, ["id"]) is None


def test_inventory(spark):
    path = new_work_path(spark, "inventory")
    spark.range(10).repartition(3).write.parquet(path)
    got = staging_inventory({"t": spark.read.parquet(path)})
    row = got.first()
    assert (row["row_count"], row["column_count"]) == (10, 1) and row["size_bytes"] > 0
    assert inventory_totals(got).first()["total_rows"] == 10


def test_layer_tables(spark):
    with pytest.raises(MissingLayerTable, match="build layer"):
        read_layer(spark, "t_layer", "nothing")
    write_layer(spark.range(3), "t_layer", "a")
    write_layer(spark.range(2).withColumn("b", F.lit("x")), "t_layer", "a", partition_by=["b"])
    append_batch(spark.range(1).select(F.lit("y").alias("b"), "id"), "t_layer", "a")
    assert rows(read_layer(spark, "t_layer", "a").select("id", "b")) == [(0, "x"), (0, "y"), (1, "x")]
    assert layer_name("gold", "on") == "gold_aqe_on" and layer_name("gold", "x") == "gold_aqe_off"
    with pytest.raises(ValueError):
        write_layer(spark.range(1), "t_layer", "a; drop")


def test_bucketed_tables_meet_without_a_shuffle(spark, no_broadcast):
    for name in ("big", "other"):
        write_layer(spark.range(1000).select(F.col("id").alias("k"), F.lit(name).alias(name)), "t_layer", name, bucket_by=(4, ["k"]))
    joined = read_layer(spark, "t_layer", "big").join(read_layer(spark, "t_layer", "other"), "k").groupBy("k").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000


def test_run_goes_on_after_a_failure(spark):
    bad = spark.createDataFrame([(None, None)], "a string, b string")

    def broken(_):
        raise RuntimeError("boom")

    def unknown(s):
        return s.range(1).select("no_column")

    got = run_layer(
        spark, "t_run",
        [Spec("ok", lambda s: s.range(4)), Spec("broken", broken), Spec("unknown", unknown),
         Spec("rejected", lambda _: bad, score=quality.score(bad, "bad")), Spec("last", lambda s: s.range(1))],
        "p",
    )
    state = {r["table_name"]: (r["written"], r["row_count"]) for r in got.collect()}
    assert state == {"ok": (True, 4), "broken": (False, None), "unknown": (False, None), "rejected": (False, None), "last": (True, 1)}
    assert "REJECT" in got.filter("table_name = 'rejected'").first()["error"]
    assert not spark.catalog.tableExists("t_run.rejected")
    one = ledger.record(got).first()
    assert (one["tables_total"], one["tables_written"], one["rows_written"]) == (5, 2, 5)


def test_stream_takes_each_file_once(spark):
    base = new_work_path(spark, "stream")
    df = spark.range(5)
    df.write.parquet(f"{base}/in")
    for _ in range(2):
        ingest_new_files(spark, f"{base}/in", df.schema, f"{base}/out", f"{base}/state")
    df.write.mode("append").parquet(f"{base}/in")
    ingest_new_files(spark, f"{base}/in", df.schema, f"{base}/out", f"{base}/state")
    assert spark.read.parquet(f"{base}/out").count() == 10


def test_scenarios(spark, monkeypatch):
    monkeypatch.delenv("SPARK_AQE_SCENARIO", raising=False)
    assert [scenario.scenario_name(x) for x in (None, "on", "Yes", "0", "what")] == ["OFF", "ON", "ON", "OFF", "OFF"]
    monkeypatch.setenv("SPARK_AQE_SCENARIO", "enabled")
    assert scenario.scenario_name() == "ON" and scenario.scenario_name("off") == "OFF"
    a = scenario.ADAPTIVE
    skew_only = scenario.component_conf("on_skew_only")
    assert skew_only[a + "enabled"] == "true" and skew_only[a + "skewJoin.skewedPartitionFactor"] == "5"
    assert skew_only[a + "coalescePartitions.enabled"] == "false" and a + "advisoryPartitionSizeInBytes" not in skew_only
    dpp = scenario.component_conf("ON_DPP_ONLY")
    assert dpp[a + "enabled"] == "false" and dpp[scenario.PRUNING] == "true"
    assert scenario.component_conf("yes") == scenario.component_conf("ON_FULL")
    assert scenario.PRUNING not in scenario.aqe_conf("ON")
    before = spark.conf.get(a + "enabled")
    with scenario.settings(spark, scenario.component_conf("OFF")):
        assert spark.conf.get(a + "enabled") == "false"
    assert spark.conf.get(a + "enabled") == before


def test_compare_keeps_unmatched_workloads(spark):
    shape = "workload_id string, name string, workload_type string, duration_sec double, row_count bigint"
    off = spark.createDataFrame([("W1", "a", "join", 10.0, 100), ("W2", "b", "agg", 0.0, 5)], shape)
    on = spark.createDataFrame([("W1", "a", "join", 7.5, 100), ("W3", "c", "agg", 1.0, 3)], shape)
    got = {r["workload_id"]: r for r in scenario.compare(off, on).collect()}
    assert got["W1"]["speedup_pct"] == 25.0 and got["W1"]["throughput_off"] == 10.0
    assert got["W2"]["speedup_pct"] is None and got["W2"]["throughput_off"] is None and got["W3"]["name"] == "c"


def test_timed_run_reports_errors(spark):
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    work = [scenario.Workload("A", "a", "agg", spark.range(9)), scenario.Workload("B", "b", "agg", bad)]
    got = {r["workload_id"]: r for r in scenario.run_workloads(spark, work, "ON_FULL", warm_up=True).collect()}
    assert got["A"]["row_count"] == 9 and got["A"]["duration_sec"] >= 0
    assert got["B"]["status"] == "error" and got["B"]["duration_sec"] is None


def test_skew_statistics(spark):
    counts = [75, 10, 5, 5, 5]
    df = spark.createDataFrame([(k,) for k, n in enumerate(counts) for _ in range(n)], "k int")
    got = skew.key_skew(df, "k", "t").first()
    assert (got["row_count_total"], got["key_count"], got["min_rows_per_key"], got["max_rows_per_key"]) == (100, 5, 5, 75)
    assert (got["mean_rows_per_key"], got["skew_ratio_max_over_mean"], got["top_key_share_pct"]) == (20.0, 3.75, 75.0)
    assert got["p95_rows_per_key"] == sorted(counts)[min(4, int(5 * 0.95))]
    none = skew.key_skew(df.limit(0), "k", "t").first()
    assert (none["row_count_total"], none["key_count"]) == (0, 0)
    assert rows(skew.top_keys(df, "k", 2)) == [(0, 75), (1, 10)]


def test_p95_is_the_indexed_value(spark):
    for n in (1, 19, 20, 21, 100, 137):
        df = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("x"), F.col("id").alias("k"))
        assert skew.key_skew(df, "k", "t").first()["p95_rows_per_key"] == list(range(1, n + 1))[min(n - 1, int(n * 0.95))]


def test_injected_skew_is_repeatable(spark):
    df = spark.range(4000).select("id", (F.col("id") % 50).cast("int").alias("k"))
    a = skew.inject_skew(df.repartition(3), "k", 7, 0.75, ["id"])
    b = skew.inject_skew(df.repartition(8), "k", 7, 0.75, ["id"])
    assert rows(a) == rows(b) and 0.7 < a.filter("k = 7").count() / 4000 < 0.8


def test_ledger(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    entries = ledger.records(spark, [
        ("r1", "p", "ON", "aqe", t(0), t(1), "a", 5, True, None), ("r1", "p", "ON", "aqe", t(1), t(3), "b", None, False, "x"),
        ("r2", "p", "ON", "aqe", t(4), t(5), "a", 7, None, None), ("r3", "p", "OFF", "aqe", t(0), t(2), "a", 1, True, None),
    ])
    runs = ledger.record(entries)
    got = {r["run_id"]: r for r in runs.collect()}
    assert (got["r1"]["duration_sec"], got["r1"]["tables_total"], got["r1"]["tables_written"], got["r1"]["rows_written"]) == (180.0, 2, 1, 5)
    assert got["r2"]["tables_written"] == 1
    assert {(r["scenario"], r["run_id"]) for r in ledger.latest(runs).collect()} == {("ON", "r2"), ("OFF", "r3")}
    assert {r["run_id"] for r in ledger.runs_index(runs).filter("is_latest").collect()} == {"r2"}
    assert rows(ledger.artifacts(entries).select("run_id")) == [("r1",), ("r3",)]
    long = ledger.long_metrics(runs, {"run": "run_id"}, {"mae": "duration_sec", "none": F.lit(None)})
    assert {(r["metric"], r["metric_family"]) for r in long.collect()} == {("mae", "forecast")}
    line = ledger.exposition(long.filter("run = 'r1'").withColumn("run", F.lit('a"b')), ["run"]).first()[0]
    assert line == 'lakehouse_mae{run="a\\"b"} 180.0'


def test_forecasts(spark):
    df = spark.createDataFrame([(2000 + i, 90.0 + i) for i in range(12)], "y int, v double")
    got = predict.forecast_drift(df, "y", "v").orderBy("tahun").collect()
    assert [r["is_forecast"] for r in got] == [0] * 12 + [1] * 3
    assert [r["nilai_capaian"] for r in got[-3:]] == [100.0, 100.0, 100.0] and got[-3]["tahun"] == 2012
    capped = predict.forecast_drift(df, "y", "v", first=10).orderBy("tahun").collect()
    assert [r["is_forecast"] for r in capped] == [0] * 10 + [1] * 3 and capped[-3]["tahun"] == 2010
    lines = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, 3.0), ("b", 2001, 5.0)], "k string, y int, v double")
    ahead = {(r["k"], r["tahun"]): (r["forecast"], r["naive"]) for r in predict.forecast_trend(lines, ["k"], "y", "v", 2).collect()}
    assert ahead == {("a", 2002): (5.0, 3.0), ("a", 2003): (7.0, 3.0), ("b", 2002): (5.0, 5.0), ("b", 2003): (5.0, 5.0)}


def test_error_metrics(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (4.0, 4.0), (None, 3.0)], "a double, p double")
    m = predict.forecast_metrics(df, "a", "p").first()
    assert (m["n"], m["mae"], m["rmse"], m["mape"]) == (3, 0.6667, round(math.sqrt(2 / 3), 4), 25.0)
    assert m["r2"] == 0.75 and m["smape"] == round((200 / 3 + 200 + 0) / 3, 4)


def test_anomalies(spark):
    df = spark.createDataFrame([("m", float(i % 5)) for i in range(60)] + [("m", 500.0), ("flat", 1.0)], "m string, v double")
    got = predict.anomaly_z(df, "m", "v")
    assert rows(got.filter("is_anomaly = 1").select("v")) == [(500.0,)]
    assert rows(predict.anomaly_summary(got).select("total_records", "anomaly_count", "anomaly_rate_pct")) == [(62, 1, 1.61)]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    from tierworks.operators.joins import join_group_stats

    wide = join_group_stats(df, df.groupBy("m").agg(F.max("v").alias("top")), ["m"], most_rows=1)
    assert wide.count() == 62
    for scale in (1e-9, 1e20):
        scaled = predict.anomaly_z(df.withColumn("v", F.col("v") * scale), "m", "v")
        assert scaled.filter("is_anomaly = 1").count() == 1


def test_risk_model(spark):
    df = spark.range(400).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100))).cast("double").alias("noise")
    )
    df = predict.split_by_class(df.withColumn("label", predict.risk_label("x", F.lit(60.0))), ["id"])
    shares = [r[0] for r in df.groupBy("label").agg(F.avg(F.col("is_train").cast("int"))).select(F.col("avg(CAST(is_train AS INT))")).collect()]
    assert all(0.7 < s < 0.9 for s in shares)
    model = predict.train_risk(df, ["x", "noise"], "label", trees=10)
    held = predict.score_risk(model, df.filter("NOT is_train"), ["x", "noise"])
    m = predict.class_metrics(held, "label")
    assert m["accuracy"] > 0.9 and 0.9 < m["roc_auc"] <= 1.0 and set(m) == {"accuracy", "f1_macro", "precision", "recall", "roc_auc"}
    assert held.agg(F.min("risk_score") >= 0, F.max("risk_score") <= 100).first() == (True, True)
    holes = df.withColumn("x", F.when(F.col("id") % 3 > 0, F.col("x")))
    scored = predict.score_risk(predict.train_risk(holes, ["x", "noise"], "label", trees=5), holes, ["x", "noise"])
    assert scored.count() == 400 and scored.filter("risk_score IS NULL AND unscored = 'x' AND prediction IS NULL").count() == 134


def test_exact_auc(spark):
    """More distinct scores than the evaluator has bins by default."""
    df = spark.range(5000).select(
        (F.col("id") % 2).cast("double").alias("label"), (F.col("id") / 50 + F.when(F.col("id") % 2 == 1, 0.03).otherwise(0.0)).alias("risk_score"), F.lit(1.0).alias("prediction")
    )
    rows_ = df.select("label", "risk_score").collect()
    neg = sorted(r["risk_score"] for r in rows_ if not r["label"])
    import bisect

    won = sum((bisect.bisect_left(neg, r["risk_score"]) + bisect.bisect_right(neg, r["risk_score"])) / 2 for r in rows_ if r["label"])
    assert abs(predict.class_metrics(df, "label")["roc_auc"] - won / 2500 / 2500) < 1e-9


def test_opportunity(spark):
    df = spark.createDataFrame([(i, float(i), float(i * 2)) for i in range(12)], "u int, a double, b double")
    scored, silhouettes = predict.opportunity(df, "u", ["a", "b"])
    got = {r["u"]: r["opportunity_score"] for r in scored.collect()}
    assert got[0] == 0.0 and got[11] == 100.0 and set(silhouettes) == {3, 4, 5} and len(got) == 12
    assert all(-1 <= s <= 1 for s in silhouettes.values())
    blobs = spark.createDataFrame([(i, float(i % 4 * 10), float(i % 4 // 2 * 100 + i / 1000)) for i in range(40)], "u int, a double, b double")
    placed, tried = predict.opportunity(blobs.unionByName(blobs.limit(1).select(F.lit(99).alias("u"), "a", F.lit(None).cast("double").alias("b"))), "u", ["a", "b"])
    assert max(tried, key=tried.get) == 4 and placed.select("cluster").distinct().count() == 5
    assert placed.filter("u = 99 AND cluster IS NULL AND opportunity_score IS NULL").count() == 1


def test_runs_of_one_second_and_one_run_in_parts(spark):
    from tierworks.plans.run import Spec, new_run_id, run_layer

    assert len({new_run_id() for _ in range(100)}) == 100
    broken = [Spec("t", lambda _: (_ for _ in ()).throw(ValueError("no")))]
    own = new_run_id()
    parts = [run_layer(spark, "nowhere", broken, "silver_to_gold", run_id=own) for _ in range(2)]
    runs = ledger.record(parts[0].unionByName(parts[1]))
    assert runs.count() == 1 and ledger.summary(runs).first()["pipelines_found"] == 1 and runs.first()["tables_total"] == 2


def test_gate_outcomes_in_the_entries(spark, tmp_path):
    """Passed, quarantined and rejected sources, a failure, and a table without a gate."""
    from tierworks.plans.run import Spec, run_layer

    def score(value, status):
        return spark.createDataFrame([(value, status)], "quality_score double, status string")

    def broken(_):
        raise ValueError("no")

    table = lambda _: spark.range(3)
    entries = run_layer(
        spark, "tierworks_gate",
        [
            Spec("a", table, score=score(95.0, "PASS")), Spec("b", table, score=score(70.0, "QUARANTINE")), Spec("c", table, score=score(10.0, "REJECT")),
            Spec("d", broken, score=score(99.0, "PASS")), Spec("e", table),
        ],
        "bronze_to_silver", location=str(tmp_path),
    )
    got = {r["table_name"]: (r["row_count"], r["written"], r["source_score"], r["status"]) for r in entries.collect()}
    assert got == {"a": (3, True, 95.0, "PASS"), "b": (3, True, 70.0, "QUARANTINE"), "c": (None, False, 10.0, "REJECT"), "d": (None, False, 99.0, "PASS"), "e": (3, True, None, None)}
    tags = {t: [r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES tierworks_gate.{t}").collect() if r["key"] == "quality_status"] for t in "abe"}
    assert tags == {"a": [], "b": ["QUARANTINE"], "e": []}


def test_survivor_among_maps(spark):
    from tierworks.operators.shape import keep_one

    df = spark.createDataFrame([(1, {"a": 1, "b": 2}, {"x": {"p": 2}}), (1, {"b": 1, "a": 1}, {"x": {"p": 1}}), (1, None, None)], "k int, m map<string,int>, s struct<x:map<string,int>>")
    got = {tuple(sorted(r["m"].items())) if r["m"] else None for n in (1, 2, 3) for r in keep_one(df.repartition(n).filter("m IS NOT NULL"), ["k"]).collect()}
    assert got == {(("a", 1), ("b", 1))} and keep_one(df, ["k"]).count() == 1


def test_insight_sections(spark):
    shape = "section string, entity string, metric string, value double"
    base = spark.createDataFrame([("risk", "a", "m", 1.0), ("other", "a", "m", 2.0), ("anomaly", "x", "total", 3.0), ("anomaly", "x", "n", 4.0)], shape)
    new = spark.createDataFrame([("risk", "b", "m", 9.0), ("anomaly", "x", "n", 8.0)], shape)
    assert rows(predict.insight_long(base, new)) == [
        ("anomaly", "x", "n", 8.0), ("anomaly", "x", "total", 3.0), ("other", "a", "m", 2.0), ("risk", "b", "m", 9.0)]
    assert rows(predict.preflight(spark, ["nowhere.nothing"]).select("found", "row_count")) == [(False, None)]


def test_tables_wait_for_their_sources_and_independent_ones_meet(spark):
    import threading
    import time

    from tierworks.plans.run import Spec, order, run_graph
    from tierworks.session import new_work_path

    where, lock, seen, most = new_work_path(spark, "graph"), threading.Lock(), [], [0, 0]

    def build(name, fails=False):
        def run(session):
            with lock:
                seen.append(name)
                most[0] += 1
                most[1] = max(most)
            time.sleep(0.3)
            with lock:
                most[0] -= 1
            if fails:
                raise ValueError(f"{name} fails\nat length")
            return session.range(3)

        return run

    specs = [
        Spec("d", build("d"), ["b", "c"]), Spec("b", build("b"), ["a"]), Spec("c", build("c"), ["a", "outside"]), Spec("a", build("a")), Spec("x", build("x", True)),
        Spec("y", build("y"), ["x"]), Spec("z", build("z"), ["y", "a"]),
    ]
    entries = run_graph(spark, "tierworks_test", specs, "p", at_once=2, location=where, suffix="_" + where[-8:]).collect()
    got = {r["table_name"][:1]: (r["written"], r["row_count"], r["error"]) for r in entries}
    assert [r["table_name"][0] for r in entries] == ["d", "b", "c", "a", "x", "y", "z"] and len({r["run_id"] for r in entries}) == 1
    assert all(got[n] == (True, 3, None) for n in "abcd")
    assert got["x"] == (False, None, "x fails") and got["y"][2] == "source x was not written" and got["z"][2] == "source y was not written"
    assert seen.index("a") < min(seen.index("b"), seen.index("c")) and seen[-1] == "d" or seen.index("d") > max(seen.index("b"), seen.index("c"))
    assert most[1] == 2 and set(seen) == {"a", "b", "c", "d", "x"}
    assert run_graph(spark, "tierworks_test", [], "p").count() == 0
    with pytest.raises(ValueError, match="from one another: a, b"):
        order([Spec("a", build("a"), ["b"]), Spec("b", build("b"), ["a"]), Spec("c", build("c"))])
    with pytest.raises(ValueError, match="twice"):
        order([Spec("a", build("a")), Spec("a", build("a"))])
