"""The run ledger: one row per run and table, and the reports read from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.functions import code_lookup, half_up

RECORD_SCHEMA = (
    "run_id string, pipeline string, scenario string, track string, started_at timestamp_ntz, "
    "ended_at timestamp_ntz, table_name string, row_count bigint, written boolean, error string, "
    "source_score double, status string"
)

# Evaluation family of each metric name.
METRIC_FAMILY = {
    "mae": "forecast", "rmse": "forecast", "mape": "forecast", "smape": "forecast", "r2": "forecast",
    "accuracy": "classification", "f1_macro": "classification", "f1": "classification",
    "roc_auc": "classification", "precision": "classification", "recall": "classification",
    "silhouette": "clustering", "davies_bouldin": "clustering", "calinski_harabasz": "clustering",
    "anomaly_rate_train": "anomaly", "precision_at_k": "anomaly", "anomaly_rate": "anomaly",
}

# Tracks a run can belong to.
TRACKS = ("aqe", "metadata", "mlops")


def records(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Entries as tuples in the order of the schema; the gate's score and status may be left out."""
    width = len(RECORD_SCHEMA.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], RECORD_SCHEMA)


def seconds_between(start: str, end: str) -> Column:
    return half_up(F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 1_000_000.0, 3)


def record(entries: DataFrame) -> DataFrame:
    """One row per run: duration, tables and written tables, rows written.

    A run in which no table was marked as written counts all its tables, as a run
    without such marks does.
    """
    runs = entries.groupBy("run_id", "pipeline", "scenario", "track").agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.count(F.lit(1)).alias("tables_total"),
        F.count_if(F.coalesce("written", F.lit(False))).alias("marked"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_written"),
    )
    return runs.select(
        "run_id", "pipeline", "scenario", "track", "started_at", "ended_at",
        seconds_between("started_at", "ended_at").alias("duration_sec"),
        "tables_total",
        F.when(F.col("marked") > 0, F.col("marked")).otherwise(F.col("tables_total")).alias("tables_written"),
        "rows_written",
    )


def latest(runs: DataFrame, by: Sequence[str] = ("pipeline", "scenario")) -> DataFrame:
    """The run that ended last per group (run id breaks ties). Partial results meet, never whole groups."""
    rest = [c for c in runs.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct("ended_at", "run_id"))
    return runs.groupBy(*by).agg(newest.alias("r")).select(*by, "r.*")


def summary(
    runs: DataFrame,
    pipelines: Sequence[str] = ("staging_to_bronze", "bronze_to_silver", "silver_to_gold"),
) -> DataFrame:
    """The experiment in one row: total seconds and rows of the latest run of each pipeline, and their ids."""
    last = latest(runs.filter(F.col("pipeline").isin(*pipelines)), ["pipeline"])
    per = [
        F.max(F.when(F.col("pipeline") == p, F.col(c))).alias(f"{p}_{c}")
        for p in pipelines
        for c in ("run_id", "duration_sec")
    ]
    return last.agg(
        half_up(F.sum(F.col("duration_sec").cast("decimal(20,3)")).cast("double"), 3).alias("pipeline_runtime_total_sec"),
        F.sum("rows_written").cast("bigint").alias("rows_written"),
        F.count(F.lit(1)).alias("pipelines_found"),
        *per,
    )


def long_metrics(df: DataFrame, labels: Mapping[str, Column | str], metrics: Mapping[str, Column | str]) -> DataFrame:
    """Wide measures to one row per metric and label set, NULL measures left out, with the metric's family."""
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value"))
            for m, c in metrics.items()
        ]
    )
    kept = [(F.col(c) if isinstance(c, str) else c).cast("string").alias(n) for n, c in labels.items()]
    long = df.select(*kept, F.explode(pairs).alias("m")).select(*labels, "m.metric", "m.value")
    family = code_lookup("metric", METRIC_FAMILY, F.lit("pipeline"))
    return long.filter(F.col("value").isNotNull()).withColumn("metric_family", family)


def exposition(long: DataFrame, labels: Sequence[str], prefix: str = "lakehouse_") -> DataFrame:
    """The text form of metric rows: ``name{label="value",...} value``."""
    pairs = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c}="'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"')))
        for c in labels
    ]
    body = F.concat_ws(",", *pairs)
    return long.select(
        F.concat(F.lit(prefix), "metric", F.lit("{"), body, F.lit("} "), F.col("value").cast("string")).alias("line")
    )


def runs_index(runs: DataFrame) -> DataFrame:
    """Every run with its track and whether it is the track's latest."""
    newest = latest(runs, ["track"]).select("track", F.col("run_id").alias("latest_run"))
    return runs.join(newest, "track", "left").select(
        "run_id", "track", "pipeline", "scenario", "started_at", "ended_at", "duration_sec", "tables_total",
        (F.col("run_id") == F.col("latest_run")).alias("is_latest"),
    )


def artifacts(entries: DataFrame) -> DataFrame:
    """Distinct (run, table) pairs: what each run left behind."""
    return entries.filter(F.coalesce("written", F.lit(False))).select("run_id", "track", "table_name").distinct()


def silver_summary(runs: DataFrame, workload_runs: DataFrame, skew: DataFrame, pipeline: str = "bronze_to_silver") -> DataFrame:
    """Latest duration of the cleaning run per scenario, with its workload seconds and the worst key skew."""
    last = latest(runs.filter(F.col("pipeline") == pipeline)).select("scenario", "run_id", "duration_sec")
    work = workload_runs.groupBy("scenario").agg(
        half_up(F.sum(F.col("duration_sec").cast("decimal(20,3)")).cast("double"), 3).alias("workload_sec"),
        F.count(F.lit(1)).alias("n_workloads"),
    )
    worst = skew.agg(F.max("skew_ratio_max_over_mean")).scalar()
    return last.join(work, "scenario", "full").withColumn("max_skew_ratio", worst)


def now() -> datetime:
    return datetime.now().astimezone().replace(tzinfo=None)
