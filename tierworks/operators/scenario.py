"""Execution scenarios, workloads, timed runs and their comparison."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.functions import half_up

ADAPTIVE = "spark.sql.adaptive."
PRUNING = "spark.sql.optimizer.dynamicPartitionPruning.enabled"

# What each component switches.
COMPONENTS: dict[str, tuple[str, ...]] = {
    "coalesce": (ADAPTIVE + "coalescePartitions.enabled",),
    "skew": (ADAPTIVE + "skewJoin.enabled", ADAPTIVE + "optimizeSkewsInRebalancePartitions.enabled"),
    "local_shuffle": (ADAPTIVE + "localShuffleReader.enabled",),
    "dpp": (PRUNING,),
}
# Sizes a component is run with.
SIZES: dict[str, dict[str, str]] = {
    "coalesce": {
        ADAPTIVE + "advisoryPartitionSizeInBytes": "64MB",
        ADAPTIVE + "coalescePartitions.minPartitionSize": "1MB",
    },
    "skew": {
        ADAPTIVE + "skewJoin.skewedPartitionFactor": "5",
        ADAPTIVE + "skewJoin.skewedPartitionThresholdInBytes": "256MB",
    },
}
# Profiles by name; the flag says whether re-planning is on at all.
PROFILES: dict[str, tuple[bool, tuple[str, ...]]] = {
    "OFF": (False, ()),
    "ON_FULL": (True, ("coalesce", "skew", "local_shuffle", "dpp")),
    "ON_COALESCE_ONLY": (True, ("coalesce",)),
    "ON_SKEW_ONLY": (True, ("skew",)),
    "ON_DPP_ONLY": (False, ("dpp",)),
    "ON_LOCAL_SHUFFLE_ONLY": (True, ("local_shuffle",)),
}
YES = {"ON", "1", "TRUE", "YES", "ENABLE", "ENABLED"}


def scenario_name(name: str | None = None) -> str:
    """ON or OFF: the argument, else the environment, else OFF; anything unknown is OFF."""
    raw = name or os.environ.get("SPARK_AQE_SCENARIO") or "OFF"
    return "ON" if raw.strip().upper() in YES else "OFF"


def component_conf(profile: str) -> dict[str, str]:
    """All switches of a component profile; ON and OFF (and their synonyms) name the two ends."""
    wanted = profile.strip().upper()
    if wanted not in PROFILES:
        wanted = "ON_FULL" if scenario_name(wanted) == "ON" else "OFF"
    adaptive, parts = PROFILES[wanted]
    conf = {ADAPTIVE + "enabled": str(adaptive).lower()}
    for part, keys in COMPONENTS.items():
        conf.update({k: str(part in parts).lower() for k in keys})
        if adaptive and part in parts:
            conf.update(SIZES.get(part, {}))
    return conf


def aqe_conf(name: str | None = None) -> dict[str, str]:
    """Scenario OFF or ON. Partition pruning is not part of it and keeps its setting."""
    conf = component_conf("ON_FULL" if scenario_name(name) == "ON" else "OFF")
    return {k: v for k, v in conf.items() if k != PRUNING}


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[SparkSession]:
    """Apply runtime settings for a block and put the old ones back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def applied(spark: SparkSession, keys: tuple[str, ...]) -> dict[str, str | None]:
    return {k: spark.conf.get(k, None) for k in keys}


@dataclass(frozen=True)
class Workload:
    id: str
    name: str
    kind: str
    df: DataFrame


RUN_SCHEMA = (
    "scenario string, workload_id string, name string, workload_type string, "
    "duration_sec double, row_count bigint, status string, error string"
)


def time_workload(workload: Workload, warm_up: bool = False) -> tuple[float | None, int | None, str, str | None]:
    """Run a workload to the ``noop`` sink: seconds, rows, status, error.

    The sink takes every column, which a timed count would prune away; the rows are
    counted outside the measured time.
    """
    try:
        if warm_up:
            workload.df.write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        workload.df.write.format("noop").mode("overwrite").save()
        seconds = round(time.perf_counter() - started, 3)
        return seconds, workload.df.count(), "ok", None
    except (PySparkException, Py4JError) as exc:
        return None, None, "error", str(exc).splitlines()[0]


def run_workloads(spark: SparkSession, workloads: list[Workload], scenario: str, warm_up: bool = False) -> DataFrame:
    """Time workloads under a scenario or component profile; one row each."""
    with settings(spark, component_conf(scenario)):
        rows = [(scenario, w.id, w.name, w.kind, *time_workload(w, warm_up)) for w in workloads]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def speedup(base: Column | str, other: Column | str) -> Column:
    """Saved share of the base duration in %; NULL unless both are known and the base is positive."""
    base, other = (F.col(c) if isinstance(c, str) else c for c in (base, other))
    return F.when((base > 0) & other.isNotNull(), half_up((base - other) / base * 100, 2))


def throughput(rows: Column | str, seconds: Column | str) -> Column:
    rows, seconds = (F.col(c) if isinstance(c, str) else c for c in (rows, seconds))
    return F.when(seconds > 0, half_up(rows / seconds, 2))


def compare(off: DataFrame, on: DataFrame) -> DataFrame:
    """Runs of two scenarios side by side by workload; a workload run in one only is kept."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            "workload_id",
            *[F.col(c).alias(f"{c}_{tag}") for c in ("name", "workload_type", "duration_sec", "row_count")],
        )

    both = side(off, "off").join(side(on, "on"), "workload_id", "full")
    known = (F.col("duration_sec_off") != 0) & (F.col("duration_sec_on") != 0)
    return both.select(
        "workload_id",
        F.coalesce("name_off", "name_on").alias("name"),
        F.coalesce("workload_type_off", "workload_type_on").alias("workload_type"),
        F.col("duration_sec_off").alias("duration_off_sec"),
        F.col("duration_sec_on").alias("duration_on_sec"),
        F.when(known, speedup("duration_sec_off", "duration_sec_on")).alias("speedup_pct"),
        throughput("row_count_off", "duration_sec_off").alias("throughput_off"),
        throughput("row_count_on", "duration_sec_on").alias("throughput_on"),
    ).orderBy("workload_id")
