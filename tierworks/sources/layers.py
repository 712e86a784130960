"""Layer tables: create-or-replace, read with a clear error, append, per-scenario copies."""

from __future__ import annotations

import logging
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


class MissingLayerTable(RuntimeError):
    """An upstream layer has not been built yet."""


def layer_name(layer: str, scenario: str | None = None) -> str:
    """Database of a layer; an execution scenario gets a database of its own."""
    if scenario is None:
        return layer
    return f"{layer}_aqe_{'on' if scenario.strip().upper() == 'ON' else 'off'}"


def _full_name(layer: str, table: str, scenario: str | None) -> str:
    for part in (layer, table):
        if not re.fullmatch(r"\w+", part):
            raise ValueError(f"not a plain table name: {part!r}")
    return f"{layer_name(layer, scenario)}.{table}"


def write_layer(
    df: DataFrame,
    layer: str,
    table: str,
    scenario: str | None = None,
    partition_by: list[str] | None = None,
    location: str | None = None,
    bucket_by: tuple[int, list[str]] | None = None,
) -> str:
    """Replace a layer table and its schema. A catalog entry whose files are gone is dropped and built anew.

    ``bucket_by`` (count, keys) lays a table out for joins and sums by its keys, so
    that tables bucketed alike meet without a shuffle.
    """
    spark = df.sparkSession
    full = _full_name(layer, table, scenario)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer_name(layer, scenario)}")

    def save() -> None:
        writer = df.write.mode("overwrite").format("parquet").option("overwriteSchema", True)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if bucket_by:
            count, keys = bucket_by
            writer = writer.bucketBy(count, *keys).sortBy(*keys)
        if location:
            writer = writer.option("path", f"{location.rstrip('/')}/{layer_name(layer, scenario)}/{table}")
        writer.saveAsTable(full)

    try:
        save()
    except AnalysisException as exc:
        if not _stale_entry(exc):
            raise
        log.warning("replacing %s failed, dropping its catalog entry: %s", full, str(exc).splitlines()[0])
        spark.sql(f"DROP TABLE IF EXISTS {full}")
        save()
    return full


def _stale_entry(exc: AnalysisException) -> bool:
    """The catalog and the files disagree; anything else is the caller's error."""
    return (exc.getCondition() or "") in {"LOCATION_ALREADY_EXISTS", "PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"}


def read_layer(spark: SparkSession, layer: str, table: str, scenario: str | None = None) -> DataFrame:
    full = _full_name(layer, table, scenario)
    if not spark.catalog.tableExists(full):
        raise MissingLayerTable(f"table {full} does not exist: build layer '{layer}' first")
    return spark.table(full)


def append_batch(df: DataFrame, layer: str, table: str, scenario: str | None = None) -> str:
    """Add a batch to an existing layer table, columns matched by name."""
    full = _full_name(layer, table, scenario)
    target = read_layer(df.sparkSession, layer, table, scenario)
    df.select(*target.columns).write.insertInto(full)
    return full
