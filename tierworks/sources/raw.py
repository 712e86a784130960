"""Raw inputs: text tables, the driver's Parquet tables, literal tables, and their inventory."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

PARQUET_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def text_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame | None:
    """CSV with a header line, every column text. None (and a warning) if it cannot be read or has no rows.

    With ``columns`` no pass over the file is needed to learn the header, and columns
    are matched by position against the header's names.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    try:
        if columns is None:
            df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        else:
            df = reader.schema(text_schema(columns)).csv(path)
        if df.isEmpty():
            log.warning("no rows in %s, skipped", path)
            return None
        return df
    except AnalysisException as exc:
        log.warning("cannot read %s, skipped: %s", path, str(exc).splitlines()[0])
        return None


def read_tables(spark: SparkSession, directory: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{directory.rstrip('/')}/{n}.parquet") for n in names or PARQUET_TABLES}


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A small fixed table with declared types. Its size is that of the program text."""
    return spark.createDataFrame(list(rows), schema)


def staging_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and bytes on disk of each staged table.

    The size comes from the scan's own file metadata, so one pass per table gives both
    numbers, and a Parquet scan reads no data column for it.
    """
    return reduce(DataFrame.unionByName, [_table_size(name, df) for name, df in tables.items()])


def _table_size(name: str, df: DataFrame) -> DataFrame:
    files = df.select("_metadata.file_path", "_metadata.file_size")
    per_file = files.groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("size_bytes"),
    ).select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        "size_bytes",
        F.round(F.col("size_bytes") / (1024 * 1024), 2).alias("size_mb"),
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("table_count"),
        F.sum("row_count").cast("bigint").alias("total_rows"),
        F.round(F.sum("size_bytes") / (1024 * 1024), 2).alias("total_size_mb"),
    )
