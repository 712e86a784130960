"""The same rows written and read back in several file formats."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json")


def format_comparison(df: DataFrame, base: str, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Per format: rows written, rows read, bytes, and the seconds both took.

    The read goes to the ``noop`` sink: a bare count would read no column at all.
    """
    spark = df.sparkSession
    parts = []
    for fmt in formats:
        path = f"{base.rstrip('/')}/{fmt}"
        started = time.perf_counter()
        df.write.mode("overwrite").format(fmt).save(path)
        written = time.perf_counter()
        back = spark.read.schema(df.schema).format(fmt).load(path)
        back.write.format("noop").mode("overwrite").save()
        read = time.perf_counter()
        per_file = back.groupBy(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
        ).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_file.agg(
                F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("read_row_count"),
                F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("size_bytes"),
            ).select(
                F.lit(fmt).alias("format"),
                "read_row_count",
                "size_bytes",
                F.round(F.col("size_bytes") / (1024 * 1024), 3).alias("size_mb"),
                F.lit(round(written - started, 3)).alias("write_sec"),
                F.lit(round(read - written, 3)).alias("read_sec"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
