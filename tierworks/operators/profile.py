"""Column and table profiles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierworks.functions import blank, mean_of, percent

def as_text(field: T.StructField) -> Column:
    """Equal values give equal text; text and nested values are replaced by digests to keep the shuffle narrow."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0)).cast("string")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(value.isNotNull(), F.sha2(F.to_json(F.struct(value)), 256))
    text = value.cast("string")
    if not isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return text
    # a blank value keeps its own text, as it counts as missing
    return F.when(F.length(F.trim(text)) > 0, F.sha2(text, 256)).otherwise(text)


def columns(df: DataFrame, name: str, blank_is_value: bool = False, approx: bool = False) -> DataFrame:
    """One row per column: type, rows, missing count and %, completeness %, distinct values.

    NULL and blank text are missing. NULL is no value, so it is not among the distinct
    ones; with ``blank_is_value`` it counts as the empty text. One scan turns each row
    into (column, value) pairs that are counted per pair before the shuffle, so neither
    a wide table nor a column full of one value needs more than that. ``approx`` swaps
    the exact distinct count for a sketch and so shuffles nothing but the sketches.
    """
    spark = df.sparkSession
    fields = df.schema.fields
    pairs = F.array(
        *[F.struct(F.lit(i).alias("pos"), as_text(f).alias("value")) for i, f in enumerate(fields)]
    )
    long = df.select(F.explode(pairs).alias("p")).select("p.pos", "p.value")
    if blank_is_value:
        long = long.withColumn("value", F.coalesce("value", F.lit("")))
    missing = F.length(F.trim(F.col("value"))) == 0
    missing = F.col("value").isNull() | missing

    # One empty pair per column keeps the columns of a table without rows.
    template = spark.range(len(fields)).select(
        F.col("id").cast("int").alias("pos"), F.lit(None).cast("string").alias("value"),
        F.lit(0).cast("bigint").alias("n"),
    )
    if approx:
        counted = long.withColumn("n", F.lit(1).cast("bigint")).unionByName(template)
        distinct = F.approx_count_distinct("value")
    else:
        counted = long.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n")).unionByName(template)
        distinct = F.count("value")
    stats = counted.groupBy("pos").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("null_count"),
        distinct.alias("distinct_count"),
    )
    pos = F.col("pos") + 1
    return stats.select(
        F.lit(name).alias("table_name"),
        F.element_at(F.array(*[F.lit(f.name) for f in fields]), pos).alias("column_name"),
        pos.alias("position"),
        F.element_at(F.array(*[F.lit(f.dataType.simpleString()) for f in fields]), pos).alias("data_type"),
        "row_count",
        "null_count",
        percent("null_count", "row_count").alias("null_pct"),
        percent(F.col("row_count") - F.col("null_count"), "row_count").alias("completeness_pct"),
        "distinct_count",
    )


def completeness(df: DataFrame, name: str) -> DataFrame:
    """The part of :func:`columns` that needs no distinct count: one scan and no shuffle of values."""
    fields = df.schema.fields
    stats = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column_name"),
                    F.coalesce(F.sum(blank(f"`{f.name}`").cast("bigint")), F.lit(0).cast("bigint")).alias("null_count"),
                )
                for f in fields
            ]
        ).alias("cols"),
    )
    return stats.select("row_count", F.explode("cols").alias("c")).select(
        F.lit(name).alias("table_name"),
        "c.column_name",
        "row_count",
        "c.null_count",
        percent(F.col("row_count") - F.col("c.null_count"), "row_count").alias("completeness_pct"),
    )


def mean_completeness(profile: DataFrame) -> DataFrame:
    """Per table: rows, columns, mean of the columns' completeness (2 digits)."""
    return profile.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        mean_of("completeness_pct", 2).alias("completeness"),
    )


def table(profile: DataFrame, pii: Mapping[str, Iterable[str]] | None = None, profiled_at: str | None = None) -> DataFrame:
    """One row per table from its column profiles: counts, schema map, columns with personal data, time."""
    marked = [F.concat(F.lit(t + "."), F.lit(c)) for t, cols in (pii or {}).items() for c in cols]
    is_pii = F.concat_ws(".", "table_name", "column_name").isin(*marked) if marked else F.lit(False)
    # A table has as many list entries here as it has columns, so the lists are bounded by the schema.
    listed = F.array_sort(F.collect_list(F.struct("position", "column_name", "data_type", is_pii.alias("pii"))))
    return (
        profile.groupBy("table_name")
        .agg(
            F.max("row_count").alias("row_count"),
            F.count(F.lit(1)).alias("column_count"),
            mean_of("completeness_pct", 2).alias("completeness"),
            listed.alias("cols"),
        )
        .select(
            "table_name",
            "row_count",
            "column_count",
            "completeness",
            F.map_from_arrays("cols.column_name", "cols.data_type").alias("schema"),
            F.transform(F.filter("cols", lambda c: c["pii"]), lambda c: c["column_name"]).alias("pii_columns"),
            F.lit(profiled_at).cast("string").alias("profiled_at"),
        )
    )


def gold(df: DataFrame, name: str, kind: str, sources: list[str], sample: DataFrame | None = None) -> DataFrame:
    """Profile of a star-schema table; a KPI fact also carries its one-row sample KPI."""
    out = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"),
        F.lit(kind).alias("table_type"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())]).alias("schema"),
        F.array(*[F.lit(s) for s in sources]).alias("sources"),
    )
    if sample is None:
        return out.withColumn("sample_kpi", F.lit(None).cast("string"))
    return out.withColumn("sample_kpi", sample.select(F.to_json(F.struct("*"))).scalar())


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


__all__ = ["columns", "completeness", "mean_completeness", "table", "gold", "union_all"]
