"""Star-schema dimensions and keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.functions import code_lookup, grain_id, period_id
from tierworks.operators.shape import keep_one

# Month names and term names of the calendar.
MONTHS = (
    "Januari", "Februari", "Maret", "April", "Mei", "Juni",
    "Juli", "Agustus", "September", "Oktober", "November", "Desember",
)
ODD_TERM, EVEN_TERM = "Ganjil", "Genap"


def _calendar_columns(months: DataFrame, id_name: str = "waktu_id") -> DataFrame:
    """From ``m`` = months since year 0."""
    year = F.floor(F.col("m") / 12).cast("int")
    month = (F.pmod(F.col("m"), F.lit(12)) + 1).cast("int")
    return months.select(year.alias("tahun"), month.alias("bulan")).select(
        (F.col("tahun") * 100 + F.col("bulan")).alias(id_name),
        "tahun",
        F.when((F.col("bulan") >= 8) | (F.col("bulan") == 1), ODD_TERM).otherwise(EVEN_TERM).alias("semester"),
        F.ceil(F.col("bulan") / 3).cast("int").alias("triwulan"),
        "bulan",
        F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.col("bulan")).alias("nama_bulan"),
    )


def dim_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Every month of the years given."""
    return _calendar_columns(spark.range(first_year * 12, (last_year + 1) * 12).withColumnRenamed("id", "m"))


def dim_calendar_of(df: DataFrame, *dates: str) -> DataFrame:
    """Every month of the years the date columns span."""
    years = df.agg(
        F.least(*[F.min(F.year(d)) for d in dates], F.lit(None).cast("int")).alias("first"),
        F.greatest(*[F.max(F.year(d)) for d in dates], F.lit(None).cast("int")).alias("last"),
    )
    months = years.filter("first <= last").select(F.explode(F.sequence(F.col("first") * 12, F.col("last") * 12 + 11)).alias("m"))
    return _calendar_columns(months)


def dim_from(
    df: DataFrame,
    key: str,
    columns: Mapping[str, Column | str],
    code: str | None = None,
    names: Mapping[str, str] | None = None,
    name_column: str | None = None,
) -> DataFrame:
    """A dimension: renamed or derived columns, one row per key.

    ``name_column`` is filled from the literal table by ``code`` where it is NULL.
    """
    out = df
    if code and names and name_column:
        own = F.col(name_column) if name_column in df.columns else F.lit(None).cast("string")
        out = out.withColumn(name_column, F.coalesce(own, code_lookup(code, names)))
    picked = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return keep_one(out.select(*picked), [key])


def dim_project(df: DataFrame, key: str, columns: Sequence[str], renamed: Mapping[str, str] | None = None) -> DataFrame:
    renamed = renamed or {}
    return dim_from(df, key, {renamed.get(c, c): c for c in columns})


def with_keys(df: DataFrame, grain: Sequence[str], year: str | None = None) -> DataFrame:
    """Surrogate ``fact_id`` from the grain, and the year-end ``waktu_id`` if a year is given."""
    if year is not None:
        df = df.withColumn("waktu_id", period_id(year))
    rest = [c for c in df.columns if c not in ("fact_id", "waktu_id")]
    period = ["waktu_id"] if "waktu_id" in df.columns else []
    return df.select(grain_id(*grain).alias("fact_id"), *period, *rest)
