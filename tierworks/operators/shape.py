"""Row and column shaping used by every layer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _tie(field: T.StructField) -> Column:
    """A column to sort by; maps by their entries in key order, other values without an order by their JSON."""
    value = F.col(f"`{field.name}`")
    if _sortable(field.dataType):
        return value
    if isinstance(field.dataType, T.MapType):
        return F.to_json(F.struct(F.map_from_entries(F.array_sort(F.map_entries(value))))) if _sortable(field.dataType.valueType) else F.to_json(F.struct(value))
    return F.to_json(F.struct(value))


def keep_one(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str] = (), limit: int = 1) -> DataFrame:
    """The first ``limit`` rows per key under a total order.

    All other columns break ties, so the survivor never depends on the layout. Spark
    cuts each key to ``limit`` rows before the shuffle as well, so a key holding much
    of the table still sends a few rows per task.
    """
    ties = [_tie(f) for f in df.schema.fields if f.name not in keys]
    order = [*order_by, *ties] or [F.lit(1)]
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(spec)).filter(F.col("__rank") <= limit).drop("__rank")


def first_of_duplicate_columns(df: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Keep the first column of each name; with ``wanted``, those of the list that exist, in its order."""
    names = df.columns
    if any(n > 1 for n in Counter(names).values()):
        unique = [f"c{i}" for i in range(len(names))]
        first = {name: unique[i] for i, name in reversed(list(enumerate(names)))}
        df = df.toDF(*unique).select(*[F.col(first[n]).alias(n) for n in dict.fromkeys(names)])
    if wanted is None:
        return df
    return df.select(*[c for c in wanted if c in df.columns])


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def sample_rows(df: DataFrame, rows: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """About ``rows`` rows picked by a hash of the key, never more; the same rows on every layout."""
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000))
    share = F.lit(float(rows)) / F.greatest(df.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    picked = df.withColumn("__draw", draw).filter(F.col("__draw") < share * 1_000_000)
    return picked.orderBy("__draw", *key).limit(rows).drop("__draw")


def top_rows(df: DataFrame, order_by: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order_by)
    return (ordered.offset(offset) if offset else ordered).limit(limit)
