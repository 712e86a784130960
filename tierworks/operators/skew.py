"""Key-skew statistics and repeatable skew injection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierworks.functions import half_up
from tierworks.operators.profile import union_all


def key_skew(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows, keys, least, most, mean rows per key, most/mean, 95th-index value, share of the top key.

    The keys' counts are reduced to a histogram (count -> keys with it) before anything
    is ordered. N rows give at most sqrt(2N) different counts, so the one ordered pass
    is small however many keys there are.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    histogram = per_key.groupBy("c").agg(F.count(F.lit(1)).alias("keys"))
    upto = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = histogram.withColumn("seen", F.sum("keys").over(upto)).withColumn("n", F.sum("keys").over(whole))
    # Index floor(0.95 n), at most n - 1, of the ascending counts (0-based).
    index = F.least(F.col("n") - 1, F.call_function("div", F.col("n") * 95, F.lit(100).cast("bigint")))
    stats = ranked.agg(
        F.sum(F.col("c") * F.col("keys")).alias("total"),
        F.max("n").alias("key_count"),
        F.min("c").alias("low"),
        F.max("c").alias("high"),
        F.min(F.when(F.col("seen") > index, F.col("c"))).alias("p95"),
    )
    mean = F.col("total") / F.col("key_count")
    return stats.select(
        F.lit(name).alias("table_name"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("row_count_total"),
        F.coalesce("key_count", F.lit(0)).cast("bigint").alias("key_count"),
        F.col("low").alias("min_rows_per_key"),
        F.col("high").alias("max_rows_per_key"),
        half_up(mean, 2).alias("mean_rows_per_key"),
        half_up(F.col("high") / mean, 3).alias("skew_ratio_max_over_mean"),
        F.col("p95").alias("p95_rows_per_key"),
        half_up(F.col("high") * 100.0 / F.col("total"), 2).alias("top_key_share_pct"),
    )


def key_skew_of(tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    return union_all([key_skew(df, key, name) for name, df, key in tables])


def top_keys(df: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The most frequent keys, ties in key order."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key).limit(limit)


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows per partition as the table is laid out now, beside the shuffle setting."""
    setting = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.groupBy(F.spark_partition_id().alias("partition_id"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("shuffle_partitions", F.lit(setting))
    )


def inject_skew(
    df: DataFrame, key: str, hot, share: float, identity: Sequence[str], uniform: Column | None = None, seed: int = 42
) -> DataFrame:
    """Send about ``share`` of the rows to the key ``hot``, chosen by a hash of the row's identity.

    Other rows keep their key, or take ``uniform``. The choice does not depend on the
    layout, so it is the same on every run.
    """
    draw = F.pmod(F.xxhash64(*identity, F.lit(seed)), F.lit(1_000_000))
    rest = F.col(key) if uniform is None else uniform
    hot_key = F.lit(hot).cast(df.schema[key].dataType)
    return df.withColumn(key, F.when(draw < int(share * 1_000_000), hot_key).otherwise(rest))
