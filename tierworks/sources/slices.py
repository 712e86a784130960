"""Layer tables kept in slices by a hash of their key; a batch rewrites the slices it touches and no others.

A slice is a partition folder, and within a slice rows lie in buckets of their key. A merge reads the touched
slices only, meets the batch in the buckets the old rows already lie in (so just the batch is shuffled),
and replaces those folders; every other file stays as it is. Keys compare as text with a place
for NULL, so a NULL key is a key of its own.

Every row carries the number of the batch that last rewrote its slice. A merge that broke off half-way is
simply run again with the same number: slices that already hold the batch are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.operators.scenario import settings
from tierworks.sources.layers import layer_name, read_layer, write_layer

KEY, SLICE, BATCH = "slice_key", "slice_no", "slice_batch"
Combine = Callable[[DataFrame], DataFrame]


def key_text(keys: Sequence[str]) -> Column:
    """The key columns as one text that is never NULL and differs for different keys."""
    parts = [F.when(F.col(k).isNull(), "-").otherwise(F.concat(F.length(F.col(k).cast("string")), F.lit(":"), F.col(k).cast("string"))) for k in keys]
    return F.concat_ws(",", *parts)


@dataclass(frozen=True)
class SlicedTable:
    """One table: where it lies, its key, and how many slices and buckets it is cut into."""

    spark: SparkSession
    layer: str
    name: str
    keys: tuple[str, ...]
    location: str
    slices: int = 16
    buckets: int = 4

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(KEY, key_text(self.keys)).withColumn(SLICE, self._slice())

    def _slice(self) -> Column:
        return F.pmod(F.xxhash64(KEY), F.lit(self.slices)).cast("int")

    def create(self, df: DataFrame) -> None:
        """Write the first version, one row per key. One task writes the files of a bucket."""
        rows = self._placed(df).withColumn(BATCH, F.lit(0).cast("bigint")).repartition(self.buckets, KEY)
        columns = [*df.columns, KEY, BATCH, SLICE]
        write_layer(rows.select(columns), self.layer, self.name, partition_by=[SLICE], bucket_by=(self.buckets, [KEY]), location=self.location)

    def stored(self, only: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some slices, with the technical columns."""
        rows = read_layer(self.spark, self.layer, self.name)
        return rows if only is None else rows.where(F.col(SLICE).isin(list(only)))

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        return self.stored(only).drop(KEY, BATCH, SLICE)

    def touched(self, batch: DataFrame) -> list[int]:
        """Numbers of the slices that hold keys of the batch."""
        return sorted(r[0] for r in self._placed(batch.select(*self.keys)).select(SLICE).distinct().collect())

    def matched(self, batch: DataFrame, only: Sequence[int], how: str = "full") -> DataFrame:
        """Rows of the slices beside the batch's rows of the same key: key columns, structs ``old`` and ``new`` (NULL where there is none).

        ``how`` is ``full`` or ``right`` (keys of the batch alone).
        """
        values = [c for c in batch.columns if c not in self.keys]
        old = self.stored(only).select(KEY, F.struct(*self.keys).alias("old_key"), F.struct(*values).alias("old"))
        new = batch.select(key_text(self.keys).alias(KEY), F.struct(*self.keys).alias("new_key"), F.struct(*values).alias("new"))
        both = old.join(new, KEY, how)
        keys = [F.when(F.col("new_key").isNotNull(), F.col(f"new_key.{k}")).otherwise(F.col(f"old_key.{k}")).alias(k) for k in self.keys]
        return both.select(*keys, "old", "new")

    def merge(self, batch: DataFrame, combine: Combine, number: int) -> list[int]:
        """Bring a batch (one row per key, the table's columns) in; returns the slices rewritten.

        ``combine`` turns the matched rows into rows of the table. Numbers of batches grow.
        """
        batch = batch.select(*self.read([]).columns)
        touched = self.touched(batch)
        done = {r[0] for r in self.stored(touched).groupBy(SLICE).agg(F.max(BATCH).alias("b")).where(F.col("b") >= number).select(SLICE).collect()}
        left = [s for s in touched if s not in done]
        if not left:
            return []
        columns = [*batch.columns, KEY, BATCH, SLICE]
        mine = self._placed(batch).where(F.col(SLICE).isin(left)).drop(KEY, SLICE)
        rows = self._placed(combine(self.matched(mine, left)).select(*batch.columns)).withColumn(BATCH, F.lit(number).cast("bigint"))
        with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            rows.select(columns).write.insertInto(f"{layer_name(self.layer)}.{self.name}", overwrite=True)
        self.spark.catalog.refreshTable(f"{layer_name(self.layer)}.{self.name}")
        return left

    def files(self) -> DataFrame:
        """Slice and file of every stored row group: what a merge must leave alone elsewhere."""
        return self.stored().select(SLICE, F.input_file_name().alias("file")).distinct()
