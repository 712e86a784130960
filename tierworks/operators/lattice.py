"""A stored lattice of additive measures: one table for each set of dimensions, and the smallest that answers a question.

The finest level is aggregated from the rows once; all others are made of it in one pass of GROUPING SETS. A roll-up, slice,
dice or pivot names the dimensions it groups by and those it fixes; it reads the level with the fewest rows that has them all,
and never the rows. Levels are stored apart, so a NULL in a level is a value and not a subtotal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Lattice:
    spark: SparkSession
    path: str
    levels: tuple[tuple[str, ...], ...]  # the finest first
    sizes: tuple[int, ...]
    measures: Mapping[str, str]  # how each folds: sum, min or max

    @classmethod
    def build(cls, rows: DataFrame, path: str, levels: Sequence[Sequence[str]], measures: Mapping[str, str]) -> Lattice:
        """``levels``: sets of dimensions, the first holding all the others."""
        finest, *coarser = (tuple(level) for level in levels)
        if any(set(level) - set(finest) for level in coarser):
            raise ValueError("the first level must have all dimensions")
        unknown = set(measures.values()) - set(FOLDS)
        if unknown:
            raise ValueError(f"measures fold by {sorted(FOLDS)}, not {sorted(unknown)}")
        spark = rows.sparkSession
        folds = lambda: [FOLDS[how](name).alias(name) for name, how in measures.items()]
        rows.groupBy(*finest).agg(*folds()).write.parquet(f"{path}/level=0")
        base = spark.read.parquet(f"{path}/level=0")
        sizes = [base.count()]
        if coarser:
            made = base.groupingSets([[F.col(d) for d in level] for level in coarser], *[F.col(d) for d in finest]).agg(
                *folds(), F.grouping_id().alias("__gid")
            )
            # bit i from the left of the grouping id is set if dimension i is rolled away
            number = {sum(1 << (len(finest) - 1 - i) for i, d in enumerate(finest) if d not in level): at for at, level in enumerate(coarser, 1)}
            if len(number) < len(coarser):
                raise ValueError("levels must differ")
            at = reduce(lambda found, item: found.when(F.col("__gid") == item[0], item[1]), number.items(), F.when(F.lit(False), 0))
            made.withColumn("level", at).drop("__gid").write.mode("append").partitionBy("level").parquet(path)
            counted = {r["level"]: r["n"] for r in spark.read.parquet(path).groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
            sizes += [counted.get(i, 0) for i in range(1, len(coarser) + 1)]
        return cls(spark, path, (finest, *coarser), tuple(sizes), dict(measures))

    def level_for(self, dimensions: Sequence[str]) -> int:
        """Number of the smallest level that has the dimensions."""
        able = [i for i, level in enumerate(self.levels) if not set(dimensions) - set(level)]
        if not able:
            raise ValueError(f"no level has {sorted(dimensions)}")
        return min(able, key=lambda i: (self.sizes[i], i))

    def read(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level={level}").select(*self.levels[level], *self.measures)

    def answer(self, by: Sequence[str], where: Mapping[str, object] | None = None) -> DataFrame:
        """Measures by some dimensions, others fixed to a value (None: NULL) or to one of a list of values."""
        where = where or {}
        rows = self.read(self.level_for([*by, *where]))
        for name, wanted in where.items():
            rows = rows.where(_is(F.col(name), wanted))
        return rows.groupBy(*by).agg(*[FOLDS[how](name).alias(name) for name, how in self.measures.items()])

    def rollup(self, by: Sequence[str]) -> DataFrame:
        """The measures along a list of dimensions with all subtotals; ``depth`` tells how many were rolled away."""
        parts = []
        for k in range(len(by), -1, -1):
            rows = self.answer(by[:k])
            gone = [F.lit(None).cast(self.read(0).schema[d].dataType).alias(d) for d in by[k:]]
            parts.append(rows.select(*by[:k], *gone, *self.measures, F.lit(len(by) - k).alias("depth")))
        return reduce(DataFrame.unionByName, parts)

    def pivot(self, rows: Sequence[str], column: str, values: Sequence, cell: Column) -> DataFrame:
        """A matrix: ``cell``, an expression of the measures, for every row and value of a dimension."""
        found = self.answer([*rows, column]).withColumn("__cell", cell)
        return found.groupBy(*rows).agg(*[F.max(F.when(F.col(column) == F.lit(v), F.col("__cell"))).alias(str(v)) for v in values])


def _is(column: Column, wanted: object) -> Column:
    if isinstance(wanted, (list, tuple, set)):
        return reduce(lambda a, b: a | b, [_is(column, w) for w in wanted], F.lit(False))
    return column.isNull() if wanted is None else column == F.lit(wanted)
