"""Joins to reference tables and the diagnosis of keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierworks.session import cut_lineage


def lookup(df: DataFrame, ref: DataFrame, key: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a reference table by key.

    A reference below the threshold is broadcast by Spark; beyond it the join shuffles
    and run-time re-planning splits the partitions of hot keys.
    """
    return df.join(ref, [key] if isinstance(key, str) else list(key), how)


MOST_GROUP_ROWS = 100_000


def join_group_stats(df: DataFrame, stats: DataFrame, on: Sequence[str], most_rows: int = MOST_GROUP_ROWS) -> DataFrame:
    """Join per-group statistics of a large table back to its rows.

    The planner cannot know how few groups there are and would shuffle every row by
    the group, a handful of keys at worst. So the statistics are computed first and
    kept in the shared folder, and broadcast if they have no more than ``most_rows``
    rows; otherwise the rows are spread over many groups and a plain join is even.
    """
    known = cut_lineage(stats)
    small = known.limit(most_rows + 1).count() <= most_rows
    return df.join(F.broadcast(known) if small else known, list(on), "left")


def sum_by_attribute(
    df: DataFrame,
    ref: DataFrame,
    key: str,
    dims: Sequence[str],
    attributes: Sequence[str],
    measures: Mapping[str, Column],
    how: str = "inner",
) -> DataFrame:
    """Sum measures of ``df`` by attributes that live in ``ref``.

    Rows are summed per key before anything is joined, so a key with a third of the rows
    crosses the network as one partial row per task.
    """
    wanted = ref.select(key, *attributes)
    sums = [F.sum(F.col(m)).alias(m) for m in measures]
    rows = df.select(key, *dims, *[c.alias(m) for m, c in measures.items()]).groupBy(key, *dims).agg(*sums)
    return rows.join(wanted, key, how).groupBy(*attributes, *dims).agg(*sums)


def matched_pairs(left: DataFrame, right: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    """Per key, how many row pairs an inner join would produce (a decimal), without producing them."""
    a = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__l"))
    b = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__r"))
    return a.join(b, key).select(key, (F.col("__l").cast("decimal(19,0)") * F.col("__r").cast("decimal(19,0)")).cast("decimal(38,0)").alias(name))


TASK_CELLS = 64


def skewed_join(left: DataFrame, right: DataFrame, key: str, cell_rows: int = 1_000_000) -> DataFrame:
    """All rows of an inner join on one key, dealt so that no cell makes more than about ``cell_rows`` of a key's rows.

    The keys are counted first. The pairs of a key form a grid: its left rows are cut into parts, its right rows too, and
    every left part meets every right part in a cell of its own, so a left row is sent once for each right part and the other
    way round. Most keys are one cell. Parts are chosen by a hash of the whole row and its number among equal ones. There are as
    many tasks as the pairs ask for, at most about ``TASK_CELLS`` cells each: what a task makes is up to a thousand times what
    it reads, so it is not for the planner to merge tasks by what they read, or to broadcast a side by its size before the
    copies. The columns of both sides but the key must differ and be comparable.
    """
    side = max(1, int(cell_rows**0.5))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))

    def parts(n: str) -> Column:
        return F.expr(f"CAST(({n} + {side - 1}) DIV {side} AS INT)")

    keys = counted(left, "__nl").join(counted(right, "__nr"), key).withColumn("__pairs", F.col("__nl") * 1.0 * F.col("__nr"))
    known = cut_lineage(keys.where(F.col("__pairs") > side))
    hot = known.where(F.col("__pairs") > cell_rows).select(key, parts("__nl").alias("__lp"), parts("__nr").alias("__rp"))
    few = hot.limit(MOST_GROUP_ROWS + 1).count() <= MOST_GROUP_ROWS
    n_cells = int((known.agg(F.sum("__pairs")).first()[0] or 0) // cell_rows) + 1
    n_tasks = min(n_cells, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_cells // TASK_CELLS))

    def dealt(df: DataFrame, own: str, other: str, at: str, there: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
        # equal rows in two steps, so that no list is long
        rows = rows.select(*df.columns, "__n", F.explode(F.expr(f"sequence(0L, (__n - 1) DIV {side})")).alias("__chunk"))
        rows = rows.select(*df.columns, "__chunk", F.explode(F.expr(f"sequence(1L, least(__n - __chunk * {side}, {side}))")).alias("__copy"))
        met = rows.join(F.broadcast(hot) if few else hot, key, "left")
        part = F.coalesce(F.pmod(F.xxhash64(*df.columns, "__chunk", "__copy"), F.col(own)).cast("int"), F.lit(0))
        met = met.select(*df.columns, part.alias(at), F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias(there))
        return met.repartition(n_tasks, key, "__l", "__r") if n_cells > 1 else met

    lefts, rights = dealt(left, "__lp", "__rp", "__l", "__r"), dealt(right, "__rp", "__lp", "__r", "__l")
    columns = [*left.columns, *[c for c in right.columns if c != key]]
    return lefts.hint("merge").join(rights, [key, "__l", "__r"]).select(*columns)


def orphan_keys(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Distinct fact keys the dimension lacks. Distinct comes first: the join then meets each key once."""
    keys = fact.select(F.col(key)).distinct()
    return keys.join(dim.select(F.col(dim_key or key).alias(key)), key, "left_anti")


def one_per_level(dim: DataFrame, level: Sequence[str]) -> DataFrame:
    """A dimension cut to a coarser level, one row per member, so a join to it cannot fan out."""
    return dim.select(*level).distinct()
