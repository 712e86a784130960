"""OLAP over the star schema: slice, dice, roll-up, drill-down, pivot, diagnosis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierworks.functions import mean_of, percent
from tierworks.operators.joins import lookup, orphan_keys

# How a measure may be rolled up.
ADDITIVE, SEMI_ADDITIVE, NON_ADDITIVE = "additive", "semi-additive", "non-additive"

def dice(df: DataFrame, **equal) -> DataFrame:
    """Rows where every named column has the value given (one column: a slice)."""
    return df.filter(reduce(and_, [F.col(c) == F.lit(v) for c, v in equal.items()]))


def star(fact: DataFrame, dims: Mapping[str, DataFrame], how: str = "inner") -> DataFrame:
    """Fact joined to each dimension by its natural key."""
    return reduce(lambda out, item: lookup(out, item[1], item[0], how), dims.items(), fact)


def rollup(df: DataFrame, level: Sequence[str], measures: Mapping[str, str], digits: int = 4) -> DataFrame:
    """Aggregate measures to a coarser level, each as its class allows.

    Additive measures are summed, semi-additive ones averaged, the rest are taken as
    their greatest value.
    """
    aggs = []
    for name, kind in measures.items():
        if kind == ADDITIVE:
            aggs.append(F.sum(name).alias(name))
        elif kind == SEMI_ADDITIVE:
            aggs.append(mean_of(name, digits).alias(f"avg_{name}"))
        elif kind == NON_ADDITIVE:
            aggs.append(F.max(name).alias(f"max_{name}"))
        else:
            raise ValueError(f"unknown measure class {kind!r}")
    return df.groupBy(*level).agg(*aggs)


def rollup_share(df: DataFrame, level: Sequence[str], part: str, whole: str, value: str) -> DataFrame:
    """A percentage recomputed from its counts at the coarser level, with subtotals along the level list.

    Rows with NULL in the finer columns are the subtotals (``depth`` says how many
    columns were rolled away).
    """
    out = df.rollup(*level).agg(
        F.sum(part).alias(part),
        F.sum(whole).alias(whole),
        F.bit_count(F.grouping_id()).alias("depth"),
    )
    return out.withColumn(value, percent(part, whole))


def pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, measure: str, digits: int = 4) -> DataFrame:
    """Two-dimensional matrix of means. Naming the column values spares a pass to find them."""
    cells = [mean_of(F.when(F.col(column) == F.lit(v), F.col(measure)), digits).alias(str(v)) for v in values]
    return df.groupBy(*rows).agg(*cells)


def against_overall(df: DataFrame, by: Sequence[str], measure: str, digits: int = 4) -> DataFrame:
    """Mean per member beside the mean of all rows (a scalar subquery, not a cross join)."""
    overall = df.agg(mean_of(measure, digits)).scalar()
    return df.groupBy(*by).agg(mean_of(measure, digits).alias(f"avg_{measure}")).withColumn("avg_all", overall)


def key_range(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    parts = [
        df.agg(F.min(key).cast("bigint").alias("min_key"), F.max(key).cast("bigint").alias("max_key")).select(
            F.lit(name).alias("table_name"), "min_key", "max_key"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def census(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table as one labelled list. Each count is answered from the file footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("jumlah")).select(F.lit(n).alias("entitas"), "jumlah") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def check_star(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows of both sides, rows the join yields, key ranges and keys without a match, as (check, value).

    The join count is the sum over keys of the product of both sides' rows per key:
    no joined row is built.
    """
    def per_key(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias(name))

    both = per_key(fact, "nf").join(per_key(dim, "nd"), "k", "full")
    in_fact, in_dim = F.col("nf").isNotNull(), F.col("nd").isNotNull()
    facts = both.agg(
        F.coalesce(F.sum("nf"), F.lit(0)).alias("n_fact"),
        F.coalesce(F.sum("nd"), F.lit(0)).alias("n_dim"),
        F.coalesce(F.sum(F.col("nf").cast("decimal(19,0)") * F.col("nd").cast("decimal(19,0)")), F.lit(0)).alias("n_join"),
        F.min(F.when(in_fact, F.col("k"))).alias("min_fact_key"),
        F.max(F.when(in_fact, F.col("k"))).alias("max_fact_key"),
        F.min(F.when(in_dim, F.col("k"))).alias("min_dim_key"),
        F.max(F.when(in_dim, F.col("k"))).alias("max_dim_key"),
        F.count_if(in_fact & ~in_dim & F.col("k").isNotNull()).alias("n_orphan_keys"),
    )
    checks = F.array(
        *[F.struct(F.lit(c).alias("check"), F.col(c).cast("decimal(38,0)").alias("value")) for c in facts.columns]
    )
    return facts.select(F.explode(checks).alias("r")).select("r.check", "r.value")


def parity(a: DataFrame, b: DataFrame, labels: tuple[str, str] = ("OFF", "ON")) -> DataFrame:
    """Rows per scenario, and rows one side has more often than the other (0 on both sides = equal)."""
    columns = a.columns
    tagged = a.select(*columns, F.lit(1).alias("__na"), F.lit(0).alias("__nb")).unionByName(
        b.select(*columns, F.lit(0).alias("__na"), F.lit(1).alias("__nb"))
    )
    per_row = tagged.groupBy(*columns).agg(F.sum("__na").alias("na"), F.sum("__nb").alias("nb"))
    sums = per_row.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("na"),
        F.coalesce(F.sum("nb"), F.lit(0)).alias("nb"),
        F.coalesce(F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))), F.lit(0)).alias("only_a"),
        F.coalesce(F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))), F.lit(0)).alias("only_b"),
    )
    lines = F.array(
        F.struct(F.lit(labels[0]).alias("ctx"), F.col("na").alias("n"), F.col("only_a").alias("only_here")),
        F.struct(F.lit(labels[1]).alias("ctx"), F.col("nb").alias("n"), F.col("only_b").alias("only_here")),
    )
    return sums.select(F.explode(lines).alias("r")).select("r.*")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that two tables share if they hold the same rows equally often, in any order: no row is shuffled.

    Columns are taken by name. It has the number of rows, and for two 64-bit hashes of a row the exclusive or and the
    exact sum; a NULL differs from every value and from a NULL in another column. Equal fingerprints
    of different tables are as likely as a collision of 128 bits; :func:`parity` finds the rows that differ.
    """
    values = [F.to_json(F.struct(c)) if "map<" in t or t == "variant" else F.col(c) for c, t in sorted(df.select(*sorted(df.columns)).dtypes)]
    marked = [v for c in values for v in (c, c.isNull())]
    rows = df.select(*[F.xxhash64(F.lit(salt), *marked).alias(f"h{i}") for i, salt in enumerate(("one", "two"))])
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.bit_xor(h), F.lit(0)).alias(f"{h}_xor") for h in ("h0", "h1")],
        *[F.coalesce(F.sum(F.col(h).cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"{h}_sum") for h in ("h0", "h1")],
    )


def same_rows(a: DataFrame, b: DataFrame, labels: tuple[str, str] = ("OFF", "ON")) -> DataFrame:
    """Number of rows of each of two tables and whether they hold the same ones, from their fingerprints."""
    prints = [fingerprint(df).select(F.lit(side).alias("side"), F.struct("*").alias("p")) for side, df in (("a", a), ("b", b))]
    both = prints[0].unionByName(prints[1]).agg(*[F.max(F.when(F.col("side") == side, F.col("p"))).alias(side) for side in "ab"])
    lines = [F.struct(F.lit(label).alias("ctx"), F.col(f"{side}.n").alias("n"), (F.col("a") == F.col("b")).alias("same")) for label, side in zip(labels, "ab", strict=True)]
    return both.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def filtered(df: DataFrame, test: Column, *order: Column | str) -> DataFrame:
    out = df.filter(test)
    return out.orderBy(*order) if order else out


__all__ = [
    "ADDITIVE", "NON_ADDITIVE", "SEMI_ADDITIVE", "against_overall", "census", "check_star", "dice",
    "filtered", "fingerprint", "key_range", "orphan_keys", "parity", "pivot", "rollup", "rollup_share", "same_rows", "star",
]
