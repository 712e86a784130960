"""Cleaning and enrichment of raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierworks.functions import code_lookup
from tierworks.operators.joins import lookup
from tierworks.operators.shape import keep_one
from tierworks.operators.profile import union_all


@dataclass(frozen=True)
class Filled:
    """An output column: own value, else the reference's, else the literal table's name for a code."""

    name: str
    own: str | None = None
    ref: str | None = None
    code: str | None = None
    names: Mapping[str, str] | None = None
    keep_code: bool = False


def enrich_lookup(
    df: DataFrame,
    ref: DataFrame,
    key: str,
    pk: Sequence[str],
    filled: Sequence[Filled] = (),
    carry: Sequence[str] = (),
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Left lookup of ``ref`` by ``key``; rows without a match stay.

    ``carry`` lists reference columns to add as they are; ``filled`` columns take the
    first value known. Duplicate keys collapse before the join, so the reference is
    met by each row once.
    """
    needed = [*carry, *[f.ref for f in filled if f.ref]]
    taken = {c: f"__ref_{c}" for c in dict.fromkeys(needed)}
    side = ref.select(key, *[F.col(c).alias(a) for c, a in taken.items()])
    joined = lookup(keep_one(df, pk), keep_one(side, [key]), key)

    new: dict[str, Column] = {c: F.col(taken[c]) for c in carry}
    for f in filled:
        choices = []
        if f.own and f.own in df.columns:
            choices.append(F.col(f.own))
        if f.ref:
            choices.append(F.col(taken[f.ref]))
        if f.code and f.names:
            choices.append(code_lookup(f.code, f.names))
        if f.code and f.keep_code:
            choices.append(F.col(f.code))
        new[f.name] = F.coalesce(*choices)
    return joined.withColumns(new).withColumns(dict(flags or {})).drop(*taken.values())


def status_flags(df: DataFrame, column: str, flags: Mapping[str, str], any_flag: str, pk: Sequence[str]) -> DataFrame:
    """A boolean per status value and one that is true if any of them is."""
    tests = {name: F.col(column) == value for name, value in flags.items()}
    return keep_one(df, pk).withColumns({**tests, any_flag: reduce(or_, tests.values())})


def activity_flag(
    df: DataFrame, child: DataFrame, key: str, kind: str, name: str, pk: Sequence[str], least: int = 1
) -> DataFrame:
    """True for parents with at least ``least`` different kinds of child rows."""
    kinds = child.groupBy(key).agg(F.count_distinct(F.col(kind)).alias("__kinds"))
    joined = lookup(keep_one(df, pk), kinds, key)
    return joined.withColumn(name, F.coalesce("__kinds", F.lit(0)) >= least).drop("__kinds")


@dataclass(frozen=True)
class Part:
    """One input of a tagged union: its tag and how its columns map to the common shape."""

    df: DataFrame
    tag: str
    shape: Mapping[str, Column]


def union_tagged(parts: Sequence[Part], tag: str, pk: Sequence[str]) -> DataFrame:
    shaped = [
        p.df.select(*[c.alias(n) for n, c in p.shape.items()], F.lit(p.tag).alias(tag)) for p in parts
    ]
    return keep_one(union_all(shaped), pk)


def filter_active(
    df: DataFrame, column: str, value: str, pk: Sequence[str], flags: Mapping[str, Column] | None = None
) -> DataFrame:
    return keep_one(df.filter(F.col(column) == value), pk).withColumns(dict(flags or {}))


def latest_valid(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    valid_until: str | None,
    as_of: Column | str | None,
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per key the newest row still valid on ``as_of`` (the end date itself counts)."""
    if valid_until is not None:
        limit = F.lit(as_of) if isinstance(as_of, str) else as_of
        df = df.filter(F.col(valid_until) >= limit)
    return keep_one(df, key, [F.col(order).desc()]).withColumns(dict(flags or {}))
