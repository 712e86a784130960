"""Column expressions shared by the operators. All of them stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank(value: ColumnLike) -> Column:
    """NULL, empty or white space only."""
    value = _c(value)
    return value.isNull() | (F.length(F.trim(value.cast("string"))) == 0)


def half_up(value: ColumnLike, digits: int) -> Column:
    """Round half up on the decimal form, so binary noise never decides a tie."""
    return F.round(_c(value).cast("decimal(38,10)"), digits).cast("double")


def ratio(part: ColumnLike, whole: ColumnLike, digits: int, scale: int = 1) -> Column:
    """``scale * part / max(whole, 1)`` for counts, rounded half up.

    Pure integer arithmetic: exact, and the same on every engine and partitioning.
    """
    step = 10**digits
    twice = 2 * scale * step
    if isinstance(part, str) and isinstance(whole, str):
        # One SQL text in place of a dozen expression calls.
        least_one = f"greatest(bigint(`{whole}`), 1L)"
        return F.expr(
            f"double((bigint(`{part}`) * {twice}L + {least_one}) div ({least_one} * 2L)) / {float(step)}D"
        )
    whole = F.greatest(_c(whole).cast("bigint"), F.lit(1).cast("bigint"))
    doubled = _c(part).cast("bigint") * F.lit(twice).cast("bigint") + whole
    steps = F.call_function("div", doubled, whole * F.lit(2))
    return steps.cast("double") / F.lit(float(step))


def percent(part: ColumnLike, whole: ColumnLike, digits: int = 2) -> Column:
    return ratio(part, whole, digits, scale=100)


def mean_of(value: ColumnLike, digits: int = 4) -> Column:
    """Aggregate: mean over an exact decimal sum, so the row order does not matter."""
    total = F.sum(_c(value).cast("decimal(28,4)")).cast("double")
    return half_up(total / F.count(_c(value)), digits)


def achievement(value: ColumnLike, target: ColumnLike, floor: float = 1.0, unknown: str = "null") -> Column:
    """Value as a percentage of its target (not below ``floor``).

    ``unknown="floor"`` divides by the floor where no target is known; the default
    leaves the achievement NULL there.
    """
    value, target = _c(value), _c(target)
    share = half_up(value / F.greatest(target, F.lit(floor)) * 100, 2)
    if unknown == "floor":
        return share
    if unknown != "null":
        raise ValueError(f"unknown must be 'null' or 'floor', not {unknown!r}")
    return F.when(target.isNotNull(), share)


@dataclass(frozen=True)
class StatusLabels:
    # Result labels.
    reached: str = "Tercapai"
    close: str = "On Track"
    missed: str = "Tidak Tercapai"
    close_share: float = 0.8


def quota_status(value: ColumnLike, target: ColumnLike, labels: StatusLabels = StatusLabels()) -> Column:
    value, target = _c(value), _c(target)
    known = value.isNotNull() & target.isNotNull()
    return (
        F.when(known & (value >= target), labels.reached)
        .when(known & (value >= target * F.lit(labels.close_share)), labels.close)
        .when(known, labels.missed)
    )


def _literal(value) -> str:
    if isinstance(value, bool) or value is None:
        return "NULL" if value is None else str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def code_lookup(key: ColumnLike, table: Mapping, default: Column | None = None) -> Column:
    """Small literal table as an expression; NULL (or ``default``) for a missing key."""
    if not table:
        found = F.lit(None).cast("string")
    else:
        pairs = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items())
        found = F.try_element_at(F.expr(f"map({pairs})"), _c(key))
    return found if default is None else F.coalesce(found, default)


def year_of(value: ColumnLike, is_text: bool = True) -> Column:
    """Year of a date, timestamp or ISO text; NULL for text that is no date."""
    return F.year(F.try_to_date(_c(value)) if is_text else _c(value))


def as_bool(value: ColumnLike) -> Column:
    return _c(value).cast("string").try_cast("boolean")


def flag_count(value: ColumnLike) -> Column:
    """Aggregate: rows whose flag is true."""
    return F.coalesce(F.sum(F.coalesce(_c(value), F.lit(False)).cast("bigint")), F.lit(0).cast("bigint"))


def period_id(year: ColumnLike, month: int = 12) -> Column:
    return (_c(year).cast("int") * 100 + month).cast("int")


def grain_id(*columns: ColumnLike) -> Column:
    """Surrogate key from the grain itself: the same on every run and layout."""
    return F.xxhash64(*[_c(c).cast("string") for c in columns])
