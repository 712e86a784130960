"""KPI facts, targets, status, and the recap over all of them.

A fact has a grain (year and unit), counts, a value, its target and the achievement
(value as % of target). Counts are summed per grain with map-side partial sums, so a
unit holding a third of the rows costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.functions import (
    achievement,
    code_lookup,
    flag_count,
    half_up,
    percent,
    period_id,
    quota_status,
    ratio,
)
from tierworks.operators.joins import lookup
from tierworks.operators.profile import union_all

Targets = Mapping[str, Mapping[int, float]]


def targets(spark: SparkSession, table: Targets) -> DataFrame:
    """The target table in long form: (kpi, year, target)."""
    rows = [(kpi, int(y), float(v)) for kpi, years in table.items() for y, v in years.items()]
    return spark.createDataFrame(rows, "kpi string, year int, target double")


def target_for(year: Column | str, by_year: Mapping[int, float], fallback_year: int | None = None) -> Column:
    """Target of a year; NULL for a year without one unless a fallback year is named."""
    found = code_lookup((F.col(year) if isinstance(year, str) else year).cast("int"), {int(y): float(v) for y, v in by_year.items()})
    if fallback_year is None:
        return found
    return F.coalesce(found, F.lit(float(by_year.get(fallback_year, 0.0))))


def scored(
    df: DataFrame,
    value: str,
    target: Column,
    floor: float = 1.0,
    unknown_target: str = "null",
) -> DataFrame:
    """Add ``target_iku`` and ``capaian_iku`` to a fact."""
    return df.withColumn("target_iku", target).withColumn(
        "capaian_iku", achievement(value, "target_iku", floor, unknown_target)
    )


def share_fact(
    df: DataFrame,
    keys: Sequence[str],
    total: str,
    flags: Mapping[str, Column],
    met: Sequence[str] | Column,
    value: str,
) -> DataFrame:
    """Rows and flagged rows per key, and the share that meets the criterion.

    ``met`` names the flag counts to add up, or is a flag of its own (counted as
    ``<value>_met``) when the criteria overlap.
    """
    counts = {**flags}
    if isinstance(met, Column):
        counts[f"{value}_met"] = met
        met = [f"{value}_met"]
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total), *[flag_count(c).alias(n) for n, c in counts.items()]
    )
    return with_share(out, met, total, value)


def with_share(counts: DataFrame, met: Sequence[str], total: str, value: str) -> DataFrame:
    """The share (%) the named counts have in the total."""
    return counts.withColumn(value, percent(reduce(add, [F.col(m) for m in met]), total))


def any_flags(df: DataFrame, keys: Sequence[str], kinds: Mapping[str, Column]) -> DataFrame:
    """Per key one 0/1 column per kind: whether any row is of that kind."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(test, 1).otherwise(0)).alias(name) for name, test in kinds.items()]
    )


def any_flag_fact(
    activity: DataFrame,
    parent: DataFrame,
    key: str,
    year: str,
    unit: str,
    kinds: Mapping[str, Column],
    total: str,
    met: str,
    value: str,
    denominator: str = "active",
) -> DataFrame:
    """Parents with at least one qualifying kind of activity, per year and unit.

    ``denominator="active"`` counts the parents that have any activity in the year,
    ``"all"`` every parent of the unit.
    """
    if denominator not in ("active", "all"):
        raise ValueError(f"denominator must be 'active' or 'all', not {denominator!r}")
    flagged = lookup(any_flags(activity, [key, year], kinds), parent.select(key, unit), key, "inner")
    out = flagged.groupBy(year, unit).agg(
        F.count(F.lit(1)).alias(total),
        *[F.sum(n).alias(n) for n in kinds],
        F.sum(F.greatest(*[F.col(n) for n in kinds], F.lit(0))).alias(met),
    )
    if denominator == "all":
        heads = parent.groupBy(unit).agg(F.count(F.lit(1)).alias("__heads"))
        out = lookup(out, heads, unit).withColumn(total, F.col("__heads")).drop("__heads")
    return out.withColumn(value, percent(met, total))


def flag_sum_fact(
    df: DataFrame,
    unit: str,
    total: str,
    flags: Mapping[str, Column],
    met: str,
    value: str,
    overlap: str = "sum",
    year: int | None = None,
) -> DataFrame:
    """Flag counts per unit. ``overlap="sum"`` adds the counts (a row may count twice), ``"any"`` counts rows once.

    ``year`` stamps a snapshot with its year as ``tahun``, by way of an aggregate: on a
    plain literal a later join by period would turn into a product.
    """
    if overlap not in ("sum", "any"):
        raise ValueError(f"overlap must be 'sum' or 'any', not {overlap!r}")
    tests = [F.coalesce(c, F.lit(False)) for c in flags.values()]
    once = reduce(lambda a, b: a | b, tests)
    out = df.groupBy(unit).agg(
        F.count(F.lit(1)).alias(total),
        *[flag_count(c).alias(n) for n, c in flags.items()],
        flag_count(once).alias(met),
        *([] if year is None else [F.max(F.lit(year)).alias("tahun")]),
    )
    if overlap == "sum":
        out = out.withColumn(met, reduce(add, [F.col(n) for n in flags]))
    return out.withColumn(value, percent(met, total))


def ratio_fact(
    outputs: DataFrame,
    heads: DataFrame,
    unit: str,
    year: str,
    flags: Mapping[str, Column],
    head_count: str,
    eligible: str,
    value: str,
) -> DataFrame:
    """Flagged outputs per unit and year over the heads of the unit (4 digits)."""
    produced = (
        outputs.filter(F.col(unit).isNotNull() & F.col(year).isNotNull())
        .groupBy(unit, year)
        .agg(*[flag_count(c).alias(n) for n, c in flags.items()])
    )
    return per_head(produced, heads, unit, list(flags), head_count, eligible, value)


def per_head(
    produced: DataFrame, heads: DataFrame, unit: str, counts: Sequence[str], head_count: str, eligible: str, value: str
) -> DataFrame:
    per_unit = heads.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.count(F.lit(1)).alias(head_count))
    out = lookup(produced, per_unit, unit).withColumn(eligible, reduce(add, [F.col(n) for n in counts]))
    return out.withColumn(value, ratio(eligible, head_count, 4))


def entity_share_by_year(
    entities: DataFrame,
    qualifying: DataFrame,
    key: str,
    total: str,
    met: str,
    value: str,
    by_year: Mapping[int, float],
    year: str | None = None,
    fallback_year: int | None = None,
    first_target_floor: float = 1.0,
) -> DataFrame:
    """Share of entities that occur among the qualifying rows, for every year of the target table.

    Without ``year`` each target year repeats the one overall share; with it, only the
    qualifying rows of that year count.
    """
    n_total = entities.agg(F.count_distinct(F.col(key))).scalar()
    years = F.array(*[F.lit(int(y)) for y in by_year])
    if year is None:
        found = qualifying.agg(F.count_distinct(F.col(key)).alias(met)).select(F.explode(years).alias("tahun"), met)
    else:
        spark = entities.sparkSession
        grid = spark.range(1).select(F.explode(years).alias("tahun"))
        hits = qualifying.groupBy(F.col(year).cast("int").alias("tahun")).agg(F.count_distinct(F.col(key)).alias("__n"))
        found = lookup(grid, hits, "tahun").select("tahun", F.coalesce("__n", F.lit(0)).alias(met))
    out = found.select("tahun", n_total.alias(total), met).withColumn(value, percent(met, total))
    return scored(out, value, target_for("tahun", by_year, fallback_year), first_target_floor)


def capped_sum_fact(
    df: DataFrame, keys: Sequence[str], total: str, parts: Mapping[str, Column], met: str, value: str
) -> DataFrame:
    """Counts of several, possibly overlapping, kinds; their sum is capped at the total before the share is taken."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total), *[flag_count(c).alias(n) for n, c in parts.items()]
    )
    return with_capped_share(out, list(parts), total, met, value)


def with_capped_share(counts: DataFrame, parts: Sequence[str], total: str, met: str, value: str) -> DataFrame:
    capped = F.least(reduce(add, [F.col(n) for n in parts]), F.col(total))
    return counts.withColumn(met, capped).withColumn(value, percent(met, total))


def budget_fact(
    df: DataFrame,
    year: str,
    ceiling: Column,
    spent: Column,
    grades: Mapping[int, str],
    goals: Mapping[int, float],
    goal_grade: str = "BB",
    grade_factor: float = 0.95,
) -> DataFrame:
    """Per year: budget ceiling, spending, % spent, governance grade and targets.

    Both amounts must be whole numbers or decimals, so the sums are exact.
    """
    sums = df.groupBy(year).agg(F.sum(ceiling).alias("pagu_total"), F.sum(spent).alias("realisasi_total"))
    share = half_up(F.col("realisasi_total").cast("double") / F.col("pagu_total").cast("double") * 100, 2)
    share = F.when(F.col("pagu_total") != 0, share)
    return sums.withColumn("persen_realisasi", share).select(
        year,
        code_lookup(F.col(year), dict(grades)).alias("predikat_sakip"),
        half_up(F.col("persen_realisasi") * F.lit(grade_factor), 1).alias("nilai_sakip"),
        F.col("persen_realisasi").alias("nilai_kinerja_anggaran"),
        F.col("pagu_total").cast("double").alias("pagu_total"),
        F.col("realisasi_total").cast("double").alias("realisasi_total"),
        "persen_realisasi",
        F.lit(goal_grade).alias("target_sakip"),
        code_lookup(F.col(year), {y: float(v) for y, v in goals.items()}).alias("target_kinerja_anggaran"),
    )


def sample(fact: DataFrame, value: str, unit_label: str = "%") -> DataFrame:
    """One row: mean value, target and achievement of a fact, with the status of the means."""
    means = fact.agg(
        _mean(value).alias("v"), _mean("target_iku").alias("t"), _mean("capaian_iku").alias("a")
    )
    return means.select(
        half_up("v", 2).alias("nilai_capaian"),
        half_up("t", 2).alias("nilai_target"),
        half_up("a", 2).alias("persen_capaian_terhadap_target"),
        F.coalesce(quota_status("v", "t"), F.lit("")).alias("status_capaian"),
        F.lit(unit_label).alias("satuan"),
    )


def _mean(column: str) -> Column:
    """Unrounded mean over an exact decimal sum (facts hold at most four decimals)."""
    return F.sum(F.col(column).cast("decimal(28,4)")).cast("double") / F.count(column)


@dataclass(frozen=True)
class Indicator:
    """A recap line: its fact (None if it was not built), the value column and the labels."""

    code: str
    name: str
    fact: DataFrame | None
    value: str
    unit: str = "%"


def recap(
    spark: SparkSession,
    indicators: Sequence[Indicator],
    table: Targets,
    years: Sequence[int],
    fallback_year: int,
) -> DataFrame:
    """Value, target and status of every indicator in every year.

    A year's value is the mean over that year's rows of the fact; a year without rows
    takes the mean of the whole fact; an indicator without values takes
    ``target * (0.85 + 0.03 * years since the first)``. All facts go through one
    long-form aggregation; the whole-fact means come from the yearly sums, so each fact
    is read once.
    """
    years = sorted(years)
    grid_rows = []
    for y in years:
        for at, i in enumerate(indicators):
            goals = table.get(i.code, {})
            goal = float(goals.get(y, goals.get(fallback_year, 0.0)))
            grid_rows.append((y, at, i.code, i.name, i.unit, goal))
    grid = spark.createDataFrame(
        grid_rows, "tahun int, at int, iku_kode string, iku_nama string, satuan string, goal double"
    )

    parts = []
    for i in indicators:
        if i.fact is None or i.value not in i.fact.columns:
            continue
        has = i.fact.columns
        parts.append(
            i.fact.select(
                F.lit(i.code).alias("iku_kode"),
                (F.floor(F.col("waktu_id") / 100).cast("int") if "waktu_id" in has else F.lit(None).cast("int")).alias("y"),
                F.col(i.value).cast("decimal(28,4)").alias("v"),
                (F.col("target_iku") if "target_iku" in has else F.lit(None)).cast("decimal(28,4)").alias("t"),
            )
        )
    out = grid.withColumn("sim", F.col("goal") * (0.85 + (F.col("tahun") - years[0]) * 0.03))
    if parts:
        yearly = (
            union_all(parts)
            .groupBy("iku_kode", "y")
            .agg(
                F.sum("v").alias("sv"), F.count("v").alias("nv"), F.sum("t").alias("st"), F.count("t").alias("nt"),
                F.count(F.lit(1)).alias("n"),
            )
        )
        by_year = yearly.filter(F.col("y").isNotNull()).select(
            "iku_kode", F.col("y").alias("tahun"), "n",
            _safe_mean("sv", "nv").alias("v_year"), _safe_mean("st", "nt").alias("t_year"),
        )
        whole = (
            yearly.groupBy("iku_kode")
            .agg(*[F.sum(c).alias(c) for c in ("sv", "nv", "st", "nt")])
            .select("iku_kode", _safe_mean("sv", "nv").alias("v_all"), _safe_mean("st", "nt").alias("t_all"))
        )
        out = out.join(by_year, ["iku_kode", "tahun"], "left").join(whole, "iku_kode", "left")
        has_year = F.col("n").isNotNull()
        value = F.when(has_year, F.col("v_year")).otherwise(F.col("v_all"))
        goal = F.when(has_year, F.col("t_year")).otherwise(F.col("t_all"))
    else:
        value = goal = F.lit(None).cast("double")
    out = out.withColumn("value", F.coalesce(value, "sim")).withColumn("target", F.coalesce(goal, "goal"))
    return out.select(
        ((F.col("tahun") - years[0]) * len(indicators) + F.col("at") + 1).cast("int").alias("fact_id"),
        period_id("tahun").alias("waktu_id"),
        "iku_kode",
        "iku_nama",
        half_up("value", 2).alias("nilai_capaian"),
        half_up("target", 4).alias("nilai_target"),
        "satuan",
        quota_status("value", "target").alias("status_capaian"),
    )


def _safe_mean(total: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n))


__all__ = [
    "Indicator", "any_flag_fact", "any_flags", "budget_fact", "capped_sum_fact", "entity_share_by_year",
    "flag_sum_fact", "per_head", "ratio_fact", "recap", "sample", "scored", "share_fact",
    "target_for", "targets", "with_capped_share", "with_share",
]
