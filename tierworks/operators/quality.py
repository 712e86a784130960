"""Quality score, gate and reports built on the profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierworks.functions import half_up, percent
from tierworks.operators import profile

# Gate limits.
PASS_FROM = 80.0
QUARANTINE_FROM = 60.0


def status(score: Column | str, rows: Column | str | None = None) -> Column:
    """PASS, QUARANTINE or REJECT; a table without rows is rejected."""
    score = F.col(score) if isinstance(score, str) else score
    by_score = (
        F.when(score >= PASS_FROM, "PASS").when(score >= QUARANTINE_FROM, "QUARANTINE").otherwise("REJECT")
    )
    if rows is None:
        return by_score
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.when(rows > 0, by_score).otherwise("REJECT")


def score(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, columns, score (mean completeness of the columns) and status."""
    return score_profile(profile.completeness(df, name))


def score_profile(column_profile: DataFrame) -> DataFrame:
    means = profile.mean_completeness(column_profile)
    return means.select(
        "table_name",
        "row_count",
        "column_count",
        F.col("completeness").alias("quality_score"),
        status("completeness", "row_count").alias("status"),
    )


def gate(df: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows of a table whose one-row score is not REJECT, tagged with the status.

    The status is a scalar subquery: it is computed inside the same query, and a
    rejected table yields no rows.
    """
    verdict = scored.select("status").scalar()
    return df.filter(verdict != "REJECT").withColumn("quality_status", verdict)


def combine(scored: DataFrame, name: str, rule: str = "mean") -> DataFrame:
    """Several sources as one: rows added, scores averaged, status from the mean.

    ``rule="any"`` passes the union as soon as one source passes.
    """
    if rule not in ("mean", "any"):
        raise ValueError(f"rule must be 'mean' or 'any', not {rule!r}")
    both = scored.agg(
        F.sum("row_count").alias("row_count"),
        half_up(F.avg("quality_score"), 2).alias("quality_score"),
        F.max(F.col("status") == "PASS").alias("passed"),
    )
    derived = status("quality_score", "row_count")
    if rule == "any":
        derived = F.when(F.col("passed"), "PASS").otherwise(derived)
    return both.select(F.lit(name).alias("table_name"), "row_count", "quality_score", derived.alias("status"))


def before_after(
    source_score: DataFrame, out: DataFrame, name: str, transformations: Sequence[str], sources: Sequence[str]
) -> DataFrame:
    """Source score and status beside the completeness of the transformed table."""
    after = profile.mean_completeness(profile.completeness(out, name))
    source = source_score.select("quality_score", "status")
    return after.select(
        "table_name",
        "row_count",
        "column_count",
        source.select("quality_score").scalar().alias("source_score"),
        source.select("status").scalar().alias("source_status"),
        F.col("completeness").alias("completeness_after"),
        F.lit(len(transformations)).alias("n_transformations"),
        F.lit("; ".join(transformations)).alias("transformations"),
        F.lit(" + ".join(sources)).alias("sources"),
    )


def report(scored: DataFrame) -> DataFrame:
    """Tables and rows per status, with the share of passing tables among PASS and QUARANTINE (whole %)."""
    per_status = scored.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.sum("row_count").alias("row_count"),
        F.min("quality_score").alias("min_score"),
        F.max("quality_score").alias("max_score"),
    )
    share = scored.agg(
        percent(
            F.sum((F.col("status") == "PASS").cast("bigint")),
            F.sum(F.col("status").isin("PASS", "QUARANTINE").cast("bigint")),
            0,
        ).cast("int").alias("share")
    )
    return per_status.select(
        "status",
        (F.col("status") != "REJECT").alias("written"),
        "n_tables",
        "row_count",
        "min_score",
        "max_score",
        share.scalar().alias("pass_share_pct"),
    )
