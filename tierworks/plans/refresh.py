"""The commerce facts kept up to date by batches: what each fact needs of its source, and the facts made of the kept counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.functions import percent
from tierworks.operators import gold, kpi
from tierworks.operators.incremental import CountFact, Maintained, Measure, StateSource
from tierworks.operators.joins import lookup, sum_by_attribute
from tierworks.plans.commerce import (
    BUDGET_GOALS,
    FALLBACK_YEAR,
    GRADES,
    SNAPSHOT_YEAR,
    TARGETS,
    YEARS,
    Commerce,
    money,
    supplier_flags,
)
from tierworks.session import new_work_path

LAYER = "tierworks_gold"
AS_OF = "2024-02-10 00:00:00"
PRESSING = ("1-URGENT", "2-HIGH")
SCOPE = "scope"  # the one group of facts that count over everything

# What arrives late in the given tables, batch by batch: a condition for each batch, the rest was there before.
BATCHES: dict[str, tuple[str, ...]] = {
    "orders": ("month(o_orderdate) = 11", "month(o_orderdate) = 12"),
    "lineitem": ("l_linenumber = 6", "l_linenumber >= 7"),
    "events": ("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'",),
    "supplier": ("s_acctbal < 1000",),
}

OUTCOMES = ("total_orders", "orders_filled", "orders_open", "orders_other")
CUSTOMERS = ("total_customers", "customers_large", "customers_pressing", "customers_met")
KINDS = ("suppliers_returned", "suppliers_accepted", "suppliers_untaxed", "suppliers_discounted")
LINES = ("total_lines", "lines_returned", "lines_final", "lines_discounted", "lines_taxed")
STANDING = ("suppliers_premium", "suppliers_solvent", "suppliers_large")


def number(test: Column) -> Column:
    return F.when(test, 1).otherwise(0).cast("bigint")


class MaintainedGold(Commerce):
    """States and counts of all facts; rows come as DataFrames shaped like the raw tables."""

    def __init__(self, spark: SparkSession, directory: str, name: str, location: str):
        super().__init__(spark, directory)
        self.kept = Maintained(spark, LAYER, name, location, self._sources, slices=8, buckets=2)

    # ---- what is kept ----

    @cached_property
    def _sources(self) -> dict[str, StateSource]:
        active = self["customer"].filter(F.coalesce(F.col("c_acctbal"), F.lit(0.0)) >= 0)
        active = active.select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"), (F.col("c_acctbal") >= 5000).alias("large"))

        def cohorts(states: DataFrame) -> DataFrame:
            rows = lookup(states, active, "custkey", "inner")
            large, has = F.coalesce("large", F.lit(False)), F.coalesce("has_pressing", F.lit(False))
            return rows.select(
                "tahun", "nationkey", F.lit(1).cast("bigint").alias("total_customers"), number(large).alias("customers_large"),
                number(has).alias("customers_pressing"), number(large | has).alias("customers_met"),
            )

        def urgent(states: DataFrame) -> DataFrame:
            return states.select(F.lit("all").alias(SCOPE), number(F.coalesce("urgent_open", F.lit(False))).alias("customers_met"))

        def kinds(states: DataFrame) -> DataFrame:
            rows = lookup(states, self.supplier_nation, "suppkey", "inner")
            flags = [number(F.col(k) > 0) for k in KINDS]
            return rows.select(
                "tahun", "nationkey", F.lit(1).cast("bigint").alias("total_suppliers"),
                *[f.alias(k) for f, k in zip(flags, KINDS, strict=True)], F.greatest(*flags).alias("suppliers_met"),
            )

        def regions(states: DataFrame) -> DataFrame:
            return lookup(states, self.supplier_region, "suppkey", "inner").select("tahun", "regionkey", "lines_returned", "lines_final")

        def nations(states: DataFrame) -> DataFrame:
            return lookup(states, self.supplier_nation, "suppkey", "inner").select("tahun", "nationkey", "total_lines", "lines_discounted", "lines_taxed")

        def users(states: DataFrame) -> DataFrame:
            buyer = F.coalesce("last.is_buyer", F.lit(False))
            return states.select(F.lit("all").alias(SCOPE), F.lit(1).cast("bigint").alias("total_users"), number(buyer).alias("users_met"))

        def same(*columns: str):
            return lambda states: states.select(*columns)

        def sums(names: Sequence[str]) -> tuple[Measure, ...]:
            return tuple(Measure(n, F.col(n)) for n in names)

        return {
            "outcomes": StateSource(
                ("tahun", "nationkey"), sums(OUTCOMES), {"kpi1": CountFact(("tahun", "nationkey"), OUTCOMES, same("tahun", "nationkey", *OUTCOMES))}
            ),
            "customers": StateSource(
                ("custkey",),
                (Measure("tahun", F.col("tahun"), "min"), Measure("has_pressing", F.col("pressing"), "any"), Measure("urgent_open", F.col("urgent"), "any")),
                {"kpi2": CountFact(("tahun", "nationkey"), CUSTOMERS, cohorts), "kpi6": CountFact((SCOPE,), ("customers_met",), urgent)},
                population=active.select("custkey"),
            ),
            "lines": StateSource(
                ("suppkey", "tahun"), sums((*LINES, *KINDS)),
                {
                    "kpi3": CountFact(("tahun", "nationkey"), ("total_suppliers", *KINDS, "suppliers_met"), kinds),
                    "kpi5": CountFact(("tahun", "regionkey"), ("lines_returned", "lines_final"), regions),
                    "kpi7": CountFact(("tahun", "nationkey"), ("total_lines", "lines_discounted", "lines_taxed"), nations),
                },
            ),
            "budget": StateSource(("tahun",), sums(("pagu", "realisasi")), {"budget": CountFact(("tahun",), ("pagu", "realisasi"), same("tahun", "pagu", "realisasi"))}),
            "users": StateSource(("user_id",), (Measure("last", F.col("last"), "max"),), {"kpi8": CountFact((SCOPE,), ("total_users", "users_met"), users)}),
            "suppliers": StateSource(
                ("nationkey",), sums(("total_suppliers", *STANDING)),
                {"kpi4": CountFact(("nationkey",), ("total_suppliers", *STANDING), same("nationkey", "total_suppliers", *STANDING))},
            ),
        }

    # ---- raw rows as the states want them ----

    def outcome_rows(self, orders: DataFrame) -> DataFrame:
        status, one = F.col("o_orderstatus"), F.lit(1).cast("bigint")
        rows = orders.select(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("tahun"), "o_orderstatus").filter(F.col("tahun").isNotNull())
        tests = [one, number(status == "F"), number(status == "O"), number(~status.isin("F", "O"))]
        return sum_by_attribute(rows, self.customer_nation, "custkey", ["tahun"], ["nationkey"], dict(zip(OUTCOMES, tests, strict=True)))

    def feed(self, table: str, rows: DataFrame) -> dict[str, DataFrame]:
        """Rows of a raw table, by the sources that take them."""
        if table == "orders":
            urgent = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
            seen = rows.select(
                F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("tahun"), F.col("o_orderpriority").isin(*PRESSING).alias("pressing"), urgent.alias("urgent")
            )
            return {"outcomes": self.outcome_rows(rows), "customers": seen}
        if table == "lineitem":
            flag, amount = F.col("l_returnflag"), F.col("l_quantity")
            tests = {
                "lines_returned": flag == "R", "lines_final": F.col("l_linestatus") == "F",
                "lines_discounted": F.col("l_discount") >= 0.07, "lines_taxed": F.col("l_tax") >= 0.05,
                "suppliers_returned": (flag == "R") & (amount >= 45), "suppliers_accepted": (flag == "A") & (amount >= 48),
                "suppliers_untaxed": (F.col("l_tax") == 0) & (amount >= 49), "suppliers_discounted": (F.col("l_discount") >= 0.1) & (amount >= 49),
            }
            tahun, one = F.year("l_shipdate").alias("tahun"), F.lit(1).cast("bigint").alias("total_lines")
            net = money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
            return {
                "lines": rows.select(F.col("l_suppkey").alias("suppkey"), tahun, one, *[number(t).alias(n) for n, t in tests.items()]),
                "budget": rows.select(tahun, money("l_extendedprice").alias("pagu"), net.alias("realisasi")),
            }
        if table == "events":
            valid = F.col("ts") + F.expr("INTERVAL 30 DAYS") >= F.lit(AS_OF).cast("timestamp_ntz")
            newest = F.struct("ts", (-F.col("event_id")).alias("before"), (F.col("event_type") == "purchase").alias("is_buyer"))
            return {"users": rows.select("user_id", F.when(valid, newest).alias("last"))}
        if table == "supplier":
            flags = dict(zip(STANDING, supplier_flags().values(), strict=True))
            one = F.lit(1).cast("bigint").alias("total_suppliers")
            return {"suppliers": rows.select(F.col("s_nationkey").alias("nationkey"), one, *[number(t).alias(n) for n, t in flags.items()])}
        raise ValueError(f"no fact is made of {table!r}")

    def build(self, table: str, rows: DataFrame) -> None:
        for source, fed in self.feed(table, rows).items():
            self.kept.build(source, fed)

    def append(self, table: str, batch: DataFrame, at: int) -> None:
        """Bring a batch of a raw table in; ``at`` numbers the table's batches from 1."""
        for source, fed in self.feed(table, batch).items():
            self.kept.refresh(source, fed, at)

    # ---- the facts ----

    def _finished(self, fact: DataFrame, value: str, goal: Column, grain: list[str], floor: float = 1.0) -> DataFrame:
        return gold.with_keys(kpi.scored(fact, value, goal, floor), grain, "tahun").drop("tahun")

    def fact_kpi1(self) -> DataFrame:
        shared = kpi.with_share(self.kept.read_counts("outcomes", "kpi1"), ["orders_filled", "orders_open"], "total_orders", "pct_settled")
        return self._finished(shared, "pct_settled", self._target("KPI-1"), ["tahun", "nationkey"])

    def fact_kpi2(self) -> DataFrame:
        shared = kpi.with_share(self.kept.read_counts("customers", "kpi2"), ["customers_met"], "total_customers", "pct_met")
        return self._finished(shared, "pct_met", self._target("KPI-2"), ["tahun", "nationkey"])

    def fact_kpi3(self, denominator: str = "active") -> DataFrame:
        if denominator != "active":
            return super().fact_kpi3(denominator)
        shared = kpi.with_share(self.kept.read_counts("lines", "kpi3"), ["suppliers_met"], "total_suppliers", "pct_met")
        return self._finished(shared, "pct_met", self._target("KPI-3"), ["tahun", "nationkey"])

    def fact_kpi4(self, overlap: str = "sum") -> DataFrame:
        if overlap != "sum":
            return super().fact_kpi4(overlap)
        counts = self.kept.read_counts("suppliers", "kpi4").groupBy("nationkey").agg(
            *[F.sum(c).alias(c) for c in ("total_suppliers", *STANDING)], F.max(F.lit(SNAPSHOT_YEAR)).alias("tahun")
        )
        met = counts.withColumn("suppliers_met", sum((F.col(c) for c in STANDING[1:]), F.col(STANDING[0])))
        shared = met.withColumn("pct_met", percent("suppliers_met", "total_suppliers"))
        return self._finished(shared, "pct_met", F.lit(float(TARGETS["KPI-4"][SNAPSHOT_YEAR])), ["tahun", "nationkey"])

    def fact_kpi5(self) -> DataFrame:
        counts = self.kept.read_counts("lines", "kpi5")
        fact = kpi.per_head(counts, self.supplier_region, "regionkey", ["lines_returned", "lines_final"], "total_suppliers", "total_eligible", "ratio_per_supplier")
        return self._finished(fact, "ratio_per_supplier", self._target("KPI-5"), ["tahun", "regionkey"], 0.01)

    def _repeated(self, counts: DataFrame, total: str, met: str, code: str) -> DataFrame:
        """One share for every target year."""
        years = F.array(*[F.lit(y) for y in TARGETS[code]])
        rows = counts.select(F.explode(years).alias("tahun"), total, met).withColumn("pct_met", percent(met, total))
        return self._finished(rows, "pct_met", self._target(code), ["tahun"])

    def fact_kpi6(self) -> DataFrame:
        n = self["customer"].agg(F.count_distinct("c_custkey").alias("total_customers")).withColumn("customers_met", F.lit(0).cast("long"))
        met = self.kept.read_counts("customers", "kpi6").agg(F.coalesce(F.sum("customers_met"), F.lit(0)).alias("customers_met"))
        both = n.unionByName(met.withColumn("total_customers", F.lit(0).cast("long")))
        both = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_customers", "customers_met")])
        return self._repeated(both, "total_customers", "customers_met", "KPI-6")

    def fact_kpi7(self) -> DataFrame:
        counts = self.kept.read_counts("lines", "kpi7")
        fact = kpi.with_capped_share(counts, ["lines_discounted", "lines_taxed"], "total_lines", "lines_met", "pct_met")
        return self._finished(fact, "pct_met", self._target("KPI-7"), ["tahun", "nationkey"])

    def fact_kpi8(self) -> DataFrame:
        n = self.kept.read_counts("users", "kpi8").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_users", "users_met")])
        return self._repeated(n, "total_users", "users_met", "KPI-8")

    def fact_budget(self) -> DataFrame:
        counts = self.kept.read_counts("budget", "budget")
        fact = kpi.budget_fact(counts, "tahun", F.col("pagu"), F.col("realisasi"), GRADES, BUDGET_GOALS)
        return gold.with_keys(fact, ["tahun"], "tahun").drop("tahun")

    def recap(self) -> DataFrame:
        return kpi.recap(self.spark, self.indicators(), TARGETS, YEARS, FALLBACK_YEAR)


class RefreshedGold(MaintainedGold):
    """Facts built from what was there first and then refreshed with every batch of :data:`BATCHES`, once in an application."""

    MADE: ClassVar[dict[tuple[str, str], tuple[str, str]]] = {}

    def __init__(self, spark: SparkSession, directory: str):
        key = (spark.sparkContext.applicationId, directory)
        name, location = self.MADE.get(key, ("", ""))
        if not name:
            location = new_work_path(spark, "refreshed")
            name = "r" + location.rsplit("-", 1)[1]
        super().__init__(spark, directory, name, location)
        if key not in self.MADE:
            self.prepare()
            self.MADE[key] = (name, location)

    def prepare(self) -> None:
        for table, batches in BATCHES.items():
            late = F.coalesce(F.expr(" OR ".join(f"({b})" for b in batches)), F.lit(False))
            self.build(table, self[table].where(~late))
            for at, batch in enumerate(batches, 1):
                self.append(table, self[table].where(batch), at)

    def change(self, source: str, fact: str, at: int) -> DataFrame:
        """What batch ``at`` added to the counts of a fact."""
        return self.spark.read.parquet(f"{self.kept.location}/{self.kept.prefix}-{source}-{at}/{fact}/rows")


__all__ = ["BATCHES", "MaintainedGold", "RefreshedGold"]
