"""The layers built from the commerce tables: region, nation, customer, supplier, orders, lineitem, events.

Roles: region = faculty, nation = programme, customer = student, supplier = lecturer,
orders = graduate outcomes, lineitem = activity and budget, events = accreditation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import ClassVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.operators import gold, kpi, silver
from tierworks.operators.joins import lookup, sum_by_attribute
from tierworks.session import cut_lineage, new_work_path
from tierworks.sources import read_tables

# Targets per KPI and year; 1998 is left out, so a year without a target occurs.
TARGETS: dict[str, dict[int, float]] = {
    "KPI-1": {1995: 60, 1996: 62, 1997: 64, 1999: 66, 2000: 68, 2001: 70},
    "KPI-2": {1995: 60, 1996: 65, 1997: 70, 1999: 75, 2000: 80, 2001: 85},
    "KPI-3": {1995: 80, 1996: 85, 1997: 90, 1999: 95, 2000: 100, 2001: 100},
    "KPI-4": {1995: 60, 1996: 70, 1997: 80, 1999: 90, 2000: 100, 2001: 110},
    "KPI-5": {1995: 40, 1996: 50, 1997: 60, 1999: 80, 2000: 90, 2001: 100},
    "KPI-6": {1995: 10, 1996: 20, 1997: 30, 1999: 40, 2000: 50, 2001: 60},
    "KPI-7": {1995: 35, 1996: 40, 1997: 45, 1999: 50, 2000: 55, 2001: 60},
    "KPI-8": {1995: 2.5, 1996: 5, 1997: 10, 1999: 15, 2000: 20, 2001: 25},
}
YEARS = tuple(range(1995, 2002))
FALLBACK_YEAR = 2001
SNAPSHOT_YEAR = 2000
GRADES = {1995: "B", 1996: "B", 1997: "BB", 1999: "BB", 2000: "BB", 2001: "A"}
BUDGET_GOALS = {1995: 90.0, 1996: 92.0, 1997: 94.0, 1999: 95.0, 2000: 95.0, 2001: 96.0}

KPI_NAMES = {
    "KPI-1": "Orders filled or open",
    "KPI-2": "Customers with large balance or urgent order",
    "KPI-3": "Suppliers with qualifying shipments",
    "KPI-4": "Supplier standing",
    "KPI-5": "Returned and final lines per supplier",
    "KPI-6": "Customers with urgent open orders",
    "KPI-7": "Lines with high discount or tax",
    "KPI-8": "Users last seen buying",
}

SEGMENT_NAMES = {"AUTOMOBILE": "Automobile trade", "BUILDING": "Construction", "FURNITURE": "Furniture trade"}
TOPICS = [
    (1, "ECONOMY", "Low-cost range"),
    (2, "PROMO", "Campaign range"),
    (3, "STANDARD", "Standard range"),
    (4, "LARGE", "Large sizes"),
]


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


class Commerce:
    """Lazy layers over one data directory. A table's files are looked up when it is first used."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened.update(read_tables(self.spark, self.directory, name))
        return self._opened[name]

    # ---- silver ----

    def silver_customer(self) -> DataFrame:
        return silver.enrich_lookup(
            self["customer"],
            self["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"),
            "c_nationkey",
            ["c_custkey"],
            filled=[
                silver.Filled("segment_name", code="c_mktsegment", names=SEGMENT_NAMES, keep_code=True),
                silver.Filled("regionkey", ref="n_regionkey"),
            ],
            carry=["n_name"],
            flags={"is_large": F.col("c_acctbal") >= 5000},
        )

    def silver_orders(self) -> DataFrame:
        return silver.status_flags(
            self["orders"], "o_orderstatus", {"is_filled": "F", "is_open": "O"}, "is_settled", ["o_orderkey"]
        )

    def silver_supplier(self) -> DataFrame:
        child = self["lineitem"].select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
        flagged = self["supplier"].withColumns(supplier_flags())
        return silver.activity_flag(flagged, child, "s_suppkey", "l_returnflag", "is_active", ["s_suppkey"], least=3)

    def silver_party(self) -> DataFrame:
        """Customers and suppliers in one shape."""
        def part(table: str, tag: str, p: str, key: str) -> silver.Part:
            return silver.Part(
                self[table],
                tag,
                {
                    "id": F.concat(F.lit(tag[0] + "-"), F.col(key).cast("string")),
                    "name": F.col(f"{p}_name"),
                    "nationkey": F.col(f"{p}_nationkey"),
                    "acctbal": F.col(f"{p}_acctbal"),
                    "is_debtor": F.col(f"{p}_acctbal") < 0,
                },
            )

        return silver.union_tagged(
            [part("customer", "customer", "c", "c_custkey"), part("supplier", "supplier", "s", "s_suppkey")],
            "party_type",
            ["id"],
        )

    def silver_open_orders(self) -> DataFrame:
        return silver.filter_active(
            self["orders"], "o_orderstatus", "O", ["o_orderkey"],
            {"is_pressing": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")},
        )

    def silver_latest_event(self) -> DataFrame:
        """Per user the last event, with its end of validity (30 days) not before the as-of time."""
        events = self["events"].select(
            "event_id", "user_id", "event_type", "ts", "value",
            (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("valid_until"),
        )
        as_of = F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")
        return silver.latest_valid(
            events, ["user_id"], "ts", "valid_until", as_of, {"is_buyer": F.col("event_type") == "purchase"}
        )

    # ---- dimensions ----

    def dim_calendar(self) -> DataFrame:
        return gold.dim_calendar_of(self["orders"], "o_orderdate")

    def dim_nation(self) -> DataFrame:
        region = self["region"].select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        named = lookup(self["nation"], region, "n_regionkey")
        return gold.dim_from(
            named, "nationkey",
            {"nationkey": "n_nationkey", "nation": "n_name", "regionkey": "n_regionkey", "region": "r_name"},
        )

    def dim_supplier(self) -> DataFrame:
        return gold.dim_project(
            self.silver_supplier(), "suppkey",
            ["s_suppkey", "s_name", "s_nationkey", "is_premium", "is_solvent", "is_large"],
            {"s_suppkey": "suppkey", "s_name": "supplier", "s_nationkey": "nationkey"},
        )

    def dim_customer(self) -> DataFrame:
        return gold.dim_project(
            self["customer"], "custkey", ["c_custkey", "c_nationkey", "c_mktsegment"],
            {"c_custkey": "custkey", "c_nationkey": "nationkey", "c_mktsegment": "segment"},
        )

    # ---- facts ----

    def fact_kpi1(self) -> DataFrame:
        """Order outcomes by year and nation of the customer."""
        orders = self["orders"].select(
            F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("tahun"), "o_orderstatus"
        ).filter(F.col("tahun").isNotNull())
        status = F.col("o_orderstatus")
        one = F.lit(1).cast("bigint")

        def of(test: Column) -> Column:
            return F.when(test, one).otherwise(0)

        counts = sum_by_attribute(
            orders, self.customer_nation, "custkey", ["tahun"], ["nationkey"],
            {
                "total_orders": one,
                "orders_filled": of(status == "F"),
                "orders_open": of(status == "O"),
                "orders_other": of(~status.isin("F", "O")),
            },
        )
        shared = kpi.with_share(counts, ["orders_filled", "orders_open"], "total_orders", "pct_settled")
        fact = kpi.scored(shared, "pct_settled", self._target("KPI-1"))
        return gold.with_keys(fact, ["tahun", "nationkey"], "tahun").drop("tahun")

    def fact_kpi2(self) -> DataFrame:
        """Active customers by cohort (year of the first order) and nation."""
        pressing = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        per_customer = (
            self["orders"]
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.min(F.year("o_orderdate")).alias("tahun"), F.bool_or(pressing).alias("has_pressing"))
        )
        active = self["customer"].filter(F.coalesce(F.col("c_acctbal"), F.lit(0.0)) >= 0)
        rows = lookup(active, per_customer, "c_custkey").withColumnRenamed("c_nationkey", "nationkey")
        large, has = F.col("c_acctbal") >= 5000, F.coalesce("has_pressing", F.lit(False))
        shared = kpi.share_fact(
            rows, ["tahun", "nationkey"], "total_customers",
            {"customers_large": large, "customers_pressing": has, "customers_met": large | has},
            ["customers_met"], "pct_met",
        )
        fact = kpi.scored(shared, "pct_met", self._target("KPI-2"))
        return gold.with_keys(fact, ["tahun", "nationkey"], "tahun").drop("tahun")

    def fact_kpi3(self, denominator: str = "active") -> DataFrame:
        """Suppliers with a qualifying kind of shipment, by year and nation."""
        parent = self["supplier"].select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nationkey"))
        kinds = ("suppliers_returned", "suppliers_accepted", "suppliers_untaxed", "suppliers_discounted")
        fact = kpi.any_flag_fact(
            self.supplier_year, parent, "suppkey", "tahun", "nationkey",
            {k: F.col(k) > 0 for k in kinds}, "total_suppliers", "suppliers_met", "pct_met", denominator,
        )
        fact = kpi.scored(fact, "pct_met", self._target("KPI-3"))
        return gold.with_keys(fact, ["tahun", "nationkey"], "tahun").drop("tahun")

    def fact_kpi4(self, overlap: str = "sum") -> DataFrame:
        """Supplier standing by nation, one snapshot."""
        rows = self["supplier"].withColumns(supplier_flags()).withColumnRenamed("s_nationkey", "nationkey")
        fact = kpi.flag_sum_fact(
            rows, "nationkey", "total_suppliers",
            {"suppliers_premium": F.col("is_premium"), "suppliers_solvent": F.col("is_solvent"), "suppliers_large": F.col("is_large")},
            "suppliers_met", "pct_met", overlap, SNAPSHOT_YEAR,
        )
        fact = kpi.scored(fact, "pct_met", F.lit(float(TARGETS["KPI-4"][SNAPSHOT_YEAR])))
        return gold.with_keys(fact, ["tahun", "nationkey"], "tahun").drop("tahun")

    def fact_kpi5(self) -> DataFrame:
        """Returned and final lines per supplier, by year and region."""
        counted = ["lines_returned", "lines_final"]
        produced = sum_by_attribute(
            self.supplier_year, self.supplier_region, "suppkey", ["tahun"], ["regionkey"], {m: F.col(m) for m in counted}
        )
        fact = kpi.per_head(
            produced, self.supplier_region, "regionkey", counted, "total_suppliers", "total_eligible", "ratio_per_supplier"
        )
        fact = kpi.scored(fact, "ratio_per_supplier", self._target("KPI-5"), floor=0.01)
        return gold.with_keys(fact, ["tahun", "regionkey"], "tahun").drop("tahun")

    def fact_kpi6(self) -> DataFrame:
        """Share of active customers with an urgent open order, repeated for every target year."""
        hits = self["orders"].filter((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))
        fact = kpi.entity_share_by_year(
            self["customer"].select(F.col("c_custkey").alias("custkey")),
            hits.select(F.col("o_custkey").alias("custkey")),
            "custkey", "total_customers", "customers_met", "pct_met", TARGETS["KPI-6"],
        )
        return gold.with_keys(fact, ["tahun"], "tahun").drop("tahun")

    def fact_kpi7(self) -> DataFrame:
        """Lines with a high discount or tax, by year and nation of the supplier; the sum is capped at all lines."""
        counted = ["total_lines", "lines_discounted", "lines_taxed"]
        counts = sum_by_attribute(
            self.supplier_year, self.supplier_nation, "suppkey", ["tahun"], ["nationkey"], {m: F.col(m) for m in counted}
        )
        fact = kpi.with_capped_share(counts, ["lines_discounted", "lines_taxed"], "total_lines", "lines_met", "pct_met")
        fact = kpi.scored(fact, "pct_met", self._target("KPI-7"))
        return gold.with_keys(fact, ["tahun", "nationkey"], "tahun").drop("tahun")

    def fact_kpi8(self) -> DataFrame:
        """Share of users whose latest valid event is a purchase, repeated for every target year."""
        fact = kpi.entity_share_by_year(
            self["events"].select("user_id"),
            self.silver_latest_event().filter("is_buyer").select("user_id"),
            "user_id", "total_users", "users_met", "pct_met", TARGETS["KPI-8"],
        )
        return gold.with_keys(fact, ["tahun"], "tahun").drop("tahun")

    def fact_budget(self) -> DataFrame:
        lines = self["lineitem"].select(
            F.year("l_shipdate").alias("tahun"), "l_extendedprice", "l_discount"
        )
        net = money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
        fact = kpi.budget_fact(lines, "tahun", money("l_extendedprice"), net, GRADES, BUDGET_GOALS)
        return gold.with_keys(fact, ["tahun"], "tahun").drop("tahun")

    def indicators(self) -> list[kpi.Indicator]:
        facts = [
            ("KPI-1", self.fact_kpi1(), "pct_settled", "%"),
            ("KPI-2", self.fact_kpi2(), "pct_met", "%"),
            ("KPI-3", self.fact_kpi3(), "pct_met", "%"),
            ("KPI-4", self.fact_kpi4(), "pct_met", "%"),
            ("KPI-5", self.fact_kpi5(), "ratio_per_supplier", "Rasio"),
            ("KPI-6", self.fact_kpi6(), "pct_met", "%"),
            ("KPI-7", self.fact_kpi7(), "pct_met", "%"),
            ("KPI-8", self.fact_kpi8(), "pct_met", "%"),
        ]
        return [kpi.Indicator(c, KPI_NAMES[c], f, v, u) for c, f, v, u in facts]

    def recap(self) -> DataFrame:
        """All KPIs by year. Three of them rest on the supplier-year counts, which are stored first: the lines are
        read and shuffled once."""
        self.supplier_year = cut_lineage(self.supplier_year)
        return kpi.recap(self.spark, self.indicators(), TARGETS, YEARS, FALLBACK_YEAR)

    # ---- shared pieces ----

    @cached_property
    def lines(self) -> DataFrame:
        return self["lineitem"].select(
            F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("tahun"),
            "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax",
        )

    @cached_property
    def supplier_year(self) -> DataFrame:
        """Everything the KPIs need to know of the lines, per supplier and year."""
        flag, amount = F.col("l_returnflag"), F.col("l_quantity")
        return self.lines.groupBy("suppkey", "tahun").agg(
            F.count(F.lit(1)).alias("total_lines"),
            F.count_if(flag == "R").alias("lines_returned"),
            F.count_if(F.col("l_linestatus") == "F").alias("lines_final"),
            F.count_if(F.col("l_discount") >= 0.07).alias("lines_discounted"),
            F.count_if(F.col("l_tax") >= 0.05).alias("lines_taxed"),
            F.count_if((flag == "R") & (amount >= 45)).alias("suppliers_returned"),
            F.count_if((flag == "A") & (amount >= 48)).alias("suppliers_accepted"),
            F.count_if((F.col("l_tax") == 0) & (amount >= 49)).alias("suppliers_untaxed"),
            F.count_if((F.col("l_discount") >= 0.1) & (amount >= 49)).alias("suppliers_discounted"),
        )

    @cached_property
    def customer_nation(self) -> DataFrame:
        return self["customer"].select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"))

    @cached_property
    def supplier_nation(self) -> DataFrame:
        return self["supplier"].select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nationkey"))

    @cached_property
    def supplier_region(self) -> DataFrame:
        nation = self["nation"].select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey"))
        return lookup(self.supplier_nation, nation, "nationkey", "inner").select("suppkey", "regionkey")

    @staticmethod
    def _target(code: str) -> Column:
        return kpi.target_for("tahun", TARGETS[code])


def supplier_flags() -> dict[str, Column]:
    return {
        "is_premium": F.col("s_acctbal") >= 7500,
        "is_solvent": F.col("s_acctbal") >= 0,
        "is_large": F.col("s_acctbal") >= 5000,
    }


class StoredGold(Commerce):
    """The same layers, the gold tables written once in an application and then only read.

    A table is written to the shared folder when it is first asked for, from the facts' own plans; the recap is
    made of the stored facts. Like any stored layer it shows the sources as they were when it was written;
    ``forget`` starts over.
    """

    WRITTEN: ClassVar[dict[tuple[str, str, str], str]] = {}

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.directory, name)
        if key in self.WRITTEN:
            try:
                return self.spark.read.parquet(self.WRITTEN[key])
            except AnalysisException:  # the shared folder was cleared
                del self.WRITTEN[key]
        path = new_work_path(self.spark, f"gold-{name}")
        build().write.parquet(path)
        self.WRITTEN[key] = path
        return self.spark.read.parquet(path)

    def write_all(self) -> None:
        """Write every gold table that is not there yet."""
        for name in GOLD_TABLES:
            getattr(self, name)()
        self.recap()

    @classmethod
    def forget(cls) -> None:
        cls.WRITTEN.clear()

    @cached_property
    def supplier_year(self) -> DataFrame:
        return self._stored("supplier_year", lambda: Commerce(self.spark, self.directory).supplier_year)

    def recap(self) -> DataFrame:
        return self._stored("recap", lambda: kpi.recap(self.spark, self.indicators(), TARGETS, YEARS, FALLBACK_YEAR))


def _read_stored(name: str) -> None:
    """Give StoredGold a method that reads the table; a call with options other than the defaults builds it."""
    build = getattr(Commerce, name)

    def method(self: StoredGold, *args, **options) -> DataFrame:
        if args or options:
            return build(self, *args, **options)
        return self._stored(name, lambda: build(self))

    method.__doc__ = build.__doc__
    setattr(StoredGold, name, method)


GOLD_TABLES = ("dim_calendar", "dim_nation", "dim_supplier", "dim_customer", "fact_budget", *(f"fact_kpi{i}" for i in range(1, 9)))
for _name in GOLD_TABLES:
    _read_stored(_name)
