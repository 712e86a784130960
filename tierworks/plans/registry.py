"""Every operator bound to the given tables: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierworks.functions import half_up, mean_of, percent, period_id, quota_status
from tierworks.operators import catalog, glossary, kpi, ledger, lineage, olap, predict, profile, quality, scenario, sketches, skew
from tierworks.operators.joins import lookup, matched_pairs, one_per_level, orphan_keys, skewed_join
from tierworks.operators.shape import ensure_column, first_of_duplicate_columns, keep_one, sample_rows
from tierworks.operators.lattice import Lattice
from tierworks.operators.textindex import TextIndex
from tierworks.plans import assets
from tierworks.plans.commerce import KPI_NAMES, TARGETS, TOPICS, Commerce, StoredGold
from tierworks.plans.refresh import RefreshedGold
from tierworks.session import new_work_path
from tierworks.sources import append_batch, literal_table, read_layer, staging_inventory, write_layer
from tierworks.sources.formats import FORMATS, format_comparison
from tierworks.sources.raw import PARQUET_TABLES, inventory_totals, read_raw_csv
from tierworks.sources.slices import SlicedTable
from tierworks.streaming import ingest_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
INDEXES: dict[tuple[str, str], TextIndex] = {}
CUBES: dict[tuple[str, str], Lattice] = {}


def query(fn: Callable[[Commerce], DataFrame]) -> Callable[[Commerce], DataFrame]:
    """Register a function of the layers under its own name."""
    QUERIES[fn.__name__] = lambda spark, directory: fn(Commerce(spark, directory))
    return fn


def serving(fn: Callable[[Commerce], DataFrame]) -> Callable[[Commerce], DataFrame]:
    """Register a function that reads stored gold tables."""
    QUERIES[fn.__name__] = lambda spark, directory: fn(StoredGold(spark, directory))
    return fn


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def no_id(df: DataFrame) -> DataFrame:
    return df.drop("fact_id")


# ---- sources and sinks ------------------------------------------------------------


@query
def raw_scan(c):
    """Text copy of a table: written as CSV with a header, read back with every column text."""
    path = new_work_path(c.spark, "staging-customer")
    c["customer"].write.mode("overwrite").option("header", True).csv(path)
    return read_raw_csv(c.spark, path, c["customer"].columns)


@query
def table_row_counts(c):
    return staging_inventory({n: c[n] for n in PARQUET_TABLES}).select("table_name", "row_count", "column_count")


@query
def table_totals(c):
    """All staged tables in one row; the size is checked to be the sum of the tables' sizes."""
    inventory = staging_inventory({n: c[n] for n in PARQUET_TABLES})
    mb = F.round(inventory.agg(F.sum("size_bytes")).scalar() / (1024 * 1024), 2)
    return inventory_totals(inventory).select("table_count", "total_rows", (F.col("total_size_mb") == mb).alias("size_adds_up"))


@query
def layer_round_trip(c):
    """Write a layer table, replace it with another schema, read the replacement."""
    spark, where = c.spark, new_work_path(c.spark, "layers")
    name = "orders_" + where.rsplit("-", 1)[1]
    write_layer(c["nation"], "tierworks_silver", name, location=where)
    write_layer(c.silver_orders().select("o_orderkey", "o_orderstatus", "is_settled"), "tierworks_silver", name, location=where)
    return read_layer(spark, "tierworks_silver", name)


@query
def append_union(c):
    """A layer table with a second batch appended by name."""
    spark, where = c.spark, new_work_path(c.spark, "layers")
    name = "party_" + where.rsplit("-", 1)[1]
    party = c.silver_party().select("id", "name", "nationkey", "party_type")
    write_layer(party.filter("party_type = 'customer'"), "tierworks_silver", name, location=where)
    append_batch(party.filter("party_type = 'supplier'").select("party_type", "nationkey", "name", "id"), "tierworks_silver", name)
    return read_layer(spark, "tierworks_silver", name)


@query
def stream_append(c):
    """The same append as a file stream that takes what has arrived and stops."""
    spark, where = c.spark, new_work_path(c.spark, "stream")
    source, target = f"{where}/in", f"{where}/out"
    kept = c["orders"].select("o_orderkey", "o_custkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        kept.filter(F.col("o_orderstatus") == status).write.mode("append").parquet(source)
        ingest_new_files(spark, source, kept.schema, target, f"{where}/state")
    return spark.read.parquet(target)


@query
def format_round_trip(c):
    report = format_comparison(c.silver_customer(), new_work_path(c.spark, "formats"))
    return report.select("format", "read_row_count", (F.col("size_bytes") > 0).alias("has_bytes"))


@query
def format_contents(c):
    """What each format gives back of the rows written: counts and sums over several columns."""
    where = new_work_path(c.spark, "formats")
    written = c.silver_customer()
    format_comparison(written, where)
    parts = []
    for fmt in FORMATS:
        back = c.spark.read.schema(written.schema).format(fmt).load(f"{where}/{fmt}")
        parts.append(back.agg(
            F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("key_sum"),
            F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"),
            F.sum(F.length("c_name")).alias("name_length"), F.count_if("is_large").alias("n_large"), F.count_distinct("n_name").alias("n_nations"),
        ))
    return union(*parts)


@serving
def features_sink(c):
    path = predict.write_features(predict.features(c.recap(), c.dim_calendar()), new_work_path(c.spark, "features"))
    return c.spark.read.parquet(path)


@query
def run_layer_report(c):
    """A layer run over several tables, one of which fails: each is written or reported on its own."""
    from tierworks.plans.run import Spec, run_layer

    where = new_work_path(c.spark, "run")
    def missing(_):
        raise ValueError("no such source")

    entries = run_layer(
        c.spark, "tierworks_silver",
        [
            Spec("customer", lambda _: c.silver_customer(), ["raw_customer", "raw_nation"]),
            Spec("orders_status", lambda _: c.silver_orders(), ["raw_orders"]),
            Spec("broken", missing, ["raw_none"]),
        ],
        pipeline="bronze_to_silver", location=where, suffix="_" + where.rsplit("-", 1)[1],
    )
    return entries.select(
        F.regexp_replace("table_name", "_[0-9a-f]{32}$", "").alias("table_name"), "row_count", "written", "error"
    )


@query
def run_graph_report(c):
    """A run in the order of the tables' sources, independent ones at once: one fails, and what rests on it is left out."""
    from tierworks.plans.run import Spec, run_graph

    where = new_work_path(c.spark, "run")
    suffix = "_" + where.rsplit("-", 1)[1]

    def missing(_):
        raise ValueError("no such source")

    def built(name):
        return read_layer(c.spark, "tierworks_silver", name + suffix)

    entries = run_graph(
        c.spark, "tierworks_silver",
        [
            Spec("per_nation", lambda _: built("customers").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")), ["customers"]),
            Spec("customers", lambda _: c.silver_customer(), ["raw_customer"]),
            Spec("of_broken", lambda _: built("broken"), ["broken", "customers"]),
            Spec("orders_status", lambda _: c.silver_orders(), ["raw_orders"]),
            Spec("broken", missing, ["raw_none"]),
        ],
        pipeline="bronze_to_silver", location=where, suffix=suffix,
    )
    return entries.select(F.regexp_replace("table_name", "_[0-9a-f]{32}$", "").alias("table_name"), "row_count", "written", "error")


# ---- profiles and quality ---------------------------------------------------------


def _reviewed(c: Commerce) -> dict[str, DataFrame]:
    """Documents with their (partly missing) labels in three widths, so all gate outcomes occur."""
    wide = c["documents"].join(c["labels"], "doc_id", "left")
    return {
        "doc_full": wide,
        "doc_labels": wide.select("doc_id", "lang", "quality", "toxic"),
        "doc_scores": wide.select("doc_id", "quality", "toxic"),
    }


@query
def profile_orders(c):
    return profile.columns(c["orders"], "orders").drop("data_type")


@query
def profile_sketched(c):
    """The profile of the orders from the sketches of three batches, held against the exact one where it is an estimate."""
    store = sketches.SketchStore(c.spark, new_work_path(c.spark, "sketches"))
    for at, status in enumerate(("F", "O", "P")):
        store.append(c["orders"].filter(F.col("o_orderstatus") == status), "orders", at)
    exact = profile.columns(c["orders"], "orders").select("column_name", F.col("distinct_count").alias("exact"))
    rows = store.profile("orders").join(exact, "column_name")
    close = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.04 * F.col("exact")
    ordered = F.col("low").isNull() | ((F.col("low") <= F.col("p05")) & (F.col("p05") <= F.col("p50")) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("high")))
    return rows.select(
        "table_name", "column_name", "position", "row_count", "null_count", "null_pct", "completeness_pct", close.alias("distinct_is_close"), ordered.alias("is_ordered")
    )


@query
def profile_documents(c):
    return profile.columns(_reviewed(c)["doc_full"], "doc_full").drop("data_type")


@query
def profile_blank_distinct(c):
    return profile.columns(_reviewed(c)["doc_labels"], "doc_labels", blank_is_value=True).drop("data_type")


@query
def profile_tables(c):
    parts = {"doc_full": _reviewed(c)["doc_full"], "customer": c["customer"], "events": c["events"]}
    pii = {"customer": ["c_name"], "doc_full": ["text", "source"]}
    table = profile.table(union(*[profile.completeness(df, n).withColumns(
        {"position": F.lit(1), "data_type": F.lit("string")}) for n, df in parts.items()]), pii)
    return table.select(
        "table_name", "row_count", "column_count", "completeness",
        F.concat_ws("|", F.array_sort("pii_columns")).alias("pii_columns"),
        F.concat_ws("|", F.array_sort(F.map_keys("schema"))).alias("columns"),
    )


def _scores(c: Commerce) -> DataFrame:
    reviewed = _reviewed(c)
    empty = c["customer"].filter("c_custkey IS NULL")
    return union(*[quality.score(df, n) for n, df in reviewed.items()], quality.score(empty, "empty"))


@query
def quality_scores(c):
    return _scores(c).drop("status")


@query
def quality_gate(c):
    return _scores(c).select("table_name", "status")


@query
def quality_gated_rows(c):
    counts = []
    for name, df in _reviewed(c).items():
        kept = quality.gate(df, quality.score(df, name))
        counts.append(kept.groupBy("quality_status").agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name)))
    return union(*counts)


@query
def quality_combined(c):
    both = _scores(c).filter(F.col("table_name").isin("doc_full", "doc_scores"))
    return union(quality.combine(both, "mean of both"), quality.combine(both, "any of both", "any"))


@query
def quality_before_after(c):
    source = _reviewed(c)["doc_labels"]
    cleaned = keep_one(source.withColumn("is_good", F.col("quality") == 1).na.fill(0, ["toxic"]), ["doc_id"])
    return quality.before_after(
        quality.score(source, "doc_labels"), cleaned, "silver_labels",
        ["FLAG is_good", "FILL toxic", "DEDUP on doc_id"], ["doc_labels"],
    )


@query
def quality_report(c):
    return quality.report(_scores(c))


@serving
def gold_profile(c):
    fact = c.fact_kpi1()
    dim = c.dim_nation()
    facts = profile.gold(fact, "fact_kpi1", "fact", ["silver_orders"], kpi.sample(fact, "pct_settled"))
    dims = profile.gold(dim, "dim_nation", "dimension", ["raw_nation", "raw_region"])
    return union(facts, dims).select(
        "table_name", "table_type", "row_count", "column_count", F.size("schema").alias("n_schema"),
        F.concat_ws("|", "sources").alias("sources"),
        F.get_json_object("sample_kpi", "$.nilai_capaian").cast("double").alias("sample_value"),
        F.get_json_object("sample_kpi", "$.status_capaian").alias("sample_status"),
    )


# ---- projections, samples, duplicates ---------------------------------------------


@query
def project_first_columns(c):
    """A join that leaves a column name twice, cut to the first of each and to a whitelist."""
    nation = c["nation"].select("n_nationkey", "n_name", F.col("n_regionkey").alias("c_nationkey"))
    both = c["customer"].join(nation, c["customer"]["c_nationkey"] == nation["n_nationkey"])
    return first_of_duplicate_columns(both, ["c_custkey", "c_nationkey", "n_name", "absent"])


@query
def default_column(c):
    rows = ensure_column(c["supplier"], "status", "Aktif")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def sample_capped(c):
    """How a capped hash sample compares with its table: never above the cap, all rows from the table."""
    picked = sample_rows(c["orders"], 500, ["o_orderkey"])
    back = picked.select("o_orderkey").join(c["orders"].select("o_orderkey"), "o_orderkey", "left_semi")
    return back.agg(
        (F.count(F.lit(1)) <= 500).alias("within_cap"),
        (F.count(F.lit(1)) == F.count_distinct("o_orderkey")).alias("no_repeat"),
    )


@query
def sample_of_a_small_table(c):
    """A cap above the table's rows keeps every row."""
    return sample_rows(c["supplier"], 10_000_000, ["s_suppkey"])


@query
def dedup_by_key(c):
    """One line per (order, line number): the one shipped last, ties by the remaining columns."""
    return keep_one(c["lineitem"], ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate")])


@query
def latest_per_key(c):
    return keep_one(c["orders"], ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")])


@query
def union_normalised(c):
    return c.silver_party().groupBy("party_type", "is_debtor").agg(F.count(F.lit(1)).alias("n"), mean_of("acctbal", 2).alias("avg_acctbal"))


# ---- joins ------------------------------------------------------------------------


@query
def enrich_left_lookup(c):
    ref = c["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup(c["customer"], ref, "c_nationkey").select("c_custkey", "c_nationkey", "n_name")


@query
def supplier_activity_flag(c):
    return c.silver_supplier().select("s_suppkey", "is_active")


@query
def customer_flag_membership(c):
    marked = c.silver_open_orders().filter("is_pressing").select(F.col("o_custkey").alias("c_custkey")).distinct()
    rows = lookup(c["customer"], marked.withColumn("hit", F.lit(True)), "c_custkey")
    return rows.select("c_custkey", F.coalesce("hit", F.lit(False)).alias("has_pressing"))


@query
def activity_any_flags(c):
    return kpi.any_flags(
        c.lines, ["suppkey", "tahun"],
        {"is_returned": F.col("l_returnflag") == "R", "is_final": F.col("l_linestatus") == "F", "is_bulk": F.col("l_quantity") >= 49},
    )


@query
def fact_activity_flags(c):
    flags = activity_any_flags(c)
    rows = lookup(flags, c.supplier_nation, "suppkey", "inner")
    return rows.groupBy("tahun", "nationkey").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).cast("bigint").alias(x) for x in ("is_returned", "is_final", "is_bulk")]
    )


@serving
def fact_ratio_per_head(c):
    return c.fact_kpi5().select("waktu_id", "regionkey", "total_eligible", "total_suppliers", "ratio_per_supplier")


@query
def orphan_key_check(c):
    """Part keys that no line uses, and customers without orders."""
    parts = orphan_keys(c["part"].select(F.col("p_partkey").alias("k")), c["lineitem"], "k", "l_partkey")
    customers = orphan_keys(c["customer"].select(F.col("c_custkey").alias("k")), c["orders"], "k", "o_custkey")
    return union(parts.withColumn("side", F.lit("part")), customers.withColumn("side", F.lit("customer")))


@query
def join_computed_key(c):
    cal = c.dim_calendar()
    fact = c.fact_budget()
    on = (cal["tahun"] == F.floor(fact["waktu_id"] / 100)) & (cal["bulan"] == F.pmod(fact["waktu_id"], F.lit(100)))
    return fact.join(cal.select("tahun", "bulan", "semester"), on).select("tahun", "semester", "persen_realisasi")


@serving
def join_level_dedup(c):
    """A fact per region joined to the region level of the nation dimension: no fan-out."""
    level = one_per_level(c.dim_nation(), ["regionkey", "region"])
    return lookup(c.fact_kpi5(), level, "regionkey", "inner").select("waktu_id", "region", "ratio_per_supplier")


# ---- silver -----------------------------------------------------------------------


@query
def silver_customer(c):
    return c.silver_customer()


@query
def silver_orders_status(c):
    return c.silver_orders()


@query
def silver_supplier(c):
    return c.silver_supplier()


@query
def silver_party_union(c):
    return c.silver_party()


@query
def silver_open_orders(c):
    return c.silver_open_orders()


@query
def silver_latest_valid(c):
    return c.silver_latest_event()


# ---- gold -------------------------------------------------------------------------


@query
def dim_calendar(c):
    return c.dim_calendar()


@query
def dim_nation(c):
    return c.dim_nation()


@query
def dim_supplier(c):
    return c.dim_supplier()


@query
def dim_customer(c):
    return c.dim_customer()


@query
def dim_topic(c):
    """The literal topic table with the parts of each topic."""
    topics = literal_table(c.spark, TOPICS, "topic_id int, topic string, description string")
    used = c["part"].groupBy(F.col("p_type").alias("topic")).agg(F.count(F.lit(1)).alias("n_parts"))
    return lookup(used, topics, "topic").select("topic", "topic_id", "description", "n_parts")


@query
def fact_outcome_by_year(c):
    orders = c.silver_orders().withColumn("tahun", F.year("o_orderdate"))
    return kpi.share_fact(
        orders, ["tahun"], "total", {"filled": F.col("is_filled"), "open": F.col("is_open"), "rest": ~F.col("is_settled")},
        ["filled", "open"], "pct_settled",
    )


@query
def fact_kpi1(c):
    return no_id(c.fact_kpi1())


@query
def fact_kpi2(c):
    return no_id(c.fact_kpi2())


@query
def fact_kpi3(c):
    return no_id(c.fact_kpi3())


@query
def fact_kpi3_all_heads(c):
    return no_id(c.fact_kpi3("all"))


@query
def fact_kpi4(c):
    return no_id(c.fact_kpi4())


@query
def fact_kpi4_any(c):
    return no_id(c.fact_kpi4("any"))


@query
def fact_kpi5(c):
    return no_id(c.fact_kpi5())


@query
def fact_kpi6(c):
    return no_id(c.fact_kpi6())


@query
def fact_kpi7(c):
    return no_id(c.fact_kpi7())


@query
def fact_kpi8(c):
    return no_id(c.fact_kpi8())


@query
def fact_share_of_entities(c):
    """The same share with the qualifying rows of each year only."""
    hits = c["orders"].filter("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("y")
    )
    return kpi.entity_share_by_year(
        c["customer"].select(F.col("c_custkey").alias("custkey")), hits, "custkey",
        "total_customers", "customers_met", "pct_met", TARGETS["KPI-6"], year="y",
    )


@query
def fact_budget(c):
    return no_id(c.fact_budget())


@query
def fact_keys_unique(c):
    """Rows and distinct surrogate keys of each fact."""
    facts = {
        "kpi1": c.fact_kpi1(), "kpi2": c.fact_kpi2(), "kpi3": c.fact_kpi3(), "kpi4": c.fact_kpi4(), "kpi5": c.fact_kpi5(),
        "kpi6": c.fact_kpi6(), "kpi7": c.fact_kpi7(), "kpi8": c.fact_kpi8(), "budget": c.fact_budget(),
    }
    return union(*[
        f.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("fact_id").alias("n_keys")).withColumn("fact", F.lit(n))
        for n, f in facts.items()
    ])


@query
def kpi_targets(c):
    """The target table beside the years that occur; a year without a target keeps NULL."""
    years = c["orders"].select(F.year("o_orderdate").alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n_orders"))
    wanted = years.withColumn("kpi", F.explode(F.array(*[F.lit(k) for k in TARGETS])))
    table = kpi.targets(c.spark, TARGETS)
    return wanted.join(table, ["kpi", "year"], "left")


@serving
def kpi_status(c):
    fact = c.fact_kpi7()
    return fact.select(
        "waktu_id", "nationkey", quota_status("pct_met", F.lit(72.0)).alias("status"),
        F.coalesce(quota_status("pct_met", "target_iku"), F.lit("no target")).alias("status_own"),
    )


@serving
def kpi_sample(c):
    parts = [("fact_kpi1", c.fact_kpi1(), "pct_settled", "%"), ("fact_kpi5", c.fact_kpi5(), "ratio_per_supplier", "Rasio"),
             ("fact_kpi7", c.fact_kpi7(), "pct_met", "%")]
    return union(*[kpi.sample(f, v, u).withColumn("table_name", F.lit(n)) for n, f, v, u in parts])


@query
def kpi_recap(c):
    return c.recap()


# ---- facts refreshed by batches ----------------------------------------------------


def _refreshed(name: str) -> None:
    """Register a fact built from its first rows and refreshed batch by batch; it equals the fact built from all rows."""
    QUERIES["refresh_" + name.removeprefix("fact_")] = lambda spark, directory: no_id(getattr(RefreshedGold(spark, directory), name)())


for _fact in (*(f"fact_kpi{i}" for i in range(1, 9)), "fact_budget"):
    _refreshed(_fact)


def refreshed(fn: Callable[[RefreshedGold], DataFrame]) -> Callable[[RefreshedGold], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, directory: fn(RefreshedGold(spark, directory))
    return fn


@refreshed
def refresh_recap(c):
    return c.recap()


@refreshed
def refresh_changes(c):
    """What the second batch of lines changed in the counts of lines by year and nation."""
    return c.change("lines", "kpi7", 2)


# ---- serving views ----------------------------------------------------------------

RECAP_COLUMNS = ["tahun", "iku_kode", "iku_nama", "nilai_capaian", "nilai_target", "satuan", "status_capaian"]


@serving
def v_recap_year(c):
    return olap.star(c.recap(), {"waktu_id": c.dim_calendar()}).select(*RECAP_COLUMNS).orderBy("tahun", "iku_kode")


@serving
def v_kpi4_by_org(c):
    rows = olap.star(c.fact_kpi4(), {"nationkey": c.dim_nation()})
    return rows.select(
        "nationkey", "nation", "regionkey", "region", "total_suppliers", "suppliers_premium", "suppliers_solvent",
        "pct_met", "target_iku", "capaian_iku",
    ).orderBy(F.desc("pct_met"), "nationkey")


@serving
def v_budget_year(c):
    return olap.star(c.fact_budget(), {"waktu_id": c.dim_calendar()}).select(
        "tahun", "predikat_sakip", "nilai_sakip", "pagu_total", "realisasi_total", "persen_realisasi", "target_kinerja_anggaran"
    ).orderBy("tahun")


@serving
def kpi_subset_union(c):
    """Yearly means of single facts, for use where the recap is missing."""
    cal = c.dim_calendar()
    parts = []
    for code, fact in (("KPI-4", c.fact_kpi4()), ("KPI-6", c.fact_kpi6())):
        joined = olap.star(fact, {"waktu_id": cal})
        parts.append(
            joined.groupBy("tahun").agg(mean_of("pct_met").alias("nilai_capaian"), mean_of("target_iku").alias("nilai_target"))
            .withColumn("iku_kode", F.lit(code))
        )
    return union(*parts).orderBy("tahun", "iku_kode")


@serving
def rollup_region_year(c):
    rows = olap.star(c.fact_kpi7(), {"nationkey": c.dim_nation(), "waktu_id": c.dim_calendar()})
    return olap.rollup(rows, ["regionkey", "region", "tahun"], {"pct_met": olap.SEMI_ADDITIVE}).orderBy("tahun", "regionkey")


@serving
def rollup_avg(c):
    """The three classes of measures rolled up to the region."""
    rows = olap.star(c.fact_kpi1(), {"nationkey": c.dim_nation()})
    return olap.rollup(
        rows, ["region"],
        {"total_orders": olap.ADDITIVE, "orders_filled": olap.ADDITIVE, "pct_settled": olap.SEMI_ADDITIVE, "capaian_iku": olap.NON_ADDITIVE},
    )


@serving
def rollup_recomputed(c):
    """Percentages recomputed from the counts along year > region, with subtotals and the total."""
    rows = olap.star(c.fact_kpi1(), {"nationkey": c.dim_nation()})
    rows = rows.withColumn("met", F.col("orders_filled") + F.col("orders_open"))
    return olap.rollup_share(rows, ["waktu_id", "region"], "met", "total_orders", "pct_settled").withColumn("depth", F.col("depth").cast("int"))


@query
def entity_census(c):
    return olap.census({n: c[n] for n in ("customer", "supplier", "part", "nation", "region")})


@serving
def v_kpi_by_org_year(c):
    """Drill-down of every KPI fact: per nation, per region, or institution-wide, by year."""
    cal, nation = c.dim_calendar(), c.dim_nation()
    region = one_per_level(nation, ["regionkey", "region"])
    parts = []
    for code, fact, value in (("KPI-1", c.fact_kpi1(), "pct_settled"), ("KPI-2", c.fact_kpi2(), "pct_met"),
                              ("KPI-3", c.fact_kpi3(), "pct_met"), ("KPI-7", c.fact_kpi7(), "pct_met")):
        parts.append((code, olap.star(fact, {"nationkey": nation, "waktu_id": cal}), F.col("nation"), value))
    parts.append(("KPI-5", olap.star(c.fact_kpi5(), {"regionkey": region, "waktu_id": cal}), F.col("region"), "ratio_per_supplier"))
    for code, fact in (("KPI-6", c.fact_kpi6()), ("KPI-8", c.fact_kpi8())):
        parts.append((code, olap.star(fact, {"waktu_id": cal}), F.lit("all"), "pct_met"))
    return union(*[
        df.select(F.lit(code).alias("iku_kode"), "tahun", org.alias("org"), F.col(value).alias("value"), "target_iku", "capaian_iku")
        for code, df, org, value in parts
    ])


@serving
def drilldown_vs_institution(c):
    rows = olap.star(c.fact_kpi7(), {"nationkey": c.dim_nation()})
    return olap.against_overall(rows, ["nation", "region"], "pct_met")


def _cube(c: StoredGold) -> Lattice:
    """The counts of the first KPI by year, region and nation and all coarser levels in use, built once in an application."""
    key = (c.spark.sparkContext.applicationId, c.directory)
    if key not in CUBES:
        rows = olap.star(c.fact_kpi1(), {"nationkey": c.dim_nation()})
        share = F.col("pct_settled").cast("decimal(28,4)")
        rows = rows.select(
            F.floor(F.col("waktu_id") / 100).cast("int").alias("tahun"), "region", "nation", "total_orders", "orders_filled",
            (F.col("orders_filled") + F.col("orders_open")).alias("met"), share.alias("pct_sum"), F.when(share.isNotNull(), 1).otherwise(0).cast("bigint").alias("pct_rows"),
            F.col("capaian_iku").alias("max_capaian_iku"),
        )
        CUBES[key] = Lattice.build(
            rows, new_work_path(c.spark, "cube"), [("tahun", "region", "nation"), ("tahun", "region"), ("region",), ("tahun",), ()],
            {n: "max" if n.startswith("max") else "sum" for n in rows.columns[3:]},
        )
    return CUBES[key]


@serving
def cube_rollup(c):
    """The measures rolled up to the region, from the smallest stored level that has it."""
    mean = half_up(F.col("pct_sum").cast("double") / F.col("pct_rows"), 4)
    return _cube(c).answer(["region"]).select("region", "total_orders", "orders_filled", mean.alias("avg_pct_settled"), "max_capaian_iku")


@serving
def cube_subtotals(c):
    """Percentages along year > region with subtotals and the total, each from its own stored level."""
    rows = _cube(c).rollup(["tahun", "region"])
    return rows.select(
        period_id("tahun").alias("waktu_id"), "region", "met", "total_orders", F.col("depth").cast("int").alias("depth"), percent("met", "total_orders").alias("pct_settled")
    )


@serving
def cube_dice(c):
    rows = _cube(c).answer(["tahun", "region", "nation"], {"tahun": 1999, "region": "ASIA"})
    return rows.select("tahun", "region", "nation", "total_orders", percent("met", "total_orders").alias("pct_settled"))


@serving
def cube_pivot(c):
    """Share of settled orders, regions against years."""
    return _cube(c).pivot(["region"], "tahun", [1995, 1996, 1997], percent("met", "total_orders"))


@serving
def slice_year(c):
    return no_id(olap.dice(olap.star(c.fact_kpi1(), {"waktu_id": c.dim_calendar()}), tahun=1997)).select("tahun", "nationkey", "pct_settled")


@serving
def dice_year_region(c):
    rows = olap.star(c.fact_kpi1(), {"waktu_id": c.dim_calendar(), "nationkey": c.dim_nation()})
    return olap.dice(rows, tahun=1999, region="ASIA").select("tahun", "region", "nation", "total_orders", "pct_settled")


@serving
def pivot_year_kpi(c):
    rows = olap.star(c.recap(), {"waktu_id": c.dim_calendar()})
    return olap.pivot(rows, ["tahun"], "iku_kode", list(TARGETS), "nilai_capaian")


@serving
def key_range(c):
    return olap.key_range({"budget": c.fact_budget(), "calendar": c.dim_calendar(), "recap": c.recap()}, "waktu_id")


@query
def star_diagnosis(c):
    checks = olap.check_star(c["orders"].select("o_custkey"), c["customer"].select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return checks.withColumn("value", F.col("value").cast("bigint"))


@query
def scenario_parity(c):
    """The same layer built with run-time re-planning off and on holds the same rows."""
    spark, where, tables = c.spark, new_work_path(c.spark, "scenario"), {}
    name = "fact_" + where.rsplit("-", 1)[1]
    for label in ("OFF", "ON"):
        with scenario.settings(spark, scenario.aqe_conf(label)):
            write_layer(c.fact_kpi1(), "tierworks_gold", name, scenario=label, location=where)
        tables[label] = read_layer(spark, "tierworks_gold", name, scenario=label)
    return olap.parity(tables["OFF"], tables["ON"])


@query
def scenario_fingerprint(c):
    """The same two tables told equal from fingerprints, without a shuffle of their rows."""
    spark, where, tables = c.spark, new_work_path(c.spark, "scenario"), []
    name = "customer_" + where.rsplit("-", 1)[1]
    for label in ("OFF", "ON"):
        with scenario.settings(spark, scenario.aqe_conf(label)):
            write_layer(c.silver_customer(), "tierworks_silver", name, scenario=label, location=where)
        tables.append(read_layer(spark, "tierworks_silver", name, scenario=label))
    return olap.same_rows(*tables)


@serving
def v_forecast(c):
    rows = forecast_drift(c)
    return rows.select(
        "tahun", "nilai_capaian", F.when(F.col("is_forecast") == 1, "forecast").otherwise("actual").alias("series_type")
    ).orderBy("tahun")


@serving
def v_actual_vs_target(c):
    rows = olap.star(c.recap(), {"waktu_id": c.dim_calendar()})
    return olap.filtered(rows, F.col("iku_kode") == "KPI-4", "tahun").select(
        "tahun", "iku_kode", F.col("nilai_capaian").alias("actual"), F.col("nilai_target").alias("target")
    )


# ---- workloads, skew, scenarios ---------------------------------------------------


def _nation_keys(c: Commerce) -> tuple[DataFrame, DataFrame]:
    customers = c["customer"].select(F.col("c_nationkey").alias("nationkey"))
    return customers, c["supplier"].select(F.col("s_nationkey").alias("nationkey"))


@query
def w1_skew_join(c):
    """Rows a many-to-many join on the nation would yield, per nation, from the two counts."""
    return matched_pairs(*_nation_keys(c), "nationkey").withColumn("cnt", F.col("cnt").cast("bigint"))


@query
def w1_skew_rows(c):
    """The rows that W1 counts, popular nations dealt over cells of the join."""
    return skewed_join(
        c["customer"].select(F.col("c_nationkey").alias("nationkey"), "c_custkey"), c["supplier"].select(F.col("s_nationkey").alias("nationkey"), "s_suppkey"), "nationkey"
    )


@query
def w2_group_agg(c):
    return c["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), mean_of("c_acctbal", 2).alias("avg_acctbal"))


@query
def w3_filter_join(c):
    ref = c["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup(c["customer"].filter("c_acctbal >= 5000").select("c_custkey", "c_nationkey"), ref, "c_nationkey")


@serving
def w4_fact_dim_join(c):
    return olap.star(c.fact_kpi1(), {"nationkey": c.dim_nation()}).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@serving
def w5_recap_by_year(c):
    return olap.star(c.recap(), {"waktu_id": c.dim_calendar()}).groupBy("tahun").agg(mean_of("nilai_capaian").alias("avg_value"))


@serving
def w6_recap_status(c):
    return c.recap().filter(F.col("status_capaian") == "Tidak Tercapai").select("iku_kode", "status_capaian", "nilai_capaian")


WORKLOADS = [
    ("W1", "join", w1_skew_join), ("W2", "aggregation", w2_group_agg), ("W3", "filtering", w3_filter_join),
    ("W4", "join", w4_fact_dim_join), ("W5", "aggregation", w5_recap_by_year), ("W6", "filtering", w6_recap_status),
]


def workloads(c: Commerce, *wanted: str) -> list[scenario.Workload]:
    return [scenario.Workload(i, fn.__name__, kind, fn(c)) for i, kind, fn in WORKLOADS if not wanted or i in wanted]


@query
def timed_workloads(c):
    """The cleaning-layer workloads timed under every component profile; the seconds are left out here."""
    listed = workloads(c, "W1", "W2", "W3")
    runs = [scenario.run_workloads(c.spark, listed, p) for p in scenario.PROFILES]
    return union(*runs).select("scenario", "workload_id", "workload_type", "row_count", "status")


@query
def key_skew(c):
    return skew.key_skew_of([
        ("customer", c["customer"], "c_nationkey"), ("orders", c["orders"], "o_custkey"),
        ("lineitem", c["lineitem"], "l_partkey"), ("documents", c["documents"], "lang"),
    ])


@query
def top_keys(c):
    return skew.top_keys(c["lineitem"], "l_partkey")


@query
def partition_rows(c):
    spread = c["orders"].repartition(8, "o_custkey")
    return skew.partition_rows(spread).agg(F.sum("row_count").cast("bigint").alias("row_count"), (F.count(F.lit(1)) <= 8).alias("spread"))


@query
def skew_injected_counts(c):
    """Rows at the hot key after sending 75 % of them there, against the table's rows."""
    hot = skew.inject_skew(c["orders"], "o_custkey", 7, 0.75, ["o_orderkey"])
    share = F.count_if(F.col("o_custkey") == 7) / F.count(F.lit(1))
    return hot.agg(F.count(F.lit(1)).alias("n"), F.when(share.between(0.7, 0.8), "about 75 %").otherwise("off").alias("share"))


@query
def workload_compare(c):
    return scenario.compare(assets.workload_runs(c["events"], "OFF"), assets.workload_runs(c["events"], "ON"))


@query
def speedup_throughput(c):
    """Per customer: spending of 1996 against 1997 as a saving, and rows per spent unit."""
    spent = F.col("o_totalprice").cast("decimal(18,2)")
    y = F.year("o_orderdate")
    per = c["orders"].groupBy("o_custkey").agg(
        F.sum(F.when(y == 1996, spent)).cast("double").alias("base"),
        F.sum(F.when(y == 1997, spent)).cast("double").alias("other"), F.count(F.lit(1)).alias("n"),
    )
    return per.select("o_custkey", scenario.speedup("base", "other").alias("speedup_pct"), scenario.throughput("n", F.col("base") / 1000).alias("per_1000"))


# ---- prediction -------------------------------------------------------------------


@query
def ml_preflight(c):
    """Which of the star tables exist as tables, with their rows."""
    spark, where = c.spark, new_work_path(c.spark, "preflight")
    name = "dim_" + where.rsplit("-", 1)[1]
    full = write_layer(c.dim_customer(), "tierworks_gold", name, location=where)
    found = predict.preflight(spark, [full, "tierworks_gold.not_there"])
    return found.select(F.when(F.col("found"), "dim_customer").otherwise("not_there").alias("table_name"), "found", "row_count")


@serving
def ml_features(c):
    return predict.features(c.recap(), c.dim_calendar(), lags=2)


@serving
def forecast_drift(c):
    rows = olap.star(c.recap(), {"waktu_id": c.dim_calendar()})
    return predict.forecast_drift(rows, "tahun", "nilai_capaian")


@serving
def forecast_trend(c):
    return predict.forecast_trend(predict.features(c.recap(), c.dim_calendar()), ["iku_code"], "tahun", "nilai_capaian")


def _fitted(c: Commerce) -> DataFrame:
    rows = c.fact_kpi7().withColumn("tahun", F.floor(F.col("waktu_id") / 100).cast("int"))
    return predict.fit_values(rows.select("nationkey", "tahun", "pct_met"), ["nationkey"], "tahun", "pct_met", 2)


@serving
def forecast_metrics(c):
    return predict.forecast_metrics(_fitted(c), "pct_met", "fitted", ["nationkey"])


@serving
def risk_label(c):
    return c.fact_kpi7().select("waktu_id", "nationkey", predict.risk_label("pct_met", F.lit(72.0)).alias("risk_label"))


RISK_COLUMNS = ["c_acctbal", "n_orders", "n_pressing", "spent"]


def _risk_rows(c: Commerce) -> DataFrame:
    """Every customer with features from their orders, and whether they settled less than the target share.

    A customer without orders has zero counts and no label.

    Kept as a feature table: training and scoring read it several times.
    """
    status = F.col("o_orderstatus")
    per = c["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("n_pressing"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"),
        percent(F.count_if(status.isin("F", "O")), F.count(F.lit(1))).alias("pct_settled"),
    )
    rows = lookup(c["customer"].select("c_custkey", "c_nationkey", "c_acctbal"), per, "c_custkey")
    rows = rows.fillna(0, ["n_orders", "n_pressing"]).fillna(0.0, ["spent"])
    rows = rows.withColumn("risk_label", predict.risk_label("pct_settled", F.lit(66.0)))
    rows = predict.stratified_split(rows, ["c_custkey"], "risk_label")
    return c.spark.read.parquet(predict.write_features(rows, new_work_path(c.spark, "risk-features")))


@query
def risk_scores(c):
    """Score of every customer from the forest trained on the training rows."""
    rows = _risk_rows(c)
    model = predict.train_risk(rows, RISK_COLUMNS, "risk_label")
    return predict.score_risk(model, rows, RISK_COLUMNS).select("c_custkey", "c_nationkey", "risk_label", "risk_score", "is_train")


@query
def risk_features(c):
    """What the risk model sees: features and label of every customer."""
    return _risk_rows(c).select("c_custkey", *RISK_COLUMNS, "risk_label")


@query
def risk_split(c):
    """Which customers the risk model is trained on: four in five of each class, to one row."""
    return _risk_rows(c).select("c_custkey", "risk_label", "is_train")


@query
def risk_coverage(c):
    """Customers, labelled ones, and scores of the model that are missing or out of range."""
    return risk_scores(c).agg(
        F.count(F.lit(1)).alias("n_customers"), F.count("risk_label").alias("n_labelled"),
        F.count_if(F.col("risk_score").isNull()).alias("n_unscored"), F.count_if(~F.col("risk_score").between(0, 100)).alias("n_out_of_range"),
    )


def _by_rule(c: Commerce) -> DataFrame:
    """The labelled customers with a score that is no model's: the share of their pressing orders."""
    rows = _risk_rows(c).filter("risk_label IS NOT NULL")
    rows = rows.withColumn("risk_score", percent("n_pressing", "n_orders"))
    return rows.withColumn("prediction", (F.col("risk_score") >= 40).cast("double"))


@query
def rule_metrics(c):
    """The metrics of a fixed score, so that each has a counterpart in SQL."""
    measured = predict.class_metrics(_by_rule(c), "risk_label")
    return predict.catalog_of_models(c.spark, {"rule": measured}).withColumn("value", half_up("value", 6))


@query
def rule_confusion(c):
    return predict.confusion(_by_rule(c), "risk_label")


@query
def class_metrics(c):
    rows = _risk_rows(c)
    model = predict.train_risk(rows, RISK_COLUMNS, "risk_label")
    held_out = predict.score_risk(model, rows.filter("NOT is_train"), RISK_COLUMNS)
    measured = predict.class_metrics(held_out, "risk_label")
    return predict.catalog_of_models(c.spark, {"risk_score": measured})


@query
def confusion_matrix(c):
    rows = _risk_rows(c)
    model = predict.train_risk(rows, RISK_COLUMNS, "risk_label")
    return predict.confusion(predict.score_risk(model, rows.filter("NOT is_train"), RISK_COLUMNS), "risk_label")


@serving
def v_risk(c):
    """Mean risk per nation beside its name, highest first."""
    per = risk_scores(c).groupBy(F.col("c_nationkey").alias("nationkey")).agg(mean_of("risk_score", 2).alias("risk_score"))
    return lookup(per, c.dim_nation(), "nationkey").select("nationkey", "nation", "region", "risk_score").orderBy(F.desc("risk_score"), "nationkey")


def _opportunity(c: Commerce) -> tuple[DataFrame, dict[int, float]]:
    per = {
        "kpi1": (c.fact_kpi1(), "pct_settled"), "kpi3": (c.fact_kpi3(), "pct_met"),
        "kpi4": (c.fact_kpi4(), "pct_met"), "kpi7": (c.fact_kpi7(), "pct_met"),
    }
    means = [f.groupBy("nationkey").agg(mean_of(v).alias(n)) for n, (f, v) in per.items()]
    vectors = reduce(lambda a, b: a.join(b, "nationkey", "left"), means, c.dim_nation().select("nationkey"))
    return predict.opportunity(vectors, "nationkey", list(per))


@serving
def opportunity_scores(c):
    """The score alone: distance of the scaled KPI vector from the best corner."""
    return _opportunity(c)[0].drop("cluster")


@serving
def cluster_quality(c):
    """Silhouette of each number of clusters tried, and the one chosen."""
    quality = _opportunity(c)[1]
    best = max(quality, key=lambda k: (quality[k], -k), default=None)
    return literal_table(c.spark, [(k, q, k == best) for k, q in quality.items()], "k int, silhouette double, chosen boolean")


@serving
def v_opportunity(c):
    """Nations clustered by their KPI values and scored."""
    rows = lookup(_opportunity(c)[0], c.dim_nation(), "nationkey", "inner")
    return rows.select("nationkey", "nation", "region", "cluster", "opportunity_score").orderBy(F.desc("opportunity_score"), "nationkey")


@query
def anomaly_z(c):
    flagged = predict.anomaly_z(c["events"].select("event_id", "event_type", "value"), "event_type", "value")
    return flagged.filter("is_anomaly = 1").select("event_id", "event_type", "value", "is_anomaly", half_up("z", 2).alias("z"))


@query
def anomaly_rate(c):
    return predict.anomaly_summary(predict.anomaly_z(c["events"].select("event_type", "value"), "event_type", "value"), ["event_type"])


@serving
def anomaly_residual(c):
    flagged = predict.anomaly_residual(_fitted(c), ["nationkey"], "pct_met", "fitted")
    return flagged.select("nationkey", "tahun", half_up("residual", 2).alias("residual"), "is_anomaly")


@serving
def insight_long(c):
    """Inferred values replace a section's defaults; the anomaly section is updated key by key."""
    def lines(df, section, entity, **metrics):
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(v).cast("double").alias("value")) for m, v in metrics.items()])
        return df.select(F.when(entity.isNotNull(), section).alias("section"), entity.cast("string").alias("entity"), F.explode(pairs).alias("m")).select("section", "entity", "m.*")

    types = c["events"].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("low"))
    defaults = union(
        lines(types, "risk_score", F.col("event_type"), default="low"),
        lines(types, "anomaly", F.col("event_type"), total="n", anomaly_count="low"),
        lines(types, "opportunity", F.col("event_type"), default="low"),
    )
    inferred = union(
        lines(anomaly_rate(c), "anomaly", F.col("event_type"), anomaly_count="anomaly_count", rate="anomaly_rate_pct"),
        lines(c.fact_kpi4(), "risk_score", F.col("nationkey"), value="pct_met"),
    )
    return predict.insight_long(defaults, inferred)


# ---- catalog ----------------------------------------------------------------------


def _assets(c: Commerce) -> DataFrame:
    return assets.document_assets(c["documents"], c["labels"])


def _links(c: Commerce) -> DataFrame:
    return assets.trade_links(c["nation"], c["customer"], c["orders"])


@query
def catalog_entities(c):
    """Catalog records of the pipeline's own tables, from their profiles."""
    spark = c.spark
    built = [
        ("bronze", c["customer"], "raw_customer", None), ("bronze", c["orders"], "raw_orders", None),
        ("silver", c.silver_customer(), "silver_customer", None), ("silver", c.silver_orders(), "silver_orders", None),
        ("gold", c.dim_nation(), "dim_nation", "dimension"), ("gold", c.fact_kpi1(), "fact_kpi1", "fact"),
    ]
    parts = []
    for layer, df, name, kind in built:
        p = profile.completeness(df, name).withColumns({"position": F.lit(1), "data_type": F.lit("string")})
        row = profile.table(p, {"raw_customer": ["c_name"], "silver_customer": ["c_name"]})
        parts.append(row.withColumns({
            "layer": F.lit(layer), "table_type": F.lit(kind).cast("string"), "quality_score": F.col("completeness"),
            "quality_status": quality.status("completeness", "row_count"),
        }))
    meta = literal_table(
        spark,
        [
            ("silver_customer", "Cleaned customers", "sales", ["Prodi"], [], None, None, None, {"contains_pii": "true"}, None),
            ("fact_kpi1", None, None, [], [], "KPI-1", KPI_NAMES["KPI-1"], "settled / all", None, {"dashboard_panel": "executive"}),
        ],
        "table_name string, description string, owner string, glossary_terms array<string>, iku_relevance array<string>, "
        "iku_code string, iku_nama string, formula string, compliance map<string,string>, consumption map<string,string>",
    )
    rows = catalog.dataset_rows(union(*parts), meta, assets.STORE, "warehouse", "2024-06-30T00:00:00Z")
    return rows.select(
        "guid", "qualifiedName", "description", "format", "location", "row_count", "column_count", "pii_columns",
        F.concat_ws("|", "classifications").alias("classifications"),
        F.get_json_object("profiling", "$.business.owner").alias("owner"),
        F.get_json_object("profiling", "$.kpi.iku_code").alias("iku_code"),
    )


@query
def catalog_tags(c):
    return _assets(c).select("qualifiedName", F.concat_ws("|", "classifications").alias("classifications"))


@query
def lineage_edges(c):
    return lineage.edges(assets.document_specs(c["documents"]), assets.STORE)


@query
def umt(c):
    rows = catalog.umt(_assets(c))
    return rows.select(
        "asset_qualified_name", "layer", "technical.row_count", "technical.format",
        F.size("technical.schema").alias("n_schema"), "business.owner", F.size("business.glossary_terms").alias("n_terms"),
        F.concat_ws("|", "operational.classifications").alias("classifications"), "last_enriched_at",
    )


@query
def umt_filled(c):
    """Gaps filled from the staging summary, the bronze sibling and the layer defaults."""
    # Every document's table also exists as a staging file and in bronze.
    raw = F.concat(F.lit("raw_"), F.col("doc_id").cast("string"))
    summary = c["documents"].select(
        raw.alias("table_name"), (F.col("n_chars") + 1).alias("row_count"), F.lit(5).alias("column_count"),
        F.concat(raw, F.lit(".csv")).alias("file"),
    )
    bronze = c["documents"].select(
        F.md5(raw).alias("guid"),
        F.concat(F.lit("bronze.raw_"), F.col("doc_id").cast("string"), F.lit("@shadow")).alias("qualifiedName"),
        raw.alias("name"), F.lit("bronze").alias("layer"), F.lit("orc").alias("format"),
        (F.col("n_chars") + 2).alias("row_count"), F.lit(7).alias("column_count"),
        F.lit('{"a":"string"}').alias("schema_def"), F.lit('["a"]').alias("pii_columns"),
    )
    own = _assets(c).filter(F.coalesce(F.col("layer"), F.lit("")) != "bronze")
    own = own.filter(~F.startswith(F.col("qualifiedName"), F.lit("bronze.")))
    entities = own.unionByName(bronze, allowMissingColumns=True)
    rows = catalog.umt_fill(catalog.umt(entities, ordered=False), summary, "Commerce Lakehouse")
    return rows.select(
        "asset_qualified_name", "layer", "technical.row_count", "technical.column_count", "technical.format", "technical.location",
        F.size("technical.schema").alias("n_schema"), F.concat_ws("|", "technical.pii_columns").alias("pii_columns"),
        "business.owner", "business.domain", "business.update_frequency",
    )


@query
def catalog_normalise(c):
    """Attribute lists with mixed spellings to one spelling."""
    def pair(name, value):
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    odd = F.pmod(F.col("doc_id"), F.lit(2)) == 1
    rows = c["documents"].select(
        "doc_id",
        F.array(
            pair("rowCount", F.col("n_chars")),
            F.struct(F.when(odd, "row_count").alias("name"), (F.col("n_chars") + 1).cast("string").alias("value")),
            pair("qualified_name", F.col("source")), pair("lang", F.lit("first")), pair("lang", F.col("lang")),
        ).alias("attributes"),
    )
    a = F.col("attributes")
    return catalog.normalise(rows).select(
        "doc_id", F.try_element_at(a, F.lit("row_count")).alias("row_count"), F.try_element_at(a, F.lit("qualifiedName")).alias("qualified"),
        F.try_element_at(a, F.lit("lang")).alias("lang"), F.size(a).alias("n_attributes"),
    )


def _versions(c: Commerce) -> tuple[DataFrame, DataFrame]:
    def side(df, key, name, version, tag):
        return df.select(
            F.concat(F.lit(tag), F.col(key).cast("string")).alias("guid"),
            F.concat(F.lit("asset_"), F.col(key).cast("string")).alias("qualifiedName"),
            F.col(name).alias("description"), version.alias("version"),
        )

    return (
        side(c["customer"], "c_custkey", "c_name", F.pmod(F.col("c_custkey"), F.lit(5)), "c"),
        side(c["supplier"], "s_suppkey", "s_name", F.pmod(F.col("s_suppkey"), F.lit(3)) + 1, "s"),
    )


@query
def catalog_upsert(c):
    return catalog.upsert(*_versions(c))


@query
def catalog_upsert_stored(c):
    """The same upsert into a stored table, of which only the slices that hold new keys are rewritten."""
    old, new = _versions(c)
    where = new_work_path(c.spark, "assets")
    table = SlicedTable(c.spark, "tierworks_silver", "assets_" + where.rsplit("-", 1)[1], ("qualifiedName",), where)
    table.create(old)
    catalog.upsert_stored(table, new, 1)
    return table.read()


@query
def catalog_merge(c):
    """Three result lists, the last one winning per guid."""
    def stubs(df, key, name):
        return df.select(F.concat(F.lit("g"), F.col(key).cast("string")).alias("guid"), F.col(name).alias("name"))

    return catalog.merge_lists([
        stubs(c["part"], "p_partkey", "p_name"), stubs(c["customer"], "c_custkey", "c_name"), stubs(c["supplier"], "s_suppkey", "s_name"),
    ])


@query
def meta_quality(c):
    return catalog.quality(_assets(c), assets.AS_OF).drop("guid")


@query
def meta_quality_by_layer(c):
    return catalog.quality_by_layer(catalog.quality(_assets(c), assets.AS_OF))


@query
def meta_coverage(c):
    return catalog.coverage(_assets(c))


@query
def lineage_completeness(c):
    links = _links(c)
    return lineage.completeness(assets.trade_assets(c["nation"], c["customer"], c["orders"]), links)


@query
def catalog_counts(c):
    return catalog.counts(_assets(c), lineage.edges(assets.document_specs(c["documents"]), assets.STORE).select("process", "pipeline_name").distinct())


@query
def catalog_search(c):
    found = union(
        catalog.search(_assets(c), text="MBKM", layer="silver", limit=20, offset=5).withColumn("page", F.lit("text")),
        catalog.search(_assets(c), classification="Star_Schema_Dimension", limit=15).withColumn("page", F.lit("tag")),
    )
    return found.select("page", "qualifiedName", "name")


def _asset_index(c: Commerce) -> TextIndex:
    """The index of the assets' texts, built once in an application."""
    key = (c.spark.sparkContext.applicationId, c.directory)
    if key not in INDEXES:
        INDEXES[key] = catalog.index_assets(_assets(c), new_work_path(c.spark, "asset-index"))
    return INDEXES[key]


@query
def catalog_search_paged(c):
    """The same pages from the stored index; a page begins after the last name of the one before."""
    index = _asset_index(c)
    before = [r["qualifiedName"] for r in catalog.search_page(index, "MBKM", layer="silver", limit=5).select("qualifiedName").collect()]
    second = catalog.search_page(index, "MBKM", layer="silver", limit=20, after=max(before, default=None))
    tagged = catalog.search_page(index, classification="Star_Schema_Dimension", limit=15)
    return union(second.withColumn("page", F.lit("text")), tagged.withColumn("page", F.lit("tag"))).select("page", "qualifiedName", "name")


@query
def catalog_search_terms(c):
    """How many assets hold each of some texts, long, short, in the middle of words and in none."""
    index = _asset_index(c)
    found = [index.holding(t).agg(F.count(F.lit(1)).alias("n_assets")).select(F.lit(t).alias("looked_for"), "n_assets") for t in assets.LOOKED_FOR]
    return union(*found)


@query
def glossary_links_indexed(c):
    """The same links, the terms being rows that meet the postings of the index."""
    rows = [(t, a) for t in assets.LINK_TERMS for a in assets.LINK_ALIASES.get(t.lower(), (t.lower(),))]
    return glossary.link_indexed(c.spark.createDataFrame(rows, "term string, alias string"), _asset_index(c))


@query
def glossary_links_many(c):
    """Every table's name as a term of its own, linked to all assets whose text holds it."""
    names = _assets(c).select(F.col("name").alias("term"), F.col("name").alias("alias"))
    return glossary.link_indexed(names, _asset_index(c)).groupBy("term").agg(F.count(F.lit(1)).alias("n_assets"), F.min("asset").alias("first_asset"))


@query
def glossary_terms(c):
    return glossary.terms_of(_assets(c), assets.TERM_DEFINITIONS, "Term from metadata: ")


@query
def glossary_summary(c):
    return glossary.summary(glossary.terms_of(_assets(c), assets.TERM_DEFINITIONS, "Term from metadata: "))


@query
def glossary_merged(c):
    local = literal_table(c.spark, assets.LOCAL_TERMS, glossary.TERM)
    meta = glossary.summary(glossary.terms_of(_assets(c), assets.TERM_DEFINITIONS, "Term from metadata: "))
    from_catalog = c["part"].groupBy("p_type").agg(F.min("p_partkey").alias("k")).select(
        F.when(F.col("p_type") == "PROMO", "prodi").otherwise(F.col("p_type")).alias("term"),
        F.when(F.col("p_type") != "PROMO", F.concat(F.lit("Parts of type "), "p_type")).alias("definition"),
        F.when(F.col("p_type") == "LARGE", "").otherwise("Parts").alias("category"),
        F.col("k").cast("string").alias("guid"),
    )
    return glossary.merge(local, meta, from_catalog)


@query
def glossary_links(c):
    return glossary.link_terms(assets.LINK_TERMS, _assets(c), assets.LINK_ALIASES)


@query
def kpi_cards(c):
    return catalog.kpi_cards(_assets(c), assets.KPI_CARDS).drop("formula")


@query
def star_counts(c):
    return catalog.star_counts(_assets(c))


@query
def lineage_closure(c):
    """Everything below each region, and everything above each order, within three steps."""
    links = _links(c).select("src", "dst")
    regions = c["nation"].select(assets._node("staging", "region", "n_regionkey").alias("node"))
    orders = c["orders"].select(assets._node("gold", "order", "o_orderkey").alias("node"))
    down = lineage.trace(links, regions, 3, "down")
    return down.unionByName(lineage.trace(links, orders, 3, "up"))


@query
def lineage_rings(c):
    """The customers of a nation and segment, each leading to the next by number and the last to the first, followed to the end."""
    ring = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = c["customer"].select(
        F.col("c_custkey").alias("src"), F.min("c_custkey").over(whole).alias("first"), F.lead("c_custkey").over(ring).alias("after")
    )
    links = rows.select("src", F.coalesce("after", "first").alias("dst"))
    return lineage.trace(links, rows.where("src = first").select(F.col("src").alias("node")), None, "down")


@query
def lineage_labels(c):
    """Display name and layer of every process and asset of the lineage."""
    edges = lineage.edges(assets.document_specs(c["documents"]), assets.STORE)
    processes = edges.select(F.col("process").alias("node"), "pipeline_name", F.lit(True).alias("is_process")).distinct()
    data = edges.select(F.col("dst").alias("node"), F.lit(None).cast("string").alias("pipeline_name"), F.lit(False).alias("is_process")).distinct()
    rows = processes.unionByName(data)
    return rows.select(
        "node", lineage.node_label(F.col("pipeline_name"), F.col("node"), F.col("is_process")).alias("label"),
        lineage.node_layer(F.col("pipeline_name"), F.lit(None).cast("string"), F.col("node"), F.col("is_process")).alias("layer"),
    )


@query
def lifecycle_stage(c):
    stage, zone = catalog.lifecycle(F.coalesce(F.col("layer"), F.lit("unknown")), F.col("classifications"))
    return _assets(c).select("qualifiedName", stage.alias("stage"), zone.alias("zone"))


@query
def profile_shape(c):
    """Column statistics read from both places they are stored in."""
    stat = F.struct(
        F.col("n_chars").alias("null_count"), F.lit(0.5).alias("null_pct"), F.lit(99.5).alias("completeness_pct"), F.col("doc_id").alias("distinct_count")
    )
    odd = F.pmod(F.col("doc_id"), F.lit(2)) == 1
    graded = F.struct(F.struct(F.lit(88.5).alias("source_score"), F.col("lang").alias("source_status")).alias("quality"), F.create_map(F.lit("text"), stat).alias("columns"))
    rows = c["documents"].select("doc_id", F.when(odd, F.to_json(graded)).otherwise(F.to_json(F.struct(stat.alias("text")))).alias("profiling"))
    return catalog.profile_shape(rows)


# ---- run ledger -------------------------------------------------------------------


def _runs(c: Commerce) -> DataFrame:
    return ledger.record(assets.run_entries(c["events"]))


@query
def ledger_record(c):
    return _runs(c).drop("started_at", "ended_at")


@query
def ledger_latest(c):
    return ledger.latest(_runs(c)).select("pipeline", "scenario", "run_id", "duration_sec", "tables_written", "rows_written")


@query
def ledger_summary(c):
    return ledger.summary(_runs(c))


@query
def ledger_runs(c):
    return ledger.runs_index(_runs(c)).drop("started_at", "ended_at")


@query
def ledger_artifacts(c):
    return ledger.artifacts(assets.run_entries(c["events"]))


@query
def metrics_long(c):
    return ledger.long_metrics(
        ledger.latest(_runs(c), ["track", "scenario"]), {"run": "run_id", "pipeline": "pipeline", "aqe_scenario": "scenario"},
        {"pipeline_duration_seconds": "duration_sec", "rows_written": "rows_written", "accuracy": F.col("tables_written") / F.col("tables_total"),
         "mae": F.when(F.col("tables_total") > 1, F.col("tables_total"))},
    ).withColumn("value", half_up("value", 4))


@query
def metrics_exposition(c):
    """The same rows as text lines of the metrics format."""
    long = ledger.long_metrics(_runs(c), {"run": "run_id", "pipeline": "pipeline"}, {"tables": "tables_total"})
    return ledger.exposition(long, ["run", "pipeline"])


@query
def silver_run_summary(c):
    runs = union(assets.workload_runs(c["events"], "OFF"), assets.workload_runs(c["events"], "ON"))
    return ledger.silver_summary(_runs(c), runs, key_skew(c)).drop("run_id")


# ---- whole runs -------------------------------------------------------------------


@serving
def flagship(c):
    """Order outcome share by nation and year against target, with status."""
    rows = olap.star(c.fact_kpi1(), {"nationkey": c.dim_nation(), "waktu_id": c.dim_calendar()})
    return rows.select(
        "tahun", "region", "nation", "total_orders", "pct_settled", "target_iku", "capaian_iku",
        quota_status("pct_settled", "target_iku").alias("status"),
    ).orderBy("tahun", "nation")


__all__ = ["QUERIES", "workloads"]
