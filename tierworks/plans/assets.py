"""Catalog entities, lineage and run records derived from the given tables, so they grow with them.

Every document is an asset: its source number decides the layer, its language the
owner and terms, its labels the quality block. Region, nation, customer and order
form the lineage. Events are the table entries of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierworks.functions.names import qualified_name
from tierworks.operators import catalog

STORE = "store"
AS_OF = "2024-07-01T00:00:00Z"
SCHEMA_TEXT = '{"doc_id":"bigint","text":"string"}'

TERM_DEFINITIONS = {
    "MBKM": ("Study credits earned outside the home programme", "Academic"),
    "PII": ("Data that can identify a person", "Security"),
    "Prodi": ("Study programme", "Academic"),
}
TERMS_BY_LANG = {"en": ["MBKM", "Prodi"], "fr": ["PII"], "de": ["Prodi", "Reporting"]}
LOCAL_TERMS = [
    ("Star Schema", "Facts and dimensions for OLAP", "Technical"),
    ("Data Lineage", "Trace from source to use", "Governance"),
    ("mbkm", "Local wording", "Business"),
]
# Words that link a curated term to assets.
LINK_ALIASES = {
    "star schema": ("dim_", "fact_", "gold."),
    "medallion architecture": ("bronze.", "silver.", "gold.", "staging."),
    "data quality score": ("quality", "quarantine", "silver_"),
    "pii": ("pii", "pii_columns"),
}
LINK_TERMS = ("Star Schema", "Medallion Architecture", "Data Quality Score", "PII", "fr")
LOOKED_FOR = ("silver_1", "document in", "R_1", "kpi-", "é", "is", "no such text", "@")
KPI_CARDS = {
    f"KPI-{i}": (f"Indicator {i}", f"fact_kpi{i}", goal)
    for i, goal in enumerate((78, 35, 25, 50, 0.25, 60, 40, 3.0), start=1)
}


def _mod(n: int) -> Column:
    return F.pmod(F.col("doc_id"), F.lit(n))


def document_assets(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One catalog entity per document."""
    doc = F.col("doc_id").cast("string")
    number = F.substr(F.col("source"), F.lit(4)).cast("int")
    layer = F.element_at(
        F.array(*[F.lit(x) for x in ("staging", "bronze", "silver", "gold")]), F.col("__slot") + 1
    )
    role = F.when(_mod(3) == 0, "dimension").otherwise("fact")
    kpi_no = (_mod(8) + 1).cast("string")
    rows = (
        documents.select("doc_id", "lang", "source", "n_chars")
        .join(labels, "doc_id", "left")
        .withColumn("__slot", F.pmod(number, F.lit(5)))
        .withColumn("at", F.when(F.col("__slot") < 4, layer))
        .withColumn("table_type", F.when(F.col("at") == "gold", role))
        .withColumn(
            "table",
            F.when(F.col("at").isin("staging", "bronze"), F.concat(F.lit("raw_"), doc))
            .when(F.col("at") == "silver", F.concat(F.lit("silver_"), doc))
            .when(F.col("table_type") == "dimension", F.concat(F.lit("dim_"), doc))
            .when(F.col("table_type") == "fact", F.concat(F.lit("fact_kpi"), kpi_no, F.lit("_"), doc))
            .otherwise(F.concat(F.lit("misc_"), doc)),
        )
    )
    at, silver, gold = F.col("at"), F.col("at") == "silver", F.col("at") == "gold"
    stamp = F.concat(
        F.date_format(F.date_sub(F.lit("2024-06-30").cast("date"), F.pmod(F.col("doc_id") * 7919, F.lit(400)).cast("int")), "yyyy-MM-dd"),
        F.lit("T00:00:00Z"),
    )
    none = F.array().cast("array<string>")
    terms = F.coalesce(*[F.when(F.col("lang") == k, F.array(*[F.lit(t) for t in v])) for k, v in TERMS_BY_LANG.items()], none)
    status = F.when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "QUARANTINE")
    has_kpi = gold & (F.col("table_type") == "fact") & (F.col("quality") == 1)
    profiling = F.to_json(
        F.struct(
            F.struct(F.when(F.col("lang") != "es", F.col("lang")).alias("owner"), terms.alias("glossary_terms")).alias("business"),
            F.when(
                silver & status.isNotNull(),
                F.struct(F.when(F.col("quality") == 1, F.lit(87.4)).alias("overall_score"), status.alias("source_status")),
            ).alias("quality"),
            F.when(silver & F.col("toxic").isNotNull(), F.create_map(F.lit("contains_pii"), (F.col("toxic") == 1).cast("string"))).alias("compliance"),
            F.when(gold & (_mod(5) != 1), F.struct("table_type")).alias("star_schema"),
            F.when(
                has_kpi,
                F.struct(
                    F.concat(F.lit("KPI-"), kpi_no).alias("iku_code"),
                    F.concat(F.lit("Indicator "), kpi_no).alias("iku_nama"),
                    (F.col("n_chars") / F.lit(100.0)).alias("nilai_capaian"),
                    F.when(_mod(2) == 0, F.lit(50.0)).alias("nilai_target"),
                ),
            ).alias("kpi"),
            F.when(gold & F.col("quality").isNotNull(), F.create_map(F.lit("dashboard_panel"), F.col("lang"))).alias("consumption"),
        )
    )
    tagged_as = F.when((at == "staging") & (_mod(3) == 0), "bronze").otherwise(F.coalesce(at, F.lit("other")))
    return rows.select(
        F.md5(doc).alias("guid"),
        qualified_name(F.coalesce(at, F.lit("other")), F.col("table"), STORE).alias("qualifiedName"),
        F.col("table").alias("name"),
        F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("Document in "), F.col("lang"))).alias("description"),
        F.when(_mod(7) != 0, at).alias("layer"),
        F.when(at == "staging", "csv").otherwise("parquet").alias("format"),
        F.when(_mod(11) == 0, "").otherwise(F.concat_ws("/", F.lit("warehouse"), at, F.col("table"))).alias("location"),
        F.when(_mod(13) == 0, F.lit(-1)).when(_mod(17) == 0, F.lit(None)).otherwise(F.col("n_chars")).cast("bigint").alias("row_count"),
        F.when(_mod(17) != 0, F.lit(2)).alias("column_count"),
        F.when(_mod(23) == 0, "not json").when(_mod(5) == 0, "{}").otherwise(SCHEMA_TEXT).alias("schema_def"),
        profiling.alias("profiling"),
        F.when(F.col("toxic") == 1, '["text"]').otherwise("[]").alias("pii_columns"),
        F.when(_mod(29) != 0, stamp).alias("ingested_at"),
        F.when((silver | gold) & (_mod(4) != 0), stamp).alias("enriched_at"),
        catalog.tags(tagged_as, status, F.col("toxic") == 1, F.col("table_type")).alias("classifications"),
    )


def document_specs(documents: DataFrame) -> DataFrame:
    """Which sources each derived document table was built from."""
    doc = F.col("doc_id").cast("string")
    slot = F.pmod(F.substr(F.col("source"), F.lit(4)).cast("int"), F.lit(5))
    target = F.when(slot == 1, "bronze").when(slot == 2, "silver").when(slot == 3, "gold")
    after = (F.col("doc_id") + 1).cast("string")
    raw = F.concat(F.lit("raw_"), doc)
    sources = (
        F.when(slot == 1, F.array(raw))
        .when(slot == 2, F.array(raw, F.concat(F.lit("raw_"), after)))
        .when(_mod(2) == 0, F.array(F.concat(F.lit("silver_"), doc), raw, F.lit("all_iku_facts")))
        .otherwise(F.array(F.lit("generated")))
    )
    pipeline = (
        F.when(slot == 1, "staging_to_bronze").when(slot == 2, "bronze_to_silver").otherwise("silver_to_gold")
    )
    prefix = F.when(slot == 1, "raw_").when(slot == 2, "silver_").otherwise("fact_")
    return documents.select("doc_id", "source").filter(target.isNotNull()).select(
        pipeline.alias("pipeline"), target.alias("target_layer"), F.concat(prefix, doc).alias("table_name"), sources.alias("sources")
    )


def _node(layer: str, kind: str, key: str) -> Column:
    return qualified_name(F.lit(layer), F.concat(F.lit(kind + "_"), F.col(key).cast("string")), STORE)


def trade_links(nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    """region -> nation -> customer -> order as (src, dst, pipeline_name)."""
    region, country = _node("staging", "region", "n_regionkey"), _node("bronze", "nation", "n_nationkey")
    return (
        nation.select(region.alias("src"), country.alias("dst"), F.lit("staging_to_bronze").alias("pipeline_name"))
        .unionByName(
            customer.select(
                _node("bronze", "nation", "c_nationkey").alias("src"), _node("silver", "customer", "c_custkey").alias("dst"),
                F.lit("bronze_to_silver").alias("pipeline_name"),
            )
        )
        .unionByName(
            orders.select(
                _node("silver", "customer", "o_custkey").alias("src"), _node("gold", "order", "o_orderkey").alias("dst"),
                F.lit("silver_to_gold").alias("pipeline_name"),
            )
        )
    )


def trade_assets(nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    """The nodes of :func:`trade_links` above staging, as (qualifiedName, layer)."""
    return (
        nation.select(_node("bronze", "nation", "n_nationkey").alias("qualifiedName"), F.lit("bronze").alias("layer"))
        .unionByName(customer.select(_node("silver", "customer", "c_custkey").alias("qualifiedName"), F.lit("silver").alias("layer")))
        .unionByName(orders.select(_node("gold", "order", "o_orderkey").alias("qualifiedName"), F.lit(None).cast("string").alias("layer")))
    )


PIPELINES = ("staging_to_bronze", "bronze_to_silver", "silver_to_gold")


def run_entries(events: DataFrame) -> DataFrame:
    """Every event is one table of a run; a user's day is a run."""
    day = F.to_date("ts")
    user = F.col("user_id")
    return events.select(
        F.concat_ws("-", F.lit("run"), user.cast("string"), F.date_format(day, "yyyyMMdd")).alias("run_id"),
        F.element_at(F.array(*[F.lit(p) for p in PIPELINES]), (F.pmod(user, F.lit(3)) + 1).cast("int")).alias("pipeline"),
        F.when(F.pmod(F.day(day), F.lit(2)) == 0, "ON").otherwise("OFF").alias("scenario"),
        F.element_at(F.array(*[F.lit(p) for p in ("aqe", "metadata", "mlops")]), (F.pmod(user, F.lit(3)) + 1).cast("int")).alias("track"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("ended_at"),
        F.col("event_type").alias("table_name"),
        F.floor(F.col("value") * 10).cast("bigint").alias("row_count"),
        (F.col("event_type") != "error").alias("written"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )


def workload_runs(events: DataFrame, scenario: str) -> DataFrame:
    """Mean event value per type on the scenario's days, as the seconds of a workload."""
    parity = 0 if scenario == "ON" else 1
    rows = events.filter(F.pmod(F.day("ts"), F.lit(2)) == parity)
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return rows.groupBy(F.col("event_type").alias("workload_id")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round((total / F.count(F.lit(1))).cast("decimal(38,10)"), 3).cast("double").alias("duration_sec"),
    ).select(
        F.lit(scenario).alias("scenario"), "workload_id", F.concat(F.lit("events_"), "workload_id").alias("name"),
        F.lit("aggregation").alias("workload_type"), "duration_sec", "row_count",
    )
