"""Catalog, lineage and glossary on small inline tables."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierworks.operators import catalog, glossary, lineage
from tierworks.session import shared_dir

AS_OF = "2024-07-01 00:00:00"


def entities(spark, *given):
    """Entities with sound defaults; each argument overrides some attributes."""
    out = []
    for i, g in enumerate(given):
        e = dict(
            guid=f"g{i}", qualifiedName="bronze.raw_a@store", name="raw_a", description="d", layer="bronze", format="parquet",
            location="warehouse/bronze/raw_a", row_count=3, column_count=1, schema_def='{"a":"string"}', profiling="{}",
            pii_columns="[]", ingested_at="2024-06-30T00:00:00Z", enriched_at=None, classifications=["Bronze_Layer"],
        )
        e.update(g)
        out.append(tuple(e.values()))
    return spark.createDataFrame(out, catalog.ENTITY)


def score(spark, **given):
    return catalog.quality(entities(spark, given), AS_OF).first()


@pytest.mark.parametrize(
    "day, want",
    [("2024-06-24", 100), ("2024-06-01", 90), ("2024-04-02", 75), ("2024-01-03", 60), ("2024-01-02", 40), (None, 0), ("x", 0)],
)
def test_age_limits(spark, day, want):
    stamp = None if day is None else (day if day == "x" else f"{day}T00:00:00Z")
    assert score(spark, ingested_at=stamp)["timeliness"] == want


def layer_scores(spark, layer, sound, odd):
    tag = f"{layer.capitalize()}_Layer"
    good = dict(qualifiedName=f"{layer}.t@store", layer=layer, location=f"w/{layer}/t", classifications=[tag])
    other = dict(qualifiedName="staging.t@store", layer="staging", location="w/staging/t", classifications=[tag])
    df = catalog.quality(entities(spark, *[good] * sound, *[other] * odd), AS_OF)
    got = {r["layer"]: r for r in catalog.quality_by_layer(df).collect()}
    return got[layer]


def test_worked_consistency_examples(spark):
    bronze, silver, gold = layer_scores(spark, "bronze", 15, 12), layer_scores(spark, "silver", 6, 5), layer_scores(spark, "gold", 15, 0)
    assert (bronze["entity_count"], bronze["consistency"], bronze["consistency_1_5"]) == (27, 64, 3)
    assert (silver["entity_count"], silver["consistency"], silver["consistency_1_5"]) == (11, 64, 3)
    assert (gold["entity_count"], gold["consistency"], gold["consistency_1_5"]) == (15, 100, 5)


def test_layer_without_entities_and_even_ties(spark):
    none = layer_scores(spark, "bronze", 1, 0)
    assert none["completeness"] == 100
    empty = {r["layer"]: r for r in catalog.quality_by_layer(catalog.quality(entities(spark, {}), AS_OF)).collect()}["gold"]
    assert (empty["entity_count"], empty["accuracy"], empty["accuracy_1_5"]) == (0, 0, 1)
    scale = spark.createDataFrame([(50,), (70,), (0,), (100,)], "p int").select(catalog.scale_1_5(F.col("p")))
    assert [r[0] for r in scale.collect()] == [2, 4, 1, 5]


@pytest.mark.parametrize(
    "layer, given, want",
    [
        ("bronze", {"schema_def": "{}"}, 0), ("bronze", {"schema_def": "broken"}, 0), ("bronze", {"row_count": -1}, 0), ("bronze", {}, 95),
        ("silver", {"profiling": {"quality": {"overall_score": 99.6}}}, 100),
        ("silver", {"profiling": {"quality": {"overall_score": 0, "source_score": 71.4}}}, 71),
        ("silver", {"profiling": {"quality": {"quality_score": 0}}}, 0),
        ("silver", {"profiling": {"quality": {"source_status": "PASS"}}}, 90),
        ("silver", {"profiling": {"quality": {"source_status": "QUARANTINE"}}}, 70),
        ("silver", {}, 85), ("gold", {}, 75),
        ("gold", {"profiling": {"star_schema": {"table_type": "fact"}}}, 92), ("gold", {"profiling": {"kpi": {"iku_code": "K"}}}, 92),
    ],
)
def test_accuracy_list(spark, layer, given, want):
    given = dict(given)
    if "profiling" in given:
        given["profiling"] = json.dumps(given["profiling"])
    got = score(spark, layer=layer, qualifiedName=f"{layer}.t@s", classifications=[f"{layer.capitalize()}_Layer"], **given)
    assert got["accuracy"] == want


def test_completeness_by_layer(spark):
    full = json.dumps({"business": {"owner": "o", "glossary_terms": ["t"]}, "quality": {"source_status": "PASS"}, "compliance": {"contains_pii": True}})
    assert score(spark)["completeness"] == 100
    assert score(spark, description="  ", location="null")["completeness"] == 78
    silver = dict(layer="silver", qualifiedName="silver.t@s", classifications=["Silver_Layer"])
    assert score(spark, **silver)["completeness"] == 69
    assert score(spark, **silver, profiling=full)["completeness"] == 100


def test_tags(spark):
    df = spark.createDataFrame(
        [("silver", "PASS", True, None), ("silver", "REJECT", False, None), ("gold", None, True, "dimension"), ("gold", None, False, None), ("bronze", "PASS", True, None)],
        "layer string, status string, has_pii boolean, table_type string",
    )
    assert [r["classifications"] for r in catalog.classify(df).collect()] == [
        ["Silver_Layer", "Quality_Pass", "PII"], ["Silver_Layer"], ["Gold_Layer", "Star_Schema_Dimension"],
        ["Gold_Layer", "Star_Schema_Fact", "KPI_Metric", "Executive_Dashboard"], ["Bronze_Layer", "PII"],
    ]


def test_fill_prefers_own_then_summary_then_sibling(spark):
    df = entities(
        spark,
        {"qualifiedName": "staging.raw_a@store", "layer": "staging", "row_count": None, "column_count": None, "schema_def": "", "format": " ", "location": None},
        {"qualifiedName": "bronze.raw_a@store", "row_count": 9, "column_count": 4, "pii_columns": '["a"]'},
        {"qualifiedName": "silver.silver_a@store", "layer": "silver", "row_count": None, "column_count": 2, "location": "", "schema_def": None},
        {"qualifiedName": "gold.dim_a@store", "layer": "gold", "row_count": 0},
    )
    summary = spark.createDataFrame([("raw_a", 7, 3, "raw_a.csv")], "table_name string, row_count bigint, column_count int, file string")
    got = {r["layer"]: r for r in catalog.umt_fill(catalog.umt(df), summary, "Campus").collect()}
    t = got["staging"]["technical"]
    assert (t["row_count"], t["column_count"], t["format"], t["location"], t["schema"]) == (7, 3, "csv", "staging/raw_a.csv", {"a": "string"})
    s = got["silver"]["technical"]
    assert (s["row_count"], s["column_count"], s["location"], s["pii_columns"]) == (9, 2, "warehouse/bronze/raw_a", ["a"])
    g = got["gold"]
    assert g["technical"]["row_count"] == 0 and g["business"]["owner"] == "Biro Akademik & Perencanaan" and g["business"]["consumption"] == {}
    assert got["silver"]["business"]["domain"] == "Campus" and got["silver"]["business"]["consumption"] is None


def test_umt_order(spark):
    names = ["gold.a", "zzz", "staging.b", "silver.c", "bronze.d", "bronze.a"]
    df = entities(spark, *[{"qualifiedName": n, "layer": None} for n in names])
    assert [r["asset_qualified_name"] for r in catalog.umt(df).collect()] == ["staging.b", "bronze.a", "bronze.d", "silver.c", "gold.a", "zzz"]


def test_normalise_list_and_map(spark):
    df = spark.createDataFrame([([("schema", "s"), ("rowCount", "1"), ("x", "a"), ("x", "b"), (None, "n")],)], "attributes array<struct<name:string,value:string>>")
    assert catalog.normalise(df).first()[0] == {"schema": "s", "rowCount": "1", "x": "b", "schema_def": "s", "row_count": "1"}
    as_map = spark.createDataFrame([({"row_count": "5", "rowCount": "1"},)], "attributes map<string,string>")
    assert catalog.normalise(as_map).first()[0] == {"row_count": "5", "rowCount": "1"}


def test_upsert_keeps_the_first_guid(spark):
    shape = "guid string, qualifiedName string, body string, version int"
    old = spark.createDataFrame([("g1", "a", "old", 3), ("g2", "b", "old", 1)], shape)
    new = spark.createDataFrame([("g9", "a", "new", 3), ("g8", "b", "stale", 0), ("g7", "c", "new", 1)], shape)
    assert rows(catalog.upsert(old, new)) == [("g1", "a", "new", 3), ("g2", "b", "old", 1), ("g7", "c", "new", 1)]


def test_edges_skip_what_is_no_dataset(spark):
    specs = spark.createDataFrame(
        [("silver_to_gold", "gold", "fact_x", ["silver_a", "raw_b", "all_iku_facts"]), ("silver_to_gold", "gold", "dim_t", ["generated"]),
         ("staging_to_bronze", "bronze", "raw_b", ["raw_b"]), ("bronze_to_silver", "silver", "silver_a", ["raw_b"])],
        "pipeline string, target_layer string, table_name string, sources array<string>",
    )
    got = rows(lineage.edges(specs, "store").select("src", "dst"))
    assert got == [
        ("bronze.raw_b@store", "gold.fact_x@store"), ("bronze.raw_b@store", "silver.silver_a@store"),
        ("silver.silver_a@store", "gold.fact_x@store"), ("staging.raw_b@store", "bronze.raw_b@store"),
    ]


@pytest.mark.parametrize("cut", [1, 2, 9])
def test_trace_ends_in_cycles_and_keeps_least_depth(spark, cut):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    down = rows(lineage.trace(links, start, 5, "down", cut).select("node", "depth"))
    assert down == [("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert rows(lineage.trace(links, start, 1).select("direction", "node")) == [("down", "b"), ("down", "c"), ("up", "c")]
    assert shared_dir(spark)


def test_trace_through_a_hot_node(spark):
    links = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("src"), F.concat(F.lit("m"), F.col("id")).alias("dst")
    )
    got = lineage.trace(links, spark.createDataFrame([("hub",)], "node string"), 3, "down")
    assert got.count() == 1000


def test_glossary(spark):
    def prof(**kw):
        return json.dumps(kw)

    df = entities(
        spark,
        {"qualifiedName": "silver.a", "layer": "silver", "profiling": prof(business={"glossary_terms": ["MBKM", "MBKM", "New"]})},
        {"qualifiedName": "silver.b", "layer": "silver", "profiling": prof(business={"glossary_terms": ["MBKM", "K-1"]})},
        {"qualifiedName": "gold.f", "layer": "gold", "profiling": prof(kpi={"iku_code": "K-1", "iku_nama": "first"})},
    )
    terms = glossary.terms_of(df, {"MBKM": ("credits", "Academic")}, "Term: ")
    assert rows(terms.select("term", "definition", "source", "asset")) == [
        ("K-1", "first", "gold_metadata", "gold.f"), ("MBKM", "credits", "silver_metadata", "silver.a"),
        ("MBKM", "credits", "silver_metadata", "silver.b"), ("New", "Term: New", "silver_metadata", "silver.a"),
    ]
    local = spark.createDataFrame([("mbkm", "l", "L"), ("Only", "l", "L")], glossary.TERM)
    remote = spark.createDataFrame([("NEW", "", "", "g1"), ("Extra", None, None, "g2")], glossary.TERM + ", guid string")
    merged = {r["key"]: r for r in glossary.merge(local, glossary.summary(terms), remote).collect()}
    assert (merged["mbkm"]["term"], merged["mbkm"]["source"]) == ("MBKM", "silver_metadata")
    assert (merged["new"]["definition"], merged["new"]["source"], merged["new"]["guid"]) == ("Term: New", "atlas", "g1")
    assert (merged["extra"]["definition"], merged["extra"]["category"]) == ("", "Atlas")
    assert merged["only"]["source"] == "local"


def test_links_take_the_first_by_name(spark):
    df = entities(spark, *[{"qualifiedName": f"gold.dim_{i}", "layer": "gold"} for i in range(9)])
    got = glossary.link_terms(["Star Schema", "zz"], df, {"star schema": ("dim_",)}, first=6)
    assert [r["asset"] for r in got.orderBy("position").collect()] == [f"gold.dim_{i}" for i in range(6)]
    assert glossary.link_terms(["Star Schema", "zz"], df, {"star schema": ("dim_",)}).count() == 9
    short = entities(spark, {"qualifiedName": "gold.fr_sales", "layer": "gold"}, {"qualifiedName": "gold.africa", "layer": "gold"})
    assert [r["asset"] for r in glossary.link_terms(["fr"], short, {}).collect()] == ["gold.fr_sales"]


def test_cards_search_and_lifecycle(spark):
    df = entities(
        spark,
        {"qualifiedName": "gold.fact_k1@s", "name": "fact_k1", "layer": "gold", "row_count": 5, "classifications": ["Gold_Layer"],
         "profiling": json.dumps({"kpi": {"iku_code": "K-1", "nilai_capaian": 40.5, "satuan": ""}, "star_schema": {"table_type": "fact"}})},
        {"qualifiedName": "bronze.raw_a@s", "classifications": ["Bronze_Layer", "Quality_Pass"]},
    )
    cards = {r["code"]: r for r in catalog.kpi_cards(df, {"K-1": ("one", "fact_k1", 50), "K-5": ("five", "fact_k5", 0.25)}).collect()}
    assert (cards["K-1"]["registered"], cards["K-1"]["value"], cards["K-1"]["target"], cards["K-1"]["unit"]) == (True, 40.5, 50.0, "%")
    assert (cards["K-5"]["registered"], cards["K-5"]["row_count"], cards["K-5"]["unit"]) == (False, 0, "Rasio")
    assert catalog.search(df, text="K-1").count() == 1 and catalog.search(df, layer="bronze", classification="Gold_Layer").count() == 0
    assert catalog.search(df, limit=1, offset=1).first()["qualifiedName"] == "gold.fact_k1@s"
    stage, zone = catalog.lifecycle(F.col("layer"), F.col("classifications"))
    assert rows(df.select(stage, zone)) == [(13, "Production"), (9, "Enrichment")]
