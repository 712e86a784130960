"""The metadata catalog as table jobs: entities, tags, unified metadata, scores, coverage, search.

An entity is one row of :data:`ENTITY`; the nested blocks travel as JSON text, as
catalogs store them, and are parsed once by :func:`parsed`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierworks.functions import code_lookup, percent
from tierworks.functions.names import LAYERS, layer_of, layer_position, qualified_name, table_part
from tierworks.operators.textindex import TextIndex
from tierworks.sources.slices import SlicedTable

ENTITY = (
    "guid string, qualifiedName string, name string, description string, layer string, format string, "
    "location string, row_count bigint, column_count int, schema_def string, profiling string, "
    "pii_columns string, ingested_at string, enriched_at string, classifications array<string>"
)

PROFILING = (
    "business struct<owner:string,domain:string,glossary_terms:array<string>,iku_relevance:array<string>,"
    "update_frequency:string>,"
    "quality struct<overall_score:double,source_score:double,score:double,quality_score:double,"
    "source_status:string,status:string,silver_completeness:double>,"
    "compliance map<string,string>,"
    "star_schema struct<table_type:string,olap_role:string>,"
    "kpi struct<iku_code:string,iku_nama:string,formula:string,satuan:string,nilai_capaian:double,"
    "nilai_target:double,status_capaian:string>,"
    "consumption map<string,string>,"
    "ai_metadata map<string,string>,"
    "transformations array<string>,"
    "profiled_at string"
)

# Other spellings of an attribute.
ALIASES = {
    "row_count": ("rowCount",),
    "column_count": ("columnCount",),
    "schema_def": ("schemaDef", "schema"),
    "pii_columns": ("piiColumns",),
    "ingested_at": ("ingestedAt",),
    "enriched_at": ("enrichedAt",),
    "qualifiedName": ("qualified_name",),
}

# Business defaults of a layer.
LAYER_OWNER = {
    "staging": "Tim Data Ingestion",
    "bronze": "data-platform",
    "silver": "data-governance",
    "gold": "Biro Akademik & Perencanaan",
}
LAYER_REFRESH = {
    "staging": "batch (per upload CSV)",
    "bronze": "batch",
    "silver": "batch",
    "gold": "harian (OLAP refresh)",
}


# ---- records and tags -------------------------------------------------------------


def layer_tag(layer: Column) -> Column:
    return F.concat(F.initcap(layer), F.lit("_Layer"))


def tags(layer: Column, status: Column, has_pii: Column, table_type: Column) -> Column:
    """Classification of a dataset from its layer, quality status, personal data and star-schema role."""
    gold = layer == "gold"
    fact = gold & ~(F.coalesce(table_type, F.lit("fact")) == "dimension")
    pii_layer = layer.isin("bronze", "silver")
    rules = [
        layer_tag(layer),
        F.when((layer == "silver") & (status == "PASS"), "Quality_Pass"),
        F.when((layer == "silver") & (status == "QUARANTINE"), "Quality_Quarantine"),
        F.when(pii_layer & has_pii, "PII"),
        F.when(gold & ~fact, "Star_Schema_Dimension"),
        F.when(fact, "Star_Schema_Fact"),
        F.when(fact, "KPI_Metric"),
        F.when(fact, "Executive_Dashboard"),
    ]
    return F.array_compact(F.array(*rules))


def classify(df: DataFrame) -> DataFrame:
    """Add ``classifications`` to rows of (layer, status, has_pii, table_type)."""
    return df.withColumn(
        "classifications", tags(F.col("layer"), F.col("status"), F.col("has_pii"), F.col("table_type"))
    )


def dataset_rows(profiles: DataFrame, meta: DataFrame, store: str, base: str, stamped_at: str) -> DataFrame:
    """Catalog records from table profiles and per-table metadata.

    ``profiles``: layer, table_name, row_count, column_count, schema (map), pii_columns,
    quality_score, quality_status, table_type. ``meta``: table_name, description, owner,
    glossary_terms, iku_relevance, iku_code, iku_nama, formula, compliance, consumption.
    """
    p = profiles.join(meta, "table_name", "left")
    layer, table = F.col("layer"), F.col("table_name")
    rank = layer_position(layer)
    curated = rank >= F.lit(LAYERS.index("silver") + 1)
    gold = layer == "gold"
    has_kpi = gold & F.col("iku_code").isNotNull()

    def when(test: Column, value: Column) -> Column:
        return F.when(test, value)

    blocks = F.struct(
        F.struct(
            F.coalesce(F.col("owner"), code_lookup("layer", LAYER_OWNER)).alias("owner"),
            F.lit(store).alias("domain"),
            F.coalesce(F.col("glossary_terms"), F.array().cast("array<string>")).alias("glossary_terms"),
            F.when(has_kpi, F.array("iku_code")).otherwise(
                F.coalesce(F.col("iku_relevance"), F.array().cast("array<string>"))
            ).alias("iku_relevance"),
            code_lookup("layer", LAYER_REFRESH).alias("update_frequency"),
        ).alias("business"),
        when(
            layer == "silver",
            F.struct(F.col("quality_score").alias("source_score"), F.col("quality_status").alias("source_status")),
        ).alias("quality"),
        when(layer == "silver", F.col("compliance")).alias("compliance"),
        when(gold, F.struct(F.coalesce("table_type", F.lit("fact")).alias("table_type"))).alias("star_schema"),
        when(has_kpi, F.struct("iku_code", "iku_nama", "formula")).alias("kpi"),
        when(gold, F.col("consumption")).alias("consumption"),
        when(
            gold,
            F.create_map(
                F.lit("ml_ready"), (F.col("table_type") == "fact").cast("string"),
                F.lit("feature_store_candidate"), has_kpi.cast("string"),
            ),
        ).alias("ai_metadata"),
    )
    qn = qualified_name(layer, table, store)
    described = F.coalesce(F.col("description"), F.concat_ws(" ", F.initcap(layer), F.lit("table:"), table))
    return p.select(
        F.md5(qn).alias("guid"),
        qn.alias("qualifiedName"),
        table.alias("name"),
        F.when(has_kpi, F.concat_ws("", F.col("iku_code"), F.lit(": "), F.col("iku_nama"))).otherwise(described).alias("description"),
        layer.alias("layer"),
        F.when(layer == "staging", "csv").otherwise("parquet").alias("format"),
        F.concat_ws("/", F.lit(base.rstrip("/")), layer, table).alias("location"),
        F.col("row_count").cast("bigint"),
        F.col("column_count").cast("int"),
        F.to_json("schema").alias("schema_def"),
        F.to_json(blocks).alias("profiling"),
        F.to_json(F.coalesce(F.col("pii_columns"), F.array().cast("array<string>"))).alias("pii_columns"),
        F.lit(stamped_at).alias("ingested_at"),
        F.when(curated, F.lit(stamped_at)).alias("enriched_at"),
        tags(layer, F.col("quality_status"), F.size("pii_columns") > 0, F.col("table_type")).alias("classifications"),
    )


def normalise(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Attribute lists of (name, value) pairs to a map with the canonical names filled from their other spellings.

    Of a repeated name the last pair counts.
    """
    if isinstance(df.schema[attributes].dataType, T.ArrayType):
        pairs = F.filter(attributes, lambda p: p["name"].isNotNull())
        last = F.filter(
            pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"])
        )
        df = df.withColumn(attributes, F.map_from_entries(last))
    known = F.col(attributes)
    canonical = {
        name: F.coalesce(*[F.try_element_at(known, F.lit(n)) for n in (name, *others)])
        for name, others in ALIASES.items()
    }
    fixed = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(n) for n in canonical]), F.array(*canonical.values())),
        lambda _, v: v.isNotNull(),
    )
    rest = F.map_filter(known, lambda k, _: ~k.isin(*ALIASES))
    return df.withColumn(attributes, F.map_concat(rest, fixed))


def upsert(old: DataFrame, new: DataFrame, key: str = "qualifiedName", version: str = "version") -> DataFrame:
    """Insert or replace by key; the highest version wins, and of equal versions the new side.

    A replaced entity keeps the guid it had first.
    """
    columns = old.columns
    both = old.withColumn("__side", F.lit(0)).unionByName(new.select(*columns).withColumn("__side", F.lit(1)))
    order = F.struct(version, "__side")
    rest = [c for c in columns if c not in (key, "guid")]
    return (
        both.groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("r"), F.min_by("guid", F.struct("__side", version)).alias("guid"))
        .select("guid", key, *[F.col(f"r.{c}").alias(c) for c in rest])
        .select(*columns)
    )


def upsert_stored(table: SlicedTable, new: DataFrame, number: int, version: str = "version") -> list[int]:
    """:func:`upsert` into a stored table keyed by its one key; only the slices that hold keys of ``new`` are rewritten.

    ``number`` is the number of the batch; the slices rewritten are returned.
    """
    (key,) = table.keys
    columns = table.read([]).columns
    best = upsert(new.select(*columns).limit(0), new, key, version)
    newer = F.col("new").isNotNull() & ~F.coalesce(F.col(f"old.{version}") > F.col(f"new.{version}"), F.col(f"old.{version}").isNotNull())

    def combine(both: DataFrame) -> DataFrame:
        rest = [c for c in columns if c not in (key, "guid")]
        keep = [F.when(newer, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rest]
        return both.select(key, F.when(F.col("old").isNotNull(), F.col("old.guid")).otherwise(F.col("new.guid")).alias("guid"), *keep)

    return table.merge(best, combine, number)


def merge_lists(lists: Sequence[DataFrame], key: str = "guid") -> DataFrame:
    """Several result lists as one, the last list winning per key; rows without a key are left out."""
    columns = lists[0].columns
    rest = [c for c in columns if c != key]
    tagged = [df.select(*columns).withColumn("__list", F.lit(i)) for i, df in enumerate(lists)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return (
        both.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), "__list").alias("r"))
        .select(key, "r.*")
        .select(*columns)
    )


# ---- parsed form ------------------------------------------------------------------


def json_object(text: Column, schema: T.DataType | str) -> Column:
    """Parsed JSON object; NULL for anything else."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def parsed(entities: DataFrame) -> DataFrame:
    """Entities with ``schema`` (map), ``prof`` (struct), ``pii`` (list) and the resolved ``at_layer``."""
    empty_map = F.create_map().cast("map<string,string>")
    empty_list = F.array().cast("array<string>")
    return entities.withColumns(
        {
            "schema": F.coalesce(json_object(F.col("schema_def"), "map<string,string>"), empty_map),
            "prof": json_object(F.col("profiling"), PROFILING),
            "pii": F.coalesce(json_object(F.col("pii_columns"), "array<string>"), empty_list),
            "at_layer": layer_of(F.col("qualifiedName"), F.col("layer")),
        }
    )


# The checks below are SQL text: one parsed expression in place of hundreds of calls.


def _filled(text: str) -> str:
    """Text that says something: not blank and not an empty JSON value."""
    return f"coalesce(length(trim({text})) > 0 AND trim({text}) NOT IN ('{{}}', '[]', 'null'), false)"


def _some(collection: str) -> str:
    """A list or map with at least one entry."""
    return f"coalesce(size({collection}) > 0, false)"


_QUALITY_FIELDS = ("overall_score", "source_score", "score", "quality_score", "source_status", "status")
HAS_QUALITY = "(" + " OR ".join(f"prof.quality.{f} IS NOT NULL" for f in _QUALITY_FIELDS) + ")"
HAS_ROLE = f"({_filled('prof.star_schema.table_type')} OR {_filled('prof.kpi.iku_code')})"


# ---- scores -----------------------------------------------------------------------


def _share(checks: Sequence[str]) -> str:
    """Passed checks as whole %, ties to the even number."""
    hits = " + ".join(f"int(coalesce({c}, false))" for c in checks)
    return f"int(bround(({hits}) * 100.0D / {len(checks)}))"


BASE_CHECKS = [
    *[_filled(c) for c in ("qualifiedName", "name", "description", "layer", "format", "location")],
    "size(`schema`) > 0",
    "row_count IS NOT NULL",
    f"({_filled('ingested_at')} OR {_filled('enriched_at')})",
]
SILVER_CHECKS = [
    *BASE_CHECKS, _filled("prof.business.owner"), _some("prof.business.glossary_terms"), HAS_QUALITY, _some("prof.compliance"),
]
GOLD_CHECKS = [*BASE_CHECKS, HAS_ROLE, _some("prof.consumption"), _filled("enriched_at")]


def q_completeness(layer: str) -> Column:
    """``layer`` names the column with the layer an entity is judged in."""
    return F.expr(
        f"CASE {layer} WHEN 'bronze' THEN {_share(BASE_CHECKS)} WHEN 'silver' THEN {_share(SILVER_CHECKS)} "
        f"ELSE {_share(GOLD_CHECKS)} END"
    )


def q_accuracy(layer: str) -> Column:
    """A zero score counts as not given, but for the last of the score names."""
    q = "prof.quality"
    given = f"coalesce(nullif({q}.overall_score, 0), nullif({q}.source_score, 0), nullif({q}.score, 0), {q}.quality_score)"
    return F.expr(
        f"CASE WHEN size(`schema`) = 0 OR row_count < 0 THEN 0 WHEN {layer} = 'bronze' THEN 95 "
        f"WHEN {given} IS NOT NULL THEN least(100, greatest(0, int(bround({given})))) "
        f"WHEN {q}.source_status = 'PASS' THEN 90 WHEN {q}.source_status = 'QUARANTINE' THEN 70 "
        f"WHEN {layer} = 'silver' THEN 85 WHEN {HAS_ROLE} THEN 92 ELSE 75 END"
    )


# Fixed values: (age in days up to, score).
AGE_SCORES = ((7, 100), (30, 90), (90, 75), (180, 60))
AGE_SCORE_OLDER = 40


def q_timeliness(as_of: str) -> Column:
    at = "try_to_timestamp(coalesce(nullif(enriched_at, ''), nullif(ingested_at, '')))"
    age = f"(unix_micros(timestamp'{as_of}') - unix_micros({at})) / 86400000000"
    steps = " ".join(f"WHEN {age} <= {days} THEN {points}" for days, points in AGE_SCORES)
    return F.expr(f"CASE WHEN {at} IS NULL THEN 0 {steps} ELSE {AGE_SCORE_OLDER} END")


def q_consistency(layer: str) -> Column:
    checks = [
        f"layer = {layer}",
        f"at_layer = {layer}",
        f"startswith(qualifiedName, concat({layer}, '.'))",
        f"array_contains(classifications, concat(initcap({layer}), '_Layer'))",
        f"contains(lower(location), {layer})",
    ]
    return F.expr(_share(checks))


def quality(entities: DataFrame, as_of: str, layers: Sequence[str] = ("bronze", "silver", "gold")) -> DataFrame:
    """The four scores of every entity, for each evaluated layer whose tag it carries."""
    names = ", ".join(f"'{x}'" for x in layers)
    tagged = f"filter(array({names}), x -> array_contains(classifications, concat(initcap(x), '_Layer')))"
    rows = parsed(entities).withColumn("eval_layer", F.expr(f"explode({tagged})"))
    return rows.select(
        "guid", "qualifiedName", "eval_layer",
        q_completeness("eval_layer").alias("completeness"),
        q_accuracy("eval_layer").alias("accuracy"),
        q_timeliness(as_of).alias("timeliness"),
        q_consistency("eval_layer").alias("consistency"),
    )


SCORES = ("completeness", "accuracy", "timeliness", "consistency")


def scale_1_5(pct: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), F.bround(pct / 20).cast("int")))


def quality_by_layer(scores: DataFrame, layers: Sequence[str] = ("bronze", "silver", "gold")) -> DataFrame:
    """Mean scores per layer (whole %, ties to even) and on the 1-5 scale; a layer without entities scores 0 and 1."""
    spark = scores.sparkSession
    means = scores.groupBy(F.col("eval_layer").alias("layer")).agg(
        F.count(F.lit(1)).alias("entity_count"),
        *[F.bround(F.sum(c) / F.count(c)).cast("int").alias(c) for c in SCORES],
    )
    grid = spark.createDataFrame([(x,) for x in layers], "layer string")
    out = grid.join(means, "layer", "left").na.fill(0, ["entity_count", *SCORES])
    return out.select("layer", "entity_count", *SCORES, *[scale_1_5(F.col(c)).alias(f"{c}_1_5") for c in SCORES])


def coverage(entities: DataFrame, layers: Sequence[str] = ("bronze", "silver", "gold")) -> DataFrame:
    """Share of entities per layer with a schema, an owner, glossary terms and a PII tag."""
    rows = parsed(entities).filter(F.col("at_layer").isin(*layers))
    flags = {
        "schema_documented_pct": "size(`schema`) > 0",
        "owner_steward_pct": "length(prof.business.owner) > 0",
        "glossary_term_pct": _some("prof.business.glossary_terms"),
        "classification_pii_pct": "array_contains(classifications, 'PII')",
    }
    counted = rows.groupBy(F.col("at_layer").alias("layer")).agg(
        F.count(F.lit(1)).alias("entity_count"), *[F.expr(f"count_if({test})").alias(n) for n, test in flags.items()]
    )
    return counted.select("layer", "entity_count", *[percent(n, "entity_count").alias(n) for n in flags])


# ---- unified metadata -------------------------------------------------------------


def umt(entities: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per asset: technical, business and operational blocks and the time of the last enrichment."""
    rows = parsed(entities)
    none = F.array().cast("array<string>")
    out = rows.select(
        F.col("qualifiedName").alias("asset_qualified_name"),
        "guid",
        F.col("at_layer").alias("layer"),
        F.struct(
            F.col("schema"), F.col("format"), F.col("location"), F.col("row_count"), F.col("column_count"),
            F.col("pii").alias("pii_columns"),
        ).alias("technical"),
        F.struct(
            F.col("description"),
            F.col("prof.business.owner").alias("owner"),
            F.col("prof.business.domain").alias("domain"),
            F.coalesce("prof.business.glossary_terms", none).alias("glossary_terms"),
            F.coalesce("prof.business.iku_relevance", none).alias("iku_relevance"),
            F.col("prof.business.update_frequency").alias("update_frequency"),
            F.col("prof.kpi").alias("kpi"),
            F.col("prof.consumption").alias("consumption"),
            F.col("prof.ai_metadata").alias("ai_metadata"),
        ).alias("business"),
        F.struct(
            F.coalesce("classifications", none).alias("classifications"),
            F.col("prof.quality").alias("quality"),
            F.col("prof.compliance").alias("compliance"),
            F.col("prof.star_schema").alias("star_schema"),
            F.col("prof.transformations").alias("transformations"),
        ).alias("operational"),
        F.coalesce(*[F.when(F.length(c) > 0, F.col(c)) for c in ("enriched_at", "ingested_at")], F.col("prof.profiled_at")).alias("last_enriched_at"),
    )
    return out.orderBy(layer_position(F.col("layer")), "asset_qualified_name") if ordered else out


def _text_or(own: Column, *others: Column) -> Column:
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, c) for c in (own, *others)])


def _list_or(own: Column, *others: Column) -> Column:
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in (own, *others)], own)


def umt_fill(rows: DataFrame, summary: DataFrame, domain: str, staging_base: str = "staging") -> DataFrame:
    """Fill empty fields of unified rows.

    Order for technical fields: the row's own value, the staging summary (``table_name,
    row_count, column_count, file``; staging rows only), the sibling in bronze (same name
    for staging, ``raw_x`` for ``silver_x``). Owner, domain and refresh fall back to the
    layer's defaults. The sibling is found by an equi join on a derived key.
    """
    t, b = F.col("technical"), F.col("business")
    table = table_part(F.col("asset_qualified_name"))
    is_staging = F.col("layer") == "staging"
    sibling = F.when(is_staging, F.col("__table")).when(
        (F.col("layer") == "silver") & F.startswith(F.col("__table"), F.lit("silver_")),
        F.concat(F.lit("raw_"), F.substr(F.col("__table"), F.lit(len("silver_") + 1))),
    )
    keyed = rows.withColumn("__table", table).withColumn("__sibling", sibling)
    bronze = (
        keyed.filter(F.col("layer") == "bronze")
        .groupBy(F.col("__table").alias("__sibling"))
        .agg(F.max_by(t, F.col("asset_qualified_name")).alias("__s"))
        .withColumn("__has_sibling", F.lit(True))
    )
    # Rows without a sibling (all gold ones, say) keep keys of their own that match nothing:
    # as NULLs they would all meet in one partition.
    keyed = keyed.withColumns(
        {
            "__has_sibling": F.col("__sibling").isNotNull(),
            "__sibling": F.coalesce("__sibling", "asset_qualified_name"),
        }
    )
    staged = summary.select(
        F.col("table_name").alias("__table"),
        F.struct(
            F.col("row_count").cast("bigint").alias("row_count"), F.col("column_count").cast("int").alias("column_count"), "file"
        ).alias("__d"),
    )
    joined = keyed.join(bronze, ["__has_sibling", "__sibling"], "left").join(staged, "__table", "left")
    s, d = F.col("__s"), F.when(is_staging, F.col("__d"))
    schema = F.coalesce(F.when(F.size(t["schema"]) > 0, t["schema"]), F.when(F.size(s["schema"]) > 0, s["schema"]), t["schema"])
    technical = F.struct(
        schema.alias("schema"),
        _text_or(t["format"], F.when(d.isNotNull(), F.lit("csv")), s["format"]).alias("format"),
        _text_or(t["location"], F.concat(F.lit(f"{staging_base}/"), d["file"]), s["location"]).alias("location"),
        F.coalesce(t["row_count"], d["row_count"], s["row_count"]).alias("row_count"),
        F.coalesce(
            t["column_count"], d["column_count"], s["column_count"],
            F.when(is_staging & F.col("__s").isNotNull() & (F.size(schema) > 0), F.size(schema)),
        ).alias("column_count"),
        _list_or(t["pii_columns"], s["pii_columns"]).alias("pii_columns"),
    )
    gold = F.col("layer") == "gold"
    empty = F.create_map().cast("map<string,string>")
    business = b.withField("owner", _text_or(b["owner"], code_lookup("layer", LAYER_OWNER)))
    business = business.withField("domain", _text_or(b["domain"], F.lit(domain)))
    business = business.withField("update_frequency", _text_or(b["update_frequency"], code_lookup("layer", LAYER_REFRESH)))
    for block in ("consumption", "ai_metadata"):
        business = business.withField(block, F.coalesce(b[block], F.when(gold, empty)))
    return joined.withColumns({"technical": technical, "business": business}).select(*rows.columns)


# ---- counts, search, cards --------------------------------------------------------


def counts(entities: DataFrame, processes: DataFrame) -> DataFrame:
    """Entities by type, by layer and by tag, and processes by name, as (kind, label, n).

    Each row is counted under all its labels at once, so both tables are read once.
    """
    def label(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("label"))

    of_entity = F.concat(
        F.array(
            label("type", F.lit("lakehouse_dataset")),
            label("layer", layer_of(F.col("qualifiedName"), F.col("layer"))),
        ),
        F.transform(F.coalesce("classifications", F.array().cast("array<string>")), lambda t: label("classification", t)),
    )
    of_process = F.array(
        label("type", F.lit("lakehouse_etl_process")), label("process", F.col("pipeline_name"))
    )
    labels = entities.select(F.explode(of_entity).alias("l")).unionByName(processes.select(F.explode(of_process).alias("l")))
    return labels.groupBy("l.kind", "l.label").agg(F.count(F.lit(1)).alias("n"))


def search_text() -> Column:
    """Everything a text search looks at, lower-cased; needs the parsed form."""
    return F.lower(
        F.concat_ws(
            " ",
            *[F.coalesce(F.col(c), F.lit("")) for c in ("qualifiedName", "name", "description", "layer")],
            F.concat_ws(" ", "prof.business.glossary_terms"),
            F.concat_ws(" ", "prof.business.iku_relevance"),
            F.col("prof.kpi.iku_code"),
            F.col("prof.kpi.iku_nama"),
        )
    )


def search(
    entities: DataFrame,
    text: str | None = None,
    classification: str | None = None,
    layer: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Entities that match every criterion given, a page at a time in name order."""
    rows = entities
    if classification:
        rows = rows.filter(F.array_contains("classifications", classification))
    rows = parsed(rows)
    if layer:
        rows = rows.filter(F.col("at_layer") == layer)
    if text:
        rows = rows.filter(F.contains(search_text(), F.lit(text.lower())))
    return rows.select(*entities.columns).orderBy("qualifiedName").offset(offset).limit(limit)


def index_assets(entities: DataFrame, path: str) -> TextIndex:
    """A stored index of everything a search looks at; classifications and layers are its tags."""
    rows = parsed(entities).where(F.length("qualifiedName") > 0)
    layer = F.array_compact(F.array(F.concat(F.lit("layer:"), F.col("at_layer"))))
    tags = F.concat(F.coalesce("classifications", F.array().cast("array<string>")), layer)
    return TextIndex.build(rows.select(F.col("qualifiedName").alias("id"), search_text().alias("text"), "name", tags.alias("classes")), path, F.col("classes"))


def search_page(
    index: TextIndex, text: str | None = None, classification: str | None = None, layer: str | None = None, limit: int = 50, after: str | None = None
) -> DataFrame:
    """:func:`search` a page at a time by the last name of the page before, from the postings of what is asked for."""
    tags = ([classification] if classification else []) + ([f"layer:{layer}"] if layer else [])
    return index.page(text, tags, limit, after).select(F.col("id").alias("qualifiedName"), "name")


def lifecycle(layer: Column, classifications: Column) -> tuple[Column, Column]:
    """Stage number of an asset and the zone the stage lies in."""
    graded = F.arrays_overlap(classifications, F.array(F.lit("Quality_Pass"), F.lit("Quality_Quarantine")))
    stage = (
        F.when(layer == "gold", 13)
        .when(layer == "silver", 10)
        .when((layer == "bronze") & F.coalesce(graded, F.lit(False)), 9)
        .when(layer == "bronze", 7)
        .when(layer == "staging", 4)
        .otherwise(3)
    )
    zone = F.when(stage <= 4, "Sandbox").when(stage <= 9, "Enrichment").when(stage <= 13, "Production").otherwise("Evolution")
    return stage, zone


def profile_shape(df: DataFrame, profiling: str = "profiling") -> DataFrame:
    """Column statistics wherever they lie (under ``columns`` or at the root), one row per column,
    with the quality score and status under any of their names."""
    stat = "struct<null_count:bigint,null_pct:double,completeness_pct:double,distinct_count:bigint>"
    nested = json_object(F.get_json_object(profiling, "$.columns"), f"map<string,{stat}>")
    root = F.map_filter(
        json_object(F.col(profiling), f"map<string,{stat}>"),
        lambda _, v: v["null_count"].isNotNull() | v["null_pct"].isNotNull() | v["completeness_pct"].isNotNull(),
    )
    q = json_object(
        F.get_json_object(profiling, "$.quality"),
        "quality_score double, source_score double, overall_score double, silver_completeness double, "
        "status string, source_status string",
    )
    kept = [c for c in df.columns if c != profiling]
    shaped = df.select(
        *kept,
        F.explode_outer(F.coalesce(nested, root)).alias("column_name", "s"),
        F.coalesce(*[q[c] for c in ("quality_score", "source_score", "overall_score", "silver_completeness")]).alias("quality_score"),
        F.coalesce(q["status"], q["source_status"], F.lit("UNKNOWN")).alias("quality_status"),
    )
    return shaped.select(*kept, "column_name", "s.*", "quality_score", "quality_status")


def kpi_cards(entities: DataFrame, definitions: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """One card per KPI: whether a gold entity carries it, its rows, value, target, status, unit.

    ``definitions``: code -> (name, fact table, target). Of several matching entities the
    first in name order is taken; each partition offers its own first, so a KPI matched by
    most entities stays cheap.
    """
    spark = entities.sparkSession
    grid = spark.createDataFrame(
        [(c, n, f, float(t)) for c, (n, f, t) in definitions.items()],
        "code string, kpi_name string, fact string, default_target double",
    )
    rows = parsed(entities).filter((F.col("layer") == "gold") | F.startswith(F.col("qualifiedName"), F.lit("gold.")))

    def hit(code: str, fact: str) -> Column:
        tail = fact.replace("fact_", "")
        return (
            (F.col("name") == fact)
            | F.contains(F.col("qualifiedName"), F.lit(fact))
            | ((F.col("layer") == "gold") & F.contains(F.col("name"), F.lit(tail)))
            | (F.col("prof.kpi.iku_code") == code)
        )

    codes = F.array_compact(
        F.array(*[F.when(F.coalesce(hit(c, f), F.lit(False)), c) for c, (_, f, _) in definitions.items()])
    )
    k = F.col("prof.kpi")
    card = F.struct(
        "guid", "qualifiedName", F.col("row_count"),
        k["nilai_capaian"].alias("value"), k["nilai_target"].alias("target"),
        k["status_capaian"].alias("status"), k["satuan"].alias("unit"), k["formula"].alias("formula"),
    )
    matched = (
        rows.select(F.explode(codes).alias("code"), card.alias("e"))
        .groupBy("code")
        .agg(F.min_by("e", F.struct("e.qualifiedName", "e.guid")).alias("e"))
    )
    return grid.join(matched, "code", "left").select(
        "code", "kpi_name", "fact",
        F.col("e").isNotNull().alias("registered"),
        F.coalesce("e.row_count", F.lit(0).cast("bigint")).alias("row_count"),
        F.col("e.value").alias("value"),
        F.coalesce("e.target", "default_target").alias("target"),
        F.col("e.status").alias("status"),
        F.coalesce(_text_or(F.col("e.unit")), F.when(F.col("code").endswith("-5"), "Rasio").otherwise("%")).alias("unit"),
        F.col("e.formula").alias("formula"),
        F.col("e.qualifiedName").alias("qualifiedName"),
        F.col("e.guid").alias("guid"),
    )


def star_counts(entities: DataFrame) -> DataFrame:
    """Gold entities, and how many of them are dimensions and facts."""
    rows = parsed(entities).filter((F.col("layer") == "gold") | F.startswith(F.col("qualifiedName"), F.lit("gold.")))
    kind = F.col("prof.star_schema.table_type")
    return rows.agg(
        F.count(F.lit(1)).alias("gold_count"),
        F.count_if(kind == "dimension").alias("dimension_count"),
        F.count_if(kind == "fact").alias("fact_count"),
    )
