"""Business glossary: terms found in metadata, merging, links to assets.

Terms and assets are kept as (term, asset) rows. A term used by most assets is then
many rows, never one long list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierworks.functions import code_lookup
from tierworks.operators.catalog import parsed, search_text
from tierworks.operators.shape import keep_one
from tierworks.operators.textindex import TextIndex

# Origin labels.
LOCAL, SILVER, GOLD, CATALOG = "local", "silver_metadata", "gold_metadata", "atlas"

TERM = "term string, definition string, category string"


def terms_of(
    entities: DataFrame, definitions: Mapping[str, tuple[str, str]], default_prefix: str, default_category: str = "Business"
) -> DataFrame:
    """Distinct (term, definition, category, source, asset) rows of the entities' metadata.

    Terms come from the glossary lists; a gold entity with a KPI adds the KPI's code with
    its name as the definition. Where a code is also a listed term, the KPI counts.
    """
    rows = parsed(entities)
    listed = rows.select(
        F.explode("prof.business.glossary_terms").alias("term"), F.col("qualifiedName").alias("asset")
    ).distinct()
    listed = listed.select(
        "term",
        code_lookup("term", {t: d for t, (d, _) in definitions.items()}, F.concat(F.lit(default_prefix), "term")).alias("definition"),
        code_lookup("term", {t: c for t, (_, c) in definitions.items()}, F.lit(default_category)).alias("category"),
        F.lit(SILVER).alias("source"),
        "asset",
    )
    code = F.col("prof.kpi.iku_code")
    coded = rows.filter((F.col("at_layer") == "gold") & (F.length(code) > 0)).select(
        code.alias("term"),
        F.coalesce("prof.kpi.iku_nama", code).alias("definition"),
        F.col("qualifiedName").alias("asset"),
    )
    # One gold entity stands for its code: the last in name order.
    coded = keep_one(coded, ["term"], [F.desc("asset")]).select(
        "term", "definition", F.lit("Business").alias("category"), F.lit(GOLD).alias("source"), "asset"
    )
    return listed.join(coded.select("term"), "term", "left_anti").unionByName(coded)


def summary(terms: DataFrame) -> DataFrame:
    """One row per term with the number of assets that use it."""
    return terms.groupBy("term", "definition", "category", "source").agg(F.count("asset").alias("n_assets"))


def merge(local: DataFrame, metadata: DataFrame, catalog: DataFrame) -> DataFrame:
    """Terms of three origins by lower-cased name: local, overruled by metadata, overruled by the catalog.

    All three have (term, definition, category); the catalog also a guid. A blank
    catalog definition or category falls back to the origin below.
    """
    def side(df: DataFrame, tag: str, *extra: str) -> DataFrame:
        columns = ["term", "definition", "category", *extra]
        one = keep_one(df.select(F.lower("term").alias("key"), *columns), ["key"])
        return one.select("key", F.struct(*columns).alias(tag))

    both = side(local, "l").join(side(metadata, "m", "source"), "key", "full").join(side(catalog, "c", "guid"), "key", "full")
    lower = F.coalesce(F.col("m").isNotNull(), F.lit(False))

    def below(field: str) -> Column:
        return F.when(lower, F.col(f"m.{field}")).otherwise(F.col(f"l.{field}"))

    def given(field: str) -> Column:
        return F.when(F.length(f"c.{field}") > 0, F.col(f"c.{field}"))

    has_c = F.col("c").isNotNull()
    return both.select(
        "key",
        F.coalesce("c.term", "m.term", "l.term").alias("term"),
        F.when(has_c, F.coalesce(given("definition"), below("definition"), F.lit(""))).otherwise(below("definition")).alias("definition"),
        F.when(has_c, F.coalesce(given("category"), below("category"), F.lit("Atlas"))).otherwise(below("category")).alias("category"),
        F.when(has_c, F.lit(CATALOG)).when(lower, F.col("m.source")).otherwise(LOCAL).alias("source"),
        F.col("c.guid").alias("guid"),
    )


def link_terms(
    terms: Sequence[str], entities: DataFrame, aliases: Mapping[str, Sequence[str]], first: int | None = None
) -> DataFrame:
    """Assets whose text contains an alias of a term, in name order: (term, asset, position).

    With ``first`` only so many assets of a term are kept.

    ``terms`` is the curated list that has no asset of its own yet. Every asset is
    matched against all of it where it is read, so nothing is joined.
    """
    text = F.col("__text")

    def hit(term: str) -> Column:
        test = F.lit(False)
        for w in aliases.get(term.lower(), (term.lower(),)):
            # a short alias is a word of its own, a longer one may be part of a name
            test = test | (F.contains(text, F.lit(w)) if len(w) > 2 else F.rlike(text, F.lit(rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)")))
        return F.when(test, term)

    rows = parsed(entities).filter(F.length("qualifiedName") > 0)
    rows = rows.select(F.col("qualifiedName").alias("asset"), search_text().alias("__text"))
    pairs = rows.select(F.explode(F.array_compact(F.array(*[hit(t) for t in terms]))).alias("term"), "asset").distinct()
    return _first_assets(pairs, first)


def link_indexed(terms: DataFrame, index: TextIndex, first: int | None = None) -> DataFrame:
    """:func:`link_terms` for any number of terms, rows of (term, alias), against a stored index of the assets' texts.

    The plan is the same for ten terms and for ten million: aliases meet the postings of their rarest grams in a join.
    """
    return _first_assets(index.links(terms).withColumnRenamed("id", "asset"), first)


def _first_assets(pairs: DataFrame, first: int | None) -> DataFrame:
    from pyspark.sql import Window

    by_name = Window.partitionBy("term").orderBy("asset")
    ranked = pairs.withColumn("position", F.row_number().over(by_name))
    return ranked if first is None else ranked.filter(F.col("position") <= first)
