"""Lineage edges, their completeness and traversal."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierworks.functions import code_lookup, percent
from tierworks.functions.names import layer_of, qualified_name
from tierworks.operators.profile import union_all
from tierworks.session import cut_lineage

# Source names that are no dataset.
NO_DATASET = ("generated", "all_iku_facts")
MERGED_LEVELS = 16  # levels of a walk that are kept apart
# Display names of the pipelines.
PIPELINE_LABELS = {
    "staging_to_bronze": "ETL Staging→Bronze",
    "bronze_to_silver": "ETL Bronze→Silver",
    "silver_to_gold": "ETL Silver→Gold",
}


def source_layer(source: Column, target_layer: Column) -> Column:
    """Layer of a source by its name; a target below gold reads from the layer before it."""
    by_name = F.when(F.startswith(source, F.lit("raw_")), "bronze").otherwise("silver")
    return (
        F.when(target_layer == "bronze", "staging").when(target_layer == "silver", "bronze").otherwise(by_name)
    )


def edges(specs: DataFrame, store: str) -> DataFrame:
    """One row per (source, process, target) from rows of (pipeline, target_layer, table_name, sources)."""
    each = specs.select("pipeline", "target_layer", "table_name", F.explode("sources").alias("source"))
    each = each.filter(~F.col("source").isin(*NO_DATASET))
    src_layer = source_layer(F.col("source"), F.col("target_layer"))
    return each.select(
        F.concat(F.lit("etl."), "pipeline", F.lit("."), "table_name", F.lit("@" + store)).alias("process"),
        F.col("pipeline").alias("pipeline_name"),
        qualified_name(src_layer, F.col("source"), store).alias("src"),
        qualified_name(F.col("target_layer"), F.col("table_name"), store).alias("dst"),
        src_layer.alias("src_layer"),
        F.col("target_layer").alias("dst_layer"),
    )


def completeness(entities: DataFrame, links: DataFrame, layers: tuple[str, ...] = ("bronze", "silver", "gold")) -> DataFrame:
    """Share of entities per layer with an incoming and with an outgoing edge, over all entities.

    Each end's keys are made distinct before the joins, so an asset with very many edges
    costs one row.
    """
    incoming = links.select(F.col("dst").alias("qualifiedName")).distinct().withColumn("has_in", F.lit(True))
    outgoing = links.select(F.col("src").alias("qualifiedName")).distinct().withColumn("has_out", F.lit(True))
    rows = entities.select("qualifiedName", layer_of(F.col("qualifiedName"), F.col("layer")).alias("layer"))
    flagged = (
        rows.filter(F.col("layer").isin(*layers))
        .join(incoming, "qualifiedName", "left")
        .join(outgoing, "qualifiedName", "left")
    )
    n = F.count(F.lit(1))
    return flagged.groupBy("layer").agg(
        n.alias("entity_count"),
        percent(F.count("has_in"), n).alias("with_incoming_pct"),
        percent(F.count("has_out"), n).alias("with_outgoing_pct"),
    )


def trace(links: DataFrame, start: DataFrame, depth: int | None, direction: str = "both", cut_every: int = 4) -> DataFrame:
    """Assets reachable from the start assets in at most ``depth`` steps, or any number: (start, direction, node, depth).

    ``links`` is (src, dst); ``start`` has a column ``node``. A short walk (``cut_every`` steps) is one plan: every
    level extends the distinct pairs of the level before, and the least depth of a pair is kept at the end. A
    longer one goes level by level, see :func:`closure`.
    """
    if direction not in ("up", "down", "both"):
        raise ValueError(f"direction must be 'up', 'down' or 'both', not {direction!r}")
    short = depth is not None and depth <= cut_every
    parts = [
        _walk(links, start, depth, d, cut_every) if short else closure(links, start, d, depth)
        for d in (("down", "up") if direction == "both" else (direction,))
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _walk(links: DataFrame, start: DataFrame, depth: int, direction: str, cut_every: int) -> DataFrame:
    here, there = ("src", "dst") if direction == "down" else ("dst", "src")
    step = links.select(F.col(here).alias("node"), F.col(there).alias("next"))
    frontier = start.select(F.col("node").alias("start"), "node").distinct()
    levels = []
    for level in range(1, depth + 1):
        frontier = frontier.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        if level % cut_every == 0 and level < depth:
            frontier = cut_lineage(frontier)
        levels.append(frontier.withColumn("depth", F.lit(level)))
    reached = union_all(levels).filter(F.col("node") != F.col("start"))
    least = reached.groupBy("start", "node").agg(F.min("depth").alias("depth"))
    return least.select("start", F.lit(direction).alias("direction"), "node", "depth")


def closure(links: DataFrame, start: DataFrame, direction: str = "down", depth: int | None = None) -> DataFrame:
    """:func:`trace` in one direction by semi-naive evaluation, as deep as the links go unless ``depth`` ends it.

    Runs of nodes with one way in and one way out are first made one link as long as the run, see :func:`chains`, so
    the levels count forks and meetings, not steps: a ring of thousands is a handful of them. A level follows the links of
    the pairs that the level before found, or found nearer, and drops those that any earlier level has as near, so a pair
    is extended once however many ways and cycles lead to it. It ends with the first level that finds nothing; then the runs
    behind the reached nodes are filled in. Links and levels are written to the shared folder; NULL ends and repeated links count for nothing.
    """
    here, there = ("src", "dst") if direction == "down" else ("dst", "src")
    step = links.select(F.col(here).alias("node"), F.col(there).alias("next")).where("node IS NOT NULL AND next IS NOT NULL AND node <> next")
    step = cut_lineage(step.distinct())
    fresh = cut_lineage(start.select(F.col("node").alias("start"), "node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    through = step.groupBy("node").agg(F.count(F.lit(1)).alias("out")).where("out = 1").select("node")
    through = through.join(step.groupBy(F.col("next").alias("node")).agg(F.count(F.lit(1)).alias("ways")).where("ways = 1"), "node").select("node")
    through = cut_lineage(through.join(fresh.select("node"), "node", "left_anti"))
    run = chains(step, through)
    # a link leaves a node that is kept, or the last node of a run, and ends in one that is kept
    ends = step.join(through.select(F.col("node").alias("next")), "next", "left_anti").join(run, "node", "left")
    whole = ends.select(F.coalesce("head", "node").alias("node"), "next", (F.coalesce("place", F.lit(0)) + 1).alias("length"))
    whole = cut_lineage(whole.where("node <> next").groupBy("node", "next").agg(F.min("length").alias("length")))
    reached = fresh
    near = F.lit(True) if depth is None else F.col("depth") <= depth
    level = 0
    while not fresh.isEmpty():
        level += 1
        found = fresh.join(whole, "node").select("start", F.col("next").alias("node"), (F.col("depth") + F.col("length")).alias("depth"))
        found = found.where(near).groupBy("start", "node").agg(F.min("depth").alias("depth"))
        known = reached.select(F.col("start").alias("s"), F.col("node").alias("n"), F.col("depth").alias("d"))
        fresh = cut_lineage(found.join(known, (F.col("start") == F.col("s")) & (F.col("node") == F.col("n")) & (F.col("d") <= F.col("depth")), "left_anti"))
        reached = reached.unionByName(fresh)
        if level % MERGED_LEVELS == 0:  # a few files to read again instead of one for every level
            reached = cut_lineage(reached.repartition("start", "node"))
    least = reached.groupBy("start", "node").agg(F.min("depth").alias("depth"))
    inner = least.select("start", F.col("node").alias("head"), "depth").join(run, "head")
    inner = inner.select("start", "node", (F.col("depth") + F.col("place")).alias("depth")).where(near)
    return least.where("depth > 0").unionByName(inner).select("start", F.lit(direction).alias("direction"), "node", "depth")


def chains(step: DataFrame, through: DataFrame) -> DataFrame:
    """Which node each run of ``through`` nodes leaves, and how many steps behind it a node lies: (node, head, place).

    ``step`` is distinct (node, next); every node of ``through`` has one way in and one way out. Each learns in
    a round what the node it points back to knows, so the distance known doubles and a run of a million nodes takes
    twenty rounds. Rings that no other node leads into have no head and are left out.
    """
    back = step.select(F.col("next").alias("node"), F.col("node").alias("head")).join(through, "node")
    inside = through.select(F.col("node").alias("head"), F.lit(True).alias("inside"))
    back = cut_lineage(back.join(inside, "head", "left").select("node", "head", F.lit(1).alias("place"), F.col("inside").isNull().alias("done")))
    done, left = back.where("done"), back.where("NOT done")
    while not left.isEmpty():
        known = done.unionByName(left).select(F.col("node").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"), F.col("done").alias("known"))
        moved = left.join(known, "head").select("node", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"), F.col("known").alias("done"))
        moved = cut_lineage(moved)
        fresh, left = moved.where("done"), moved.where("NOT done")
        if fresh.isEmpty():  # what is left goes round
            break
        done = done.unionByName(fresh)
    return done.drop("done")


def node_label(pipeline: Column, name: Column, is_process: Column) -> Column:
    """Display name: a process by its pipeline, anything else by its own name."""
    named = F.coalesce(code_lookup(pipeline, PIPELINE_LABELS), F.replace(name, F.lit("_"), F.lit(" ")), F.lit("ETL process"))
    return F.when(is_process, named).otherwise(F.coalesce(name, F.lit("Dataset")))


def node_layer(pipeline: Column, declared: Column, qualified: Column, is_process: Column) -> Column:
    slots: Mapping[str, str] = {p: "etl-" + p.replace("_to_", "-") for p in PIPELINE_LABELS}
    return F.when(is_process, F.coalesce(code_lookup(pipeline, slots), F.lit("etl"))).otherwise(layer_of(qualified, declared))
