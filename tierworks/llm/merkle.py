"""A Merkle manifest of a table: a tree of digests for each group of rows, and one tree over the groups' roots.

A leaf is the digest of a row's columns; two neighbours, or the last one alone, become the digest of their
digests written together, until one node is left. Nodes are numbered by position, so the nodes over aligned
runs of 2^EVERY neighbours depend on that run alone: the build folds every run in one aggregation and
writes only the runs' tops, that is every EVERY-th level. Interior levels are never stored. A proof is made
run by run as well: the run's stored nodes give its interior levels back, each member takes its
siblings from them, and the levels are gone with the row. Everything is built of SQL functions, no group is
larger than 2^EVERY nodes, and a group of any size is spread over all tasks by the positions of its rows.

Cases: a null column is written as ``-``; null ids come first; rows that share an id are ordered by their
leaf, equal rows are leaves of their own; null is a group of its own, before all others; a group of one row
has its leaf as root; an empty table has no group, no root and no proof; clashing names don't matter, as only the named columns are read.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierworks.session import new_work_path

EVERY = 8  # a level is stored after so many
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts written together."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def field(value: Column) -> Column:
    """A column as it enters a leaf: its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(columns: list[Column]) -> Column:
    return digest(*(field(c) for c in columns))


def group_key(value: Column) -> Column:
    """The group as text that keeps its order and has no null."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string")))


def numbered(spark: SparkSession, rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """``rows`` (group_key, ...) with their position in their group and the group's size.

    Rows are sorted by ranges and written; a row's position is its place in its file's order plus what earlier
    files hold of its group. The counts of rows by file and group are few: at most files + groups.
    """
    placed = (
        rows.repartitionByRange("group_key", *order).sortWithinPartitions("group_key", *order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed.write.parquet(f"{folder}/sorted")
    placed = spark.read.schema(placed.schema).parquet(f"{folder}/sorted")
    earlier = Window.partitionBy("group_key").orderBy("part")
    counts = placed.groupBy("group_key", "part").agg(F.count(F.lit(1)).alias("here"), F.min("place").alias("first"))
    counts = counts.select(
        "group_key", "part", (F.sum("here").over(earlier) - F.col("here") - F.col("first")).alias("shift"), F.sum("here").over(Window.partitionBy("group_key")).alias("size")
    )
    return placed.join(counts, ["group_key", "part"]).withColumn("pos", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def runs(nodes: DataFrame, every: int, *also: str) -> DataFrame:
    """Aligned runs of 2^every neighbours: group_key, run, size (of the level), and the members by position."""
    member = F.struct("pos", "node", *also)
    gathered = nodes.groupBy("group_key", F.shiftright("pos", every).alias("run")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(member)).alias("members"))
    return gathered.withColumn("level0", F.transform("members", lambda m: m["node"]))


def with_levels(gathered: DataFrame, every: int) -> DataFrame:
    """Adds the interior levels of each run, level1 to level<every>; a level of one node is not folded further."""
    for k in range(every):
        below = F.col(f"level{k}")
        gathered = gathered.withColumn(f"level{k + 1}", F.when(more(k), pairs_of(below)).otherwise(below))
    return gathered


def pairs_of(nodes: Column) -> Column:
    """The level above an array of nodes."""
    firsts = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1))
    return F.transform(firsts, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def more(k: int) -> Column:
    """Whether a level that began with ``size`` nodes still has several after k foldings."""
    return F.col("size") > (1 << k)


def siblings(place: Column, every: int) -> Column:
    """What stands before and after a member's digest, level by level, from the levels of its run."""
    steps = []
    place = place.bitwiseAND(F.lit((1 << every) - 1))
    for k in range(every):
        at = F.shiftright(place, k).cast("int")
        other = F.coalesce(F.get(F.col(f"level{k}"), at.bitwiseXOR(F.lit(1))), F.lit(""))
        odd = at.bitwiseAND(F.lit(1)) == 1
        step = F.struct(F.when(odd, other).otherwise("").alias("before"), F.when(odd, "").otherwise(other).alias("after"))
        steps.append(F.when(more(k), F.array(step)).otherwise(F.array().cast(STEP)))
    return F.concat(*steps)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(steps, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a proof, in order."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


@dataclasses.dataclass
class Tree:
    """The stored levels of the trees of all groups; level 0 holds the leaves with their own columns."""

    spark: SparkSession
    folder: str
    stored: int  # levels written
    every: int

    def level(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/level-{k}")

    def roots(self) -> DataFrame:
        """group_key and root of every group."""
        return self.level(self.stored - 1).select("group_key", F.col("node").alias("root"))

    def proofs(self, above: DataFrame, *columns: str) -> DataFrame:
        """Every leaf with the named columns, its root and the steps to the root of the tree above.

        ``above`` has group_key, the steps that follow the group's own root, and any columns to hand down. It is
        joined to the tops first, then each stored level to the runs of the next: one row for 2^every leaves.
        """
        handed = [c for c in above.columns if c not in ("group_key", "steps")]
        upper = self.level(self.stored - 1).select("group_key", "pos", F.col("node").alias("root")).join(above, "group_key")
        for k in range(self.stored - 2, -1, -1):
            also = list(columns) if k == 0 else []
            nodes = self.level(k).select("group_key", "pos", "node", "size", *also)
            gathered = runs(nodes, self.every, *also).withColumnRenamed("run", "upper_pos")
            gathered = gathered.join(upper.withColumnRenamed("pos", "upper_pos"), ["group_key", "upper_pos"])
            proved = F.transform("members", lambda m: F.struct(m.alias("member"), F.concat(siblings(m["pos"], self.every), F.col("steps")).alias("steps")))
            each = with_levels(gathered, self.every).select("group_key", "root", *handed, F.explode(proved).alias("proof"))
            upper = each.select("group_key", "proof.member.*", "root", *handed, "proof.steps")
        return upper


def grow(spark: SparkSession, leaves: DataFrame, order: list[str], every: int = EVERY) -> Tree:
    """Trees over ``leaves`` (group_key, node and any other columns), one per group, leaves ordered by ``order``.

    One round for every ``every`` levels; each reads the last stored level and writes one of a 2^every-th of the nodes.
    A tree always has a stored level above its leaves.
    """
    folder = new_work_path(spark, "merkle")
    numbered(spark, leaves, order, folder).write.parquet(f"{folder}/level-0")
    stored = 1
    while True:
        nodes = spark.read.parquet(f"{folder}/level-{stored - 1}")
        if stored > 1 and nodes.where("size > 1").isEmpty():
            return Tree(spark, folder, stored, every)
        tops = with_levels(runs(nodes.select("group_key", "pos", "node", "size"), every), every)
        smaller = F.shiftright(F.col("size") - 1, every) + 1
        tops.select("group_key", F.col("run").alias("pos"), F.get(F.col(f"level{every}"), 0).alias("node"), smaller.alias("size")).write.parquet(
            f"{folder}/level-{stored}"
        )
        stored += 1


@dataclasses.dataclass
class Manifest:
    """The trees of the groups and the tree over their roots."""

    groups: Tree
    top: Tree

    def root(self) -> str | None:
        """The digest of the whole table; None for an empty one."""
        rows = self.top.roots().take(1)
        return rows[0]["root"] if rows else None

    def proofs(self, *columns: str) -> DataFrame:
        """Every row: the named leaf columns, node (its leaf), subroot, root, and the steps of its proof."""
        spark = self.top.spark
        none = F.array().cast(STEP).alias("steps")
        over = self.top.proofs(spark.range(1).select(F.lit("").alias("group_key"), none), "below")
        over = over.select(F.col("below").alias("group_key"), F.col("root").alias("whole"), "steps")
        found = self.groups.proofs(over, *columns)
        return found.select(*columns, F.col("node").alias("leaf"), F.col("root").alias("subroot"), F.col("whole").alias("root"), "steps")


def manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", every: int = EVERY, **extra: Column) -> Manifest:
    """The manifest of ``df``: leaves of the named columns, a tree per group in the order of the ids.

    ``extra`` columns are kept with the leaves. The leaves are digested once and written, so the text is read once.
    """
    spark = df.sparkSession
    path = new_work_path(spark, "merkle-leaves")
    leaves = df.select(
        group_key(df[group_col]).alias("group_key"), df[id_col].alias("id"), row_digest([df[c] for c in columns]).alias("node"), *(c.alias(n) for n, c in extra.items())
    )
    leaves.write.parquet(path)
    groups = grow(spark, spark.read.schema(leaves.schema).parquet(path), ["id", "node"], every)
    roots = groups.roots().select(F.lit("").alias("group_key"), F.col("group_key").alias("below"), F.col("root").alias("node"))
    return Manifest(groups, grow(spark, roots, ["below"], every))
