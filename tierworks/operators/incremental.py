"""Facts kept up to date from batches alone.

Rows of a source are folded into one state row per entity (sums, extremes, flags: whatever can be combined
later without the rows). A fact holds additive counts per group; each entity gives its share of them from its state.
A batch is folded the same way, its entities' states are combined with the old ones, and the fact changes by
the difference of the shares: new minus old. Only the batch, the states of its entities and the groups
they belong to are read; percentages and targets are taken from the counts afterwards, as in a full build.

The differences of a batch are written before anything is changed, and every table notes the last batch it
holds, so a refresh that broke off is run again with the same number and ends in the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.sources.slices import SlicedTable

HOW = ("sum", "min", "max", "any")


@dataclass(frozen=True)
class Measure:
    """A column of the state: what it takes from a row, and how two values combine. NULL is no value."""

    name: str
    of: Column
    how: str = "sum"

    def __post_init__(self) -> None:
        if self.how not in HOW:
            raise ValueError(f"how must be one of {HOW}, not {self.how!r}")

    def folded(self) -> Column:
        fold = {"sum": F.sum, "min": F.min, "max": F.max, "any": F.bool_or}[self.how]
        return fold(self.of).alias(self.name)

    def combined(self) -> Column:
        old, new = F.col(f"old.{self.name}"), F.col(f"new.{self.name}")
        if self.how == "sum":
            both = old + new
        elif self.how == "any":
            both = old | new
        else:
            both = (F.least if self.how == "min" else F.greatest)(old, new)
        return F.coalesce(both, old, new).alias(self.name)


@dataclass(frozen=True)
class CountFact:
    """Additive counts per group. ``shares`` turns state rows (key, measures, ``seen``) into rows of grain and counts.

    ``seen`` is false for an entity of the population that has no rows yet.
    """

    grain: tuple[str, ...]
    counts: tuple[str, ...]
    shares: Callable[[DataFrame], DataFrame]

    def counted(self, states: DataFrame) -> DataFrame:
        return self.shares(states).groupBy(*self.grain).agg(*[F.sum(c).alias(c) for c in self.counts])


@dataclass(frozen=True)
class StateSource:
    """Rows of a source as states: the entity's key, its measures, the facts made of them, and entities that count without rows."""

    keys: tuple[str, ...]
    measures: tuple[Measure, ...]
    facts: Mapping[str, CountFact]
    population: DataFrame | None = None

    def folded(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[m.folded() for m in self.measures])


@dataclass
class Maintained:
    """Stored states and counts of some sources; ``location`` is a folder all executors reach."""

    spark: SparkSession
    layer: str
    prefix: str
    location: str
    sources: Mapping[str, StateSource]
    slices: int = 16
    buckets: int = 4
    rewritten: dict[str, list[int]] = field(default_factory=dict)  # slices the last refresh rewrote, by table

    def state(self, source: str) -> SlicedTable:
        return SlicedTable(
            self.spark, self.layer, f"{self.prefix}_state_{source}", self.sources[source].keys, self.location, self.slices, self.buckets
        )

    def counts(self, source: str, fact: str) -> SlicedTable:
        """The counts of a fact; few rows, so one bucket a slice."""
        grain = self.sources[source].facts[fact].grain
        return SlicedTable(self.spark, self.layer, f"{self.prefix}_counts_{fact}", grain, self.location, self.slices, 1)

    def build(self, source: str, rows: DataFrame) -> None:
        """States and counts of all rows there are."""
        spec = self.sources[source]
        self.state(source).create(spec.folded(rows))
        states = self.state(source).read().withColumn("seen", F.lit(True))
        if spec.population is not None:
            unseen = spec.population.select(*spec.keys).distinct().join(states, list(spec.keys), "left_anti")
            states = states.unionByName(unseen.withColumn("seen", F.lit(False)), allowMissingColumns=True)
        for name, fact in spec.facts.items():
            self.counts(source, name).create(fact.counted(states))

    def refresh(self, source: str, batch: DataFrame, number: int) -> None:
        """Bring one batch of rows in. The same number again changes nothing more."""
        spec, where = self.sources[source], f"{self.location.rstrip('/')}/{self.prefix}-{source}-{number}"
        state = self.state(source)
        new = self._once(f"{where}/batch", lambda: spec.folded(batch))
        touched = state.touched(new)
        changes = {}
        for name, fact in spec.facts.items():
            changes[name] = self._once(f"{where}/{name}", lambda fact=fact: self._change(spec, fact, state.matched(new, touched, "right")))
        # from here on every step may be repeated
        measures = [m.combined() for m in spec.measures]
        self.rewritten[source] = state.merge(new, lambda both: both.select(*spec.keys, *measures), number)
        for name, fact in spec.facts.items():
            added = [F.coalesce(F.col(f"old.{c}") + F.col(f"new.{c}"), f"old.{c}", f"new.{c}").alias(c) for c in fact.counts]
            self.rewritten[name] = self.counts(source, name).merge(changes[name], lambda both, f=fact, a=added: both.select(*f.grain, *a), number)

    def _change(self, spec: StateSource, fact: CountFact, both: DataFrame) -> DataFrame:
        """Counts after the batch minus counts before it, of the groups whose counts change."""
        keys = [F.col(k) for k in spec.keys]
        before = both.select(*keys, "old.*", F.col("old").isNotNull().alias("seen"))
        if spec.population is not None:  # who is not of the population counts only once seen
            known = spec.population.select(*spec.keys, F.lit(True).alias("known")).distinct()
            before = before.join(known, list(spec.keys), "left").where(F.col("seen") | F.col("known")).drop("known")
        else:
            before = before.where("seen")
        after = both.select(*keys, *[m.combined() for m in spec.measures], F.lit(True).alias("seen"))
        down = fact.counted(before).select(*fact.grain, *[(-F.col(c)).alias(c) for c in fact.counts])
        total = [F.sum(c).cast(t).alias(c) for c, t in fact.counted(before).select(*fact.counts).dtypes]
        moved = fact.counted(after).unionByName(down).groupBy(*fact.grain).agg(*total)
        return moved.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in fact.counts]))

    def _once(self, path: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What was written to the path in full, written now if it was not."""
        try:
            self.spark.read.parquet(f"{path}/done")
        except AnalysisException:
            build().write.mode("overwrite").parquet(f"{path}/rows")
            self.spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
        return self.spark.read.parquet(f"{path}/rows")

    def read_counts(self, source: str, fact: str) -> DataFrame:
        """The counts of all groups that have any."""
        counts: Sequence[str] = self.sources[source].facts[fact].counts
        return self.counts(source, fact).read().where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in counts]))
