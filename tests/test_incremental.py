"""Sliced tables and facts refreshed by batches, against full rebuilds."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierworks.operators import catalog
from tierworks.operators.incremental import CountFact, Maintained, Measure, StateSource
from tierworks.session import new_work_path
from tierworks.sources.slices import SlicedTable


def sliced(spark, keys, slices=4, buckets=2):
    where = new_work_path(spark, "sliced")
    return SlicedTable(spark, "tierworks_test", "t" + where.rsplit("-", 1)[1], keys, where, slices, buckets)


def add(both):
    return both.select("k", F.coalesce(F.col("old.n") + F.col("new.n"), "old.n", "new.n").alias("n"))


def test_a_merge_rewrites_the_touched_slices_only(spark):
    table = sliced(spark, ("k",))
    table.create(spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 1)], "k int, n int"))
    before = {(r[0], r[1]) for r in table.files().collect()}
    batch = spark.createDataFrame([(3, 5), (100, 7), (None, 2)], "k int, n int")
    touched = table.merge(batch, add, 1)
    assert 0 < len(touched) < 4
    want = {i: 1 for i in range(40)} | {3: 6, 100: 7, None: 3}
    assert {r["k"]: r["n"] for r in table.read().collect()} == want
    after = {(r[0], r[1]) for r in table.files().collect()}
    assert {f for f in before if f[0] not in touched} == {f for f in after if f[0] not in touched}
    assert not {f for f in before if f[0] in touched} & after
    # the same batch again changes nothing, an empty one neither
    assert table.merge(batch, add, 1) == [] and table.merge(batch.limit(0), add, 2) == []
    assert {r["k"]: r["n"] for r in table.read().collect()} == want


def test_only_the_batch_is_shuffled(spark, no_broadcast):
    table = sliced(spark, ("k", "m"))
    table.create(spark.createDataFrame([(i, "x", i) for i in range(50)], "k int, m string, n int"))
    batch = spark.createDataFrame([(1, "x", 5), (1, None, 5)], "k int, m string, n int")
    plan = table.matched(batch, table.touched(batch))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 2 out of 2" in plan
    found = {(r["k"], r["m"]): r for r in table.matched(batch, table.touched(batch)).collect()}
    assert found[(1, "x")]["old"]["n"] == 1 and found[(1, None)]["old"] is None


def test_stored_upsert_equals_the_upsert(spark):
    rng = random.Random(1)

    def entities(n, tag):
        picked = [(f"{tag}{i}", f"q{rng.randrange(20)}", f"{tag}-{i}", rng.choice([None, 1, 2, 3])) for i in range(n)]
        return spark.createDataFrame(picked, "guid string, qualifiedName string, description string, version int")

    old = catalog.upsert(entities(1, "z").limit(0), entities(30, "a"))
    table = sliced(spark, ("qualifiedName",))
    table.create(old)
    want = old
    for at in (1, 2):
        new = spark.createDataFrame(entities(8, f"b{at}-").dropDuplicates(["qualifiedName"]).collect(), old.schema)
        want = spark.createDataFrame(catalog.upsert(want, new).collect(), want.schema)
        catalog.upsert_stored(table, new, at)
        assert rows(table.read().select(*want.columns)) == rows(want)


def source(population=None):
    one = F.lit(1).cast("bigint")
    return StateSource(
        ("user",),
        (
            Measure("spent", F.col("amount")), Measure("first", F.col("year"), "min"), Measure("last", F.struct("year", "amount"), "max"),
            Measure("vip", F.col("amount") > 8, "any"),
        ),
        {
            "cohorts": CountFact(
                ("first",), ("users", "spenders"), lambda s: s.select("first", one.alias("users"), F.when(F.col("spent") >= 10, one).otherwise(0).alias("spenders"))
            ),
            "vips": CountFact(
                ("vip",), ("users", "last_amounts"), lambda s: s.select("vip", one.alias("users"), F.coalesce("last.amount", F.lit(0)).cast("bigint").alias("last_amounts"))
            ),
        },
        population,
    )


def purchases(spark, rng, n):
    made = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([None, 2001, 2002, 2003]), rng.choice([None, 1, 5, 9])) for _ in range(n)]
    return spark.createDataFrame(made, "user int, year int, amount int")


def kept(spark, population=None):
    where = new_work_path(spark, "kept")
    return Maintained(spark, "tierworks_test", "m" + where.rsplit("-", 1)[1], where, {"users": source(population)}, slices=2, buckets=2)


def same_as_rebuilt(made, all_rows, population=None):
    states = made.sources["users"].folded(all_rows).withColumn("seen", F.lit(True))
    if population is not None:
        unseen = population.join(states, "user", "left_anti").withColumn("seen", F.lit(False))
        states = states.unionByName(unseen, allowMissingColumns=True)
    for name, fact in made.sources["users"].facts.items():
        want = fact.counted(states)
        assert rows(made.read_counts("users", name).select(*want.columns)) == [r for r in rows(want) if any(r[1:])]


@pytest.mark.parametrize("with_population", [False, True])
def test_refreshed_counts_equal_a_rebuild(spark, with_population):
    rng = random.Random(7 + with_population)
    population = spark.createDataFrame([(i,) for i in (1, 2, 8, 9)], "user int") if with_population else None
    all_rows = purchases(spark, rng, 12)
    made = kept(spark, population)
    made.build("users", all_rows)
    for at, n in enumerate((5, 0, 9), 1):
        batch = purchases(spark, rng, n)
        made.refresh("users", batch, at)
        all_rows = all_rows.unionByName(batch)
    same_as_rebuilt(made, all_rows, population)


def test_a_refresh_that_broke_off_is_run_again(spark, monkeypatch):
    rng = random.Random(3)
    first, batch = purchases(spark, rng, 15), purchases(spark, rng, 6)
    made = kept(spark)
    made.build("users", first)
    real, calls = SlicedTable.merge, []

    def breaking(self, *args):
        calls.append(self.name)
        if len(calls) == 2:  # the states are merged, the counts are not
            raise RuntimeError("lost")
        return real(self, *args)

    monkeypatch.setattr(SlicedTable, "merge", breaking)
    with pytest.raises(RuntimeError):
        made.refresh("users", batch, 1)
    made.refresh("users", batch, 1)
    made.refresh("users", batch, 1)
    same_as_rebuilt(made, first.unionByName(batch))


def test_unknown_fold(spark):
    with pytest.raises(ValueError):
        Measure("x", F.lit(1), "avg")
