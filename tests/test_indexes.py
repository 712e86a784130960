"""Text index, unbounded traversal, salted join, fingerprints and the exact split, each against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tierworks.operators import glossary, lineage, olap, predict, profile, sketches
from tierworks.operators.joins import skewed_join
from tierworks.operators.lattice import Lattice
from tierworks.operators.textindex import TextIndex, pattern_grams
from tierworks.session import cut_lineage, new_work_path

TEXTS = {
    "a1": "the quick brown fox", "a2": "PII and a c# b", "a3": "", "a4": None, "a5": "é漢字😀 ende", "a6": "aaaaabaaa", "a7": "x", "a8": "ab", "a9": "it's a.b\\E*c (d)",
    "b1": "quick" * 3000, "b2": "tag:red", "b3": "zzé", "b4": "fr", "b5": "afr frb", "b6": "a\x00b",
}
TAGS = {"a1": ["red"], "a2": ["red", "blue", "red"], "a6": None, "b1": ["blue"], "b4": ["red"]}


@pytest.fixture(scope="module")
def index(spark):
    data = [(i, t, TAGS.get(i), i.upper()) for i, t in TEXTS.items()] + [(None, "the", ["red"], "")]
    df = spark.createDataFrame(data, "id string, text string, classes array<string>, name string")
    return TextIndex.build(df, new_work_path(spark, "index"), F.col("classes"))


def holds(text, pattern):
    return text is not None and pattern.lower() in text.lower()


@pytest.mark.parametrize("pattern", ["quick", "qu", "k", "aab", "aaaaabaaa", "é", "漢", "漢字😀", "😀 e", "ba", "nothing here", "tag", "tag:red", "\\E*", " ", "x", "QUICKquick"])
def test_texts_that_hold_a_pattern(index, pattern):
    assert sorted(r["id"] for r in index.holding(pattern).collect()) == sorted(i for i, t in TEXTS.items() if holds(t, pattern))


def test_patterns_are_covered():
    assert pattern_grams("abcdefgh") == {0: "abc", 3: "def", 5: "fgh"} and pattern_grams("ab") == {0: "ab"} and pattern_grams("abc") == {0: "abc"}


def test_a_lookup_reads_its_own_postings(index):
    plan = index.holding("quick")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(gram") >= 2 and "texts" not in plan.replace("(texts", "")


def test_pages_follow_the_last_name(index):
    seen, after = [], None
    while True:
        page = [r["id"] for r in index.page("a", limit=2, after=after).collect()]
        if not page:
            break
        seen, after = seen + page, page[-1]
    assert seen == sorted(i for i, t in TEXTS.items() if holds(t, "a"))
    assert [r["id"] for r in index.page(None, ["red"]).collect()] == ["a1", "a2", "b4"]
    assert [r["name"] for r in index.page("a", ["red", "blue"]).collect()] == ["A2"]
    assert index.page("no such", ["red"]).count() == 0


def links(terms):
    out = set()
    for term, alias in terms:
        a = (alias or "").lower()
        for i, t in TEXTS.items():
            t = (t or "").lower()
            if a and (a in t if len(a) > 2 else re.search(rf"(^|[^a-z0-9]){re.escape(a)}([^a-z0-9]|$)", t)):
                out.add((term, i))
    return sorted(out, key=repr)


def test_terms_meet_the_texts_that_hold_an_alias(spark, index):
    terms = [("T1", "quick"), ("T1", "fr"), ("T2", "c#"), ("T3", "漢"), ("T4", "x"), ("T5", "absent words"), ("T6", "é"), ("T7", "A.B"), ("T8", "\\E"), ("T9", "#"), (None, "fox"), ("T10", None), ("T11", "")]
    found = index.links(spark.createDataFrame(terms, "term string, alias string"))
    assert rows(found) == links(terms)
    first = glossary.link_indexed(spark.createDataFrame(terms, "term string, alias string"), index, first=1)
    assert [tuple(r) for r in first.where("term = 'T1'").collect()] == [("T1", "a1", 1)]


def test_the_plan_does_not_grow_with_the_terms(spark, index):
    def operators(n):
        terms = spark.createDataFrame([(f"T{i}", f"word{i}") for i in range(n)], "term string, alias string")
        return len(index.links(terms)._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert operators(3) == operators(10_000)


def test_random_texts_and_aliases(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab cé#") for _ in range(rng.randint(1, n)))
    texts = {f"d{i}": word(30) for i in range(40)}
    index = TextIndex.build(spark.createDataFrame(list(texts.items()), "id string, text string"), new_work_path(spark, "index"))
    terms = [(f"T{i}", word(5)) for i in range(60)]
    want = set()
    for term, a in terms:
        for i, t in texts.items():
            if a in t if len(a) > 2 else re.search(rf"(^|[^a-z0-9]){re.escape(a)}([^a-z0-9]|$)", t):
                want.add((term, i))
    assert {tuple(r) for r in index.links(spark.createDataFrame(terms, "term string, alias string")).collect()} == want


def test_aliases_that_share_their_grams_do_not_meet_each_others_texts(spark):
    """What is looked at is what the texts hold, not the names times the texts that share a gram with them."""
    names = spark.range(1200).select(F.format_string("t%05d", "id").alias("id"), F.concat(F.lit("raw_"), F.col("id")).alias("text"))
    index = TextIndex.build(names, new_work_path(spark, "index"))
    terms = names.select(F.col("text").alias("term"), F.col("text").alias("alias"))
    want = sum(len(str(i)) for i in range(1200))  # the beginnings of every number
    assert index.links(terms).count() == want
    assert index.parts(terms.select(F.col("alias").alias("part"))).count() == want


def reached(edges, starts):
    out = set()
    for s in starts:
        level, seen, depth = {s}, {s}, 0
        while level:
            depth += 1
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            out |= {(s, "down", n, depth) for n in level}
    return sorted(out, key=repr)


def test_closure_through_cycles_hubs_and_chains(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(25)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x"), ("x", "x"), ("y", "z"), ("z", "c20")]
    hub = [("h", f"l{i}") for i in range(300)] + [(f"l{i}", "x") for i in range(300)]
    edges = chain + cycle + hub
    df = spark.createDataFrame([*edges, (None, "x"), ("x", None)], "src string, dst string")
    starts = spark.createDataFrame([("c00",), ("x",), ("h",), ("h",), ("none",), (None,)], "node string")
    want = reached(set(edges), ["c00", "x", "h", "none"])
    assert rows(lineage.trace(df, starts, None, "down")) == want
    assert rows(lineage.trace(df, starts, 6, "down")) == [r for r in want if r[3] <= 6]
    # the short walk finds the same, and so does the way up on turned links
    assert rows(lineage.trace(df, starts, 3, "down")) == [r for r in want if r[3] <= 3]
    turned = df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    assert rows(lineage.trace(turned, starts, None, "up").drop("direction")) == [(a, n, d) for a, _, n, d in want]
    assert lineage.trace(df, starts.limit(0), None, "both").count() == 0


def test_closure_of_long_runs_takes_few_levels(spark, monkeypatch):
    """A ring of 600 and runs of unlike length between the same two nodes, in rounds that grow with the forks alone."""
    cuts = []
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    ring = [(i, (i + 1) % 600) for i in range(600)]
    long = [(1000 + i, 1001 + i) for i in range(40)]
    short = [(1000, 2000), (2000, 2001), (2001, 1040), (1040, 3000), (3000, 3001), (3001, 1000)]
    apart = [(5000, 5001), (5001, 5002), (5002, 5000)]
    edges = ring + long + short + apart + [(1010, 4000), (4000, 1020)]
    df = spark.createDataFrame(edges, "src long, dst long")
    starts = spark.createDataFrame([(0,), (1000,), (1005,), (2001,)], "node long")
    want = reached(set(edges), [0, 1000, 1005, 2001])
    assert rows(lineage.trace(df, starts, None, "down")) == want
    assert len(cuts) < 40
    assert rows(lineage.trace(df, starts, 17, "down")) == [r for r in want if r[3] <= 17]


def test_no_pair_of_single_rows_is_made_to_be_dropped(spark):
    """The rows that stand for several are told apart before the join."""
    left = spark.createDataFrame([(1, i % 7) for i in range(40)], "k int, a int")
    right = spark.createDataFrame([(1, i) for i in range(30)], "k int, b int")
    met = skewed_join(left, right, "k", 100)
    assert rows(met) == rows(left.join(right, "k"))
    text = met._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.splitlines() if "Join" in line and "__lc" in line]



def test_skewed_join_rows_and_balance(spark, no_broadcast):
    rng = random.Random(2)
    left = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(4)) for _ in range(400)] + [(1, 99)] * 150
    right = [(rng.choice([None, 1, 1, 2, 5]), rng.randrange(3)) for _ in range(40)]
    a, b = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, y int")
    got = skewed_join(a, b, "k", cell_rows=100)
    want = sorted((k, x, y) for k, x in left for j, y in right if k is not None and k == j)
    assert sorted(tuple(r) for r in got.collect()) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
        small = spark.range(20_000).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") * 2 + 1).alias("k"), F.col("id").alias("y"))
        sizes = [r["n"] for r in skewed_join(big, small, "k", cell_rows=10_000).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_001 * 200 + 19_800
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]


def test_skewed_join_uses_every_task_though_its_input_is_small(spark):
    """A small input with many pairs: neither one task makes them all, nor is a side broadcast, and every pair is made by one join."""
    left = spark.range(3000).select((F.col("id") % 1).alias("k"), (F.col("id") % 2900).alias("x"))
    right = spark.range(500).select((F.col("id") % 1).alias("k"), (F.col("id") % 400).alias("y"))
    met = skewed_join(left, right, "k", cell_rows=10_000)
    assert rows(met.groupBy("k").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y"))) == rows(left.join(right, "k").groupBy("k").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y")))
    sizes = [r["n"] for r in met.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 3000 * 500 / 8
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_fingerprints_tell_tables_apart(spark):
    schema = "a string, b string, c double, m map<string,int>"
    base = [("x", None, 1.0, {"k": 1}), (None, "x", 2.0, None), ("x", None, 1.0, {"k": 1}), ("", "", None, {})]

    def same(other, reorder=False):
        a, b = spark.createDataFrame(base, schema), spark.createDataFrame(other, schema)
        return {r["same"] for r in olap.same_rows(a, b.select("m", "c", "b", "a") if reorder else b).collect()}.pop()

    assert same(base[::-1]) and same(base, True)
    assert not same(base[:3]) and not same([*base[:2], base[1], base[3]]) and not same([(None, "x", 1.0, {"k": 1}), *base[1:]])
    assert not same([*base, base[0], base[0]]) and not same([])
    plan = olap.same_rows(spark.createDataFrame(base, schema), spark.createDataFrame(base, schema))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_split_keeps_every_class_to_one_row(spark):
    data = [(i, "a") for i in range(1000)] + [(i, "b") for i in range(1000, 1003)] + [(2000, None), (2001, "c")]
    marked = predict.stratified_split(spark.createDataFrame(data, "id int, label string"), ["id"], "label")
    n = {r["label"]: (r["t"], r["n"]) for r in marked.groupBy("label").agg(F.count_if("is_train").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"a": (800, 1000), "b": (2, 3), None: (1, 1), "c": (1, 1)} and marked.columns == ["id", "label", "is_train"]
    half = predict.stratified_split(spark.createDataFrame(data, "id int, label string"), ["id"], "label", 0.5, seed=1)
    assert half.where("label = 'a' AND is_train").count() == 500
    assert predict.stratified_split(spark.createDataFrame([], "id int, label string"), ["id"], "label").count() == 0


def test_profiles_merge_from_sketches(spark):
    schema = "a int, b string, c double, d decimal(10,2), e array<int>, f int"
    rng = random.Random(6)
    made = [(rng.randrange(5000), rng.choice([None, "", "  ", "x", "y"]), rng.choice([1.5, float("nan"), None, -2.0]), None, [rng.randrange(3)], i) for i in range(6000)]
    store = sketches.SketchStore(spark, new_work_path(spark, "sketches"))
    assert store.profile("t").count() == 0
    for at in range(3):
        store.append(spark.createDataFrame(made[at::3], schema), "t", at)
    store.append(spark.createDataFrame(made[1::3], schema), "t", 1)  # run again
    store.append(spark.createDataFrame([], schema), "t", 7)
    store.append(spark.createDataFrame(made[:5], schema), "other", 0)
    whole = spark.createDataFrame(made, schema)
    got = {r["column_name"]: r for r in store.profile("t").collect()}
    for want in profile.columns(whole, "t").collect():
        r = got[want["column_name"]]
        for c in ("table_name", "position", "data_type", "row_count", "null_count", "null_pct", "completeness_pct"):
            assert r[c] == want[c]
        assert abs(r["distinct_count"] - want["distinct_count"]) <= 0.04 * want["distinct_count"]
    values = sorted(r[0] for r in made)
    assert got["f"]["low"] == 0 and got["f"]["high"] == 5999 and abs(got["f"]["p50"] - 3000) < 120
    assert abs(got["a"]["p95"] - values[int(0.95 * 6000)]) < 150 and (got["c"]["low"], got["c"]["high"]) == (-2.0, 1.5)
    assert got["b"]["p50"] is None and got["d"]["low"] is None and got["e"]["high"] is None


def test_lattice_answers_from_the_smallest_level(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, 2020, 2021, 2022]), rng.choice(["n", "s", None]), rng.choice("abcde"), rng.randrange(9), rng.random()) for _ in range(500)]
    df = spark.createDataFrame(data, "year int, region string, unit string, n int, top double")
    cube = Lattice.build(
        df, new_work_path(spark, "cube"), [("year", "region", "unit"), ("year", "region"), ("region", "unit"), ("year",), ()], {"n": "sum", "top": "max"}
    )
    assert cube.level_for([]) == 4 and cube.level_for(["year"]) == 3 and cube.level_for(["region"]) == 1 and cube.level_for(["unit"]) == 2 and cube.level_for(["unit", "year"]) == 0
    plain = lambda by, where=None: df.where(where or "true").groupBy(*by).agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    for by in ([], ["year"], ["region"], ["unit", "region"], ["year", "unit"]):
        assert rows(cube.answer(by)) == rows(plain(by))
    assert rows(cube.answer(["unit"], {"year": [2020, None], "region": "n"})) == rows(plain(["unit"], "(year = 2020 OR year IS NULL) AND region = 'n'"))
    assert rows(cube.answer(["year"], {"region": None})) == rows(plain(["year"], "region IS NULL"))
    assert cube.rollup(["year", "region"]).count() == plain(["year", "region"]).count() + 4 + 1
    matrix = {r["region"]: (r["2020"], r["2021"]) for r in cube.pivot(["region"], "year", [2020, 2021], F.col("n")).collect()}
    assert matrix["n"] == tuple(sum(r[3] for r in data if r[1] == "n" and r[0] == y) for y in (2020, 2021))
    assert "level=4" in str(cube.answer([]).inputFiles()) and len(cube.answer(["year"]).inputFiles()) > 0
    with pytest.raises(ValueError):
        Lattice.build(df, "x", [("year",), ("region",)], {"n": "sum"})
    with pytest.raises(ValueError):
        Lattice.build(df, "x", [("year",)], {"n": "avg"})
    empty = Lattice.build(df.limit(0), new_work_path(spark, "cube"), [("year", "region"), ("year",)], {"n": "sum"})
    assert empty.answer(["year"]).count() == 0
