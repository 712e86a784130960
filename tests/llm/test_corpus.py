"""Collocations, Merkle manifest and quality: brute force, SQL on the whole table, held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import LONG, ODD, ascii_lower, auc, odd_table
from tierworks.llm import collocations, merkle, quality
from tierworks.llm.queries import ORACLE, QUERIES, table


@pytest.mark.parametrize("name", ["op11_collocations", "op12_merkle"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE[name])
    at = [[d[0] for d in cur.description].index(c) for c in got.columns]
    want = sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want


# ---- collocations -----------------------------------------------------------------


def best_phrases(docs, least, best, replaces):
    """Everything counted, straight from the description."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    out = []
    for lang in n:
        kept = []
        for (g, p), (score, a, left, right) in found.items():
            longer = [q for h, q in found if h == lang and len(q) > len(p) and p in (q[:2], q[1:])]
            if g == lang and not any(100 * f[lang, q] >= replaces * a for q in longer):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, docs=60, words=40, vocabulary=12):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)] + ["É", "é", "Z", "漢"]
    fixed = ["new York city", "w1 w2 w3", "san Francisco"]
    out = []
    for i in range(docs):
        text = "".join(rng.choice(fixed if rng.random() < 0.3 else names) + rng.choice([" ", " ", " ", " ", "\t ", ". ", "\n", ",", " ; "]) for _ in range(words))
        out.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return out


def mined(spark, docs, **options):
    df = spark.createDataFrame([(1, t, lang, 5) for lang, t in docs], "doc_id int, text string, lang string, a int")
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize(("least", "best", "replaces"), [(10, 2000, 50), (3, 7, 50), (2, 40, 5), (5, 1, 100)])
def test_collocations_equal_brute_force(spark, least, best, replaces):
    docs = corpus(least * 31 + best)
    assert mined(spark, docs, least=least, best=best, replaces=replaces) == best_phrases(docs, least, best, replaces)


def test_the_threshold_falls_until_enough_phrases_survive(spark, monkeypatch):
    # the best pairs are all replaced by longer phrases that score little, so the first threshold leaves nothing
    rng = random.Random(4)
    lines = [f"a{i} b{i} the" for i in range(60) for _ in range(3)] + [f"{rng.choice('pqrs')} {rng.choice('tuvw')}" for _ in range(400)]
    docs = [("en", ".".join(lines)), ("de", "x y. x y. x y. x z")]
    rounds, real = [], collocations.thresholds
    monkeypatch.setattr(collocations, "thresholds", lambda pairs, wanted: rounds.append(wanted) or real(pairs, wanted))
    assert mined(spark, docs, least=3, best=20) == best_phrases(docs, 3, 20, 50)
    assert len(rounds) > 1


def test_collocations_of_odd_rows(spark):
    docs = [("en", t) for _, t in ODD] + [(None, LONG), ("de", None), ("fr", " \t"), ("es", "A.a,a;a:a!a?a\na\x0ba\x0ca\rA")]
    assert mined(spark, docs, least=2) == best_phrases(docs, 2, 2000, 50)
    df = odd_table(spark)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_windows_of_a_long_text_lose_no_phrase(monkeypatch):
    words = collocations.words_of([" ".join(f"w{i % 7}" for i in range(50)) + ". x y z"])
    monkeypatch.setattr(collocations, "WINDOW", 8)
    for length in (1, 2, 3):
        seen = collections.Counter()
        for distinct, codes, begins in collocations.windows(words, length):
            for i in range(min(begins, len(codes) - length + 1)):
                if (codes[i : i + length] >= 0).all():
                    seen[tuple(distinct[int(c)].as_py() for c in codes[i : i + length])] += 1
        pieces = [[f"w{i % 7}".encode() for i in range(50)], [b"x", b"y", b"z"]]
        assert seen == collections.Counter(tuple(p[i : i + length]) for p in pieces for i in range(len(p) - length + 1))


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 30_000_000_007, 30_000_000_011, 40_000_000_003
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.ratio([F.col("a")] * 2, [F.col("l"), F.col("r")])).first()[0] == 1_000_000 * a * a // (left * right)


def test_a_filter_holds_all_its_phrases(spark):
    phrases = [("en", f"w{i}") for i in range(500)] + [("de", f"w{i} x{i}") for i in range(500)]
    made = collocations.make_filter(spark.createDataFrame(phrases, "lang string, phrase string"))
    number = lambda lang, p: (lambda h: h[0] if len(h) == 1 else collocations.mixed(h[:1], h[1:])[0])(collocations.hashes(lang, p.encode().split()))
    assert made.holds(np.array([number(*p) for p in phrases], np.uint64)).all()
    others = np.array([number("fr", p) for _, p in phrases], np.uint64)
    assert made.holds(others).mean() < 0.05 and made.bits <= collocations.MOST_BITS
    assert not collocations.make_filter(spark.createDataFrame([], "lang string, phrase string")).holds(others).any()


# ---- Merkle manifest --------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown_tree(leaves):
    """Levels from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, at):
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((at & 1, level[other] if other < len(level) else ""))
        at >>= 1
    return out


def manifest_rows(docs):
    """(id, leaf, subroot, root, digest of the proof, steps) of (id, lang, text) rows."""
    groups = collections.defaultdict(list)
    for i, lang, text in docs:
        groups["" if lang is None else "=" + lang].append((i is not None, i if i is not None else 0, leaf_of([i, text]), i))
    trees = {g: grown_tree([r[2] for r in sorted(own, key=lambda r: r[:3])]) for g, own in groups.items()}
    order = sorted(trees, key=str.encode)
    top, out = grown_tree([trees[g][-1][0] for g in order]), []
    for at, g in enumerate(order):
        for k, r in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            steps = path_of(trees[g], k) + path_of(top, at)
            out.append((r[3], r[2], trees[g][-1][0], top[-1][0], h(*(s for _, s in steps)), tuple(("", s) if not side else (s, "") for side, s in steps)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every", [1, 2, 8])
@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {"en": 3, "de": 5, "fr": 4, None: 2, "": 1}, {"en": 37, "é": 16, "z": 9}])
def test_manifest_equals_brute_force(spark, every, sizes):
    rng = random.Random(every)
    docs = [(rng.choice([None, *range(60)]), lang, rng.choice(["a", "b", None, "", "漢字"])) for lang, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("pos", F.lit(1)).withColumn("node", F.lit("x"))
    made = merkle.manifest(df, ["doc_id", "text"], every=every)
    found = made.proofs("id").withColumn("digest", merkle.proof_digest(F.col("steps"))).withColumn("again", merkle.folded(F.col("leaf"), F.col("steps")))
    got = sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["digest"], tuple(tuple(s) for s in r["steps"])) for r in found.collect()), key=repr)
    assert got == manifest_rows(docs)
    assert found.where("again <> root").count() == 0 and made.root() == got[0][3]
    # only every so many levels are stored
    assert made.groups.stored == 1 + max(1, *(-(-(n - 1).bit_length() // every) for n in sizes.values()))


def test_manifest_of_more_leaves_than_a_run_holds(spark):
    docs = [(i, "en" if i % 3 else "de", f"text {i}") for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    found = merkle.manifest(df, ["doc_id", "text"]).proofs("id").withColumn("digest", merkle.proof_digest(F.col("steps")))
    got = sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["digest"], tuple(tuple(s) for s in r["steps"])) for r in found.collect()), key=repr)
    assert got == manifest_rows(docs)


def test_a_changed_row_does_not_lead_to_the_root(spark):
    df = spark.createDataFrame([(i, "en", "t") for i in range(20)], "doc_id long, lang string, text string")
    other = merkle.row_digest([F.col("doc_id") + 1, F.col("text")])
    found = merkle.manifest(df, ["doc_id", "text"], other=other).proofs("other").select((merkle.folded(F.col("other"), F.col("steps")) == F.col("root")).alias("same"))
    assert {r["same"] for r in found.collect()} == {False}


def test_manifest_of_nothing_and_of_odd_rows(spark):
    made = merkle.manifest(odd_table(spark).limit(0), ["doc_id", "text"])
    assert made.root() is None and made.proofs("id").count() == 0
    docs = [(i, "en", t) for i, t in ODD]
    found = merkle.manifest(odd_table(spark), ["doc_id", "text"]).proofs("id")
    assert sorted(((r["id"], r["leaf"], r["root"]) for r in found.collect()), key=repr) == sorted(((r[0], r[1], r[3]) for r in manifest_rows(docs)), key=repr)


# ---- quality ----------------------------------------------------------------------


def test_held_out_quality(spark):
    where = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in QUERIES["op13_quality"](spark, where).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in found.items())
    marks = [(r["doc_id"], r["quality"]) for r in table(spark, where, "labels").collect() if found[r["doc_id"]]["held_out"]]
    scores, truth = [found[i]["score"] for i, _ in marks], [q for _, q in marks]
    assert auc(scores, truth) > 0.9
    assert np.mean([found[i]["predicted"] for i, q in marks if q == 1]) > 0.95
    assert np.mean([1 - found[i]["predicted"] for i, q in marks if q == 0]) > 0.75


def labelled(spark, n=60):
    rng = random.Random(9)
    words = ["stone", "river", "gentle", "morning", "window", "letter", "garden", "silver", "across", "under"]
    good = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(n)]
    bad = [(n + i, " ".join(rng.choice(["$$$%", "#!#!", "@@xx", "0x00"]) + str(rng.randrange(99)) for _ in range(120))) for i in range(n)]
    docs = odd_table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(2 * n)] + [(None, 1), (3, None), (5, 0)], "doc_id int, quality int")
    return docs, labels, good, bad


def test_quality_of_whole_texts(spark):
    docs, labels, good, bad = labelled(spark)
    model = quality.fit(docs, labels)
    assert model == quality.fit(docs, labels)
    clean, junk = good[0][1], bad[0][1]
    scores, saved = model.scores([clean, junk, clean * 30, junk * 30, clean * 4 + junk * 26, "", "stone"])
    assert scores[0] > 0.9 > 0.1 > scores[1] and scores[2] > 0.9 and scores[3] < 0.1 and scores[4] < 0.3
    assert saved[5] == 0 and ((scores >= 0) & (scores <= 1)).all()


def test_quality_of_odd_rows_and_few_labels(spark):
    docs, labels, *_ = labelled(spark)
    model = quality.fit(docs, labels)
    got = quality.score(odd_table(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got if r["doc_id"] in (1, 2)}
    assert by_id[1] == by_id[2] and quality.score(odd_table(spark).limit(0), model).count() == 0
    assert quality.fit(docs, labels.limit(0)).scores(["x", ""])[0].tolist() == [0.5, 0.5]
    only = quality.fit(docs, labels.where("quality = 1"))
    assert only.share > 0.9 and set(only.scores(["x", "$$$"])[0]) == {only.share}
    two = quality.fit(docs, labels.where("doc_id IN (1, 70)"))
    assert all(0 <= s <= 1 for s in two.scores(["stone", "$$$%1", ""])[0])
    assert quality.fit(docs.where("doc_id < 0"), labels).share > 0
