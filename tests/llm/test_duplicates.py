"""SimHash groups, repeated byte strings, benchmark passages and top-k against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import LONG, ODD, best_products, fingerprint, linked, odd_table, prose, repeats, word_distance
from tierworks.llm import components, decontaminate, simhash, suffix_dedup, topk
from tierworks.llm.queries import QUERIES, table


def simhash_rows(found):
    return {(r["doc_id"], r["fp"] % 2**64): r["component_id"] for r in found.collect()}


def test_simhash_on_odd_rows(spark):
    found = simhash.near_duplicates(odd_table(spark)).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    for i, t in ODD:
        if i is not None:
            assert by_id[i]["fp"] % 2**64 == fingerprint(t)
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == by_id[3]["component_id"] == 1
    assert by_id[11]["component_id"] == 10 and by_id[5]["component_id"] == 5
    assert simhash.near_duplicates(odd_table(spark).limit(0)).count() == 0
    kept = simhash.keep_one(odd_table(spark))
    assert kept.columns == odd_table(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 9, 10]


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_within_a_radius(spark, bits):
    rng = random.Random(bits)
    centers = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centers for _ in range(12)})
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    found = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed * 2], "fp long"), bits)).collect()
    root = {r["node"]: r["root"] for r in found}
    want = linked(prints, bits)
    groups, got = {}, {}
    for p, s, w in zip(prints, signed, want, strict=True):
        groups.setdefault(w, set()).add(p)
        got.setdefault(root.get(s, s), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (7, 6)]
    random.Random(0).shuffle(edges)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


def test_op7_whole_table(spark, sf):
    rows = sorted(table(spark, sf, "documents").select("doc_id", "text").collect())
    prints = [fingerprint(t) for _, t in rows]
    want = {i: (f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, linked(prints, 2), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op7_simhash"](spark, sf).collect()} == want


def passages():
    rng = random.Random(3)
    words = ["the", "and", "ion", "é", "xy", "q", "lorem", "ipsum", "dolor"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(n))
    p, q = text(60), text(45)
    docs = [(k, text(rng.randint(0, 150)) + (p if k % 3 == 0 else "") + text(rng.randint(0, 40)) + (q if k % 2 else "") + text(20)) for k in range(30)]
    docs += [(100, p), (101, p), (101, p), (102, "a" * 3000), (103, "ab" * 300 + p[:250] + "ab" * 100), (104, None), (105, ""), (106, p[:199]), (107, p[:200])]
    docs += [(None, p + text(30)), (None, text(200)), (110, "=-" * 101 + text(80) + "=-" * 101), (111, text(300)[:100] * 20), (112, LONG[:5000])]
    return docs + [(200 + k, text(30) + p[:230] + text(50)) for k in range(100)]


def repeat_rows(df):
    found = suffix_dedup.remove_repeats(df).collect()
    for r in found:
        assert r["n_removed"] == sum(b - a for a, b in zip(r["starts"], r["ends"], strict=True)) and r["n_spans"] == len(r["starts"])
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=repr)


@pytest.mark.parametrize(("shard", "few"), [(1 << 20, 10_000), (3000, 20)])
def test_repeated_strings(spark, monkeypatch, shard, few):
    """With the second setting, frequent anchors are dealt by document and their shards merged."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    docs = passages()
    assert repeat_rows(odd_table(spark, docs).repartition(5)) == repeats(docs)


def test_no_repeated_strings(spark):
    assert repeat_rows(odd_table(spark).limit(0)) == []
    assert repeat_rows(odd_table(spark, [(1, "short"), (2, prose(100, 1))])) == repeats([(1, "short"), (2, prose(100, 1))])


def test_suffix_array_of_a_shard():
    rng = random.Random(5)
    contents = [bytes(rng.choice(b"ab") for _ in range(rng.randint(200, 400))) for _ in range(20)]
    contents += [contents[0][:230] + contents[1][5:240], b"a" * 500, b"ab" * 150]
    shard = suffix_dedup.Shard(contents)
    windows = [(c[i : i + 200]) for c in contents for i in range(len(c) - 199)]
    places = [(s + i) for s, c in zip(shard.starts.tolist(), contents, strict=True) for i in range(len(c) - 199)]
    assert [bool(shard.twice[p]) for p in places] == [windows.count(w) > 1 for w in windows]
    distinct = [shard.raw[p : p + 200].tobytes() for p in shard.sorted_windows.tolist()]
    assert distinct == sorted(set(windows))


def test_regions_in_blocks(monkeypatch):
    """Regions tile the windows of every text, equal windows have one anchor, and blocks of any size give the same."""
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"ab c") for _ in range(n)) for n in (0, 5, 199, 200, 201, 700, 0, 1200)]
    texts += [texts[5][100:450], b"a" * 600, texts[7], b""]
    raw, begins, ends = suffix_dedup.side_by_side(texts)
    anchors, starts, stops = (x.tolist() for x in suffix_dedup.regions(raw, begins, ends))
    windows = [(w, a) for a, x, y in zip(anchors, starts, stops, strict=True) for w in range(x, y - 199)]
    assert [w for w, _ in windows] == [w for x, y in zip(begins.tolist(), ends.tolist(), strict=True) for w in range(x, y - 199)]
    assert len({(raw[w : w + 200].tobytes(), a) for w, a in windows}) == len({raw[w : w + 200].tobytes() for w, _ in windows})
    for block in (1, 64, 333):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        assert [x.tolist() for x in suffix_dedup.regions(raw, begins, ends)] == [anchors, starts, stops]


def test_suffixes_sorted_by_two_or_three_ranks(monkeypatch):
    rng = random.Random(11)
    contents = [bytes(rng.choice(b"ab") for _ in range(rng.randint(200, 300))) for _ in range(10)] + [b"ab" * 150, b"b" * 400]
    contents += [contents[0][20:] + b"a", b"b" + contents[0]]
    found = []
    for bits in (21, 1):
        monkeypatch.setattr(suffix_dedup, "RANK_BITS", bits)
        shard = suffix_dedup.Shard(contents)
        found.append((shard.twice.tolist(), [shard.raw[p : p + 200].tobytes() for p in shard.sorted_windows.tolist()]))
    assert found[0] == found[1]


def test_an_only_content_needs_no_suffix_array(spark, monkeypatch):
    """Texts that repeat as a whole are removed by their regions; no shard gets their bytes."""
    rows, made = suffix_dedup.region_rows, []
    monkeypatch.setattr(suffix_dedup, "region_rows", lambda *a, **k: made.append(rows(*a, **k)) or made[-1])
    docs = [(k, prose(200, k % 7)) for k in range(21)]
    assert repeat_rows(odd_table(spark, docs)) == repeats(docs)
    assert made and sum(m.count() for m in made) == 0


def test_op4_whole_table(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op4_suffix_dedup"](spark, sf).collect()), key=repr)
    assert got == repeats([(r["doc_id"], r["text"]) for r in rows])


def edited(item, edits, seed):
    return decontaminate.perturbed(np.arange(len(item), dtype=np.int32), edits, -1, np.random.default_rng(seed)).tolist()


def test_passages_within_the_distance(spark):
    items = [(k, prose(12 + 3 * k, 100 + k)) for k in range(12)] + [(50, None), (51, "  "), (52, "three short words"), (None, prose(30, 7)), (53, prose(15, 103))]
    docs, want = [(9900, None), (9901, ""), (9902, prose(400, 999)), (9903, "three short words")], set()
    for k, text in items[:12]:
        words = text.split()
        for edits in range(decontaminate.allowed(len(words), 0.8) + 3):
            changed = " ".join(words[i] if i >= 0 else "zzz" for i in edited(words, edits, 31 * k + edits))
            docs.append((100 * k + edits, f"{prose(40, k)} {changed.upper()}, {prose(30, k + 50)}"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(odd_table(spark, docs), benchmark).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found}
    for i, text in docs:
        for k, item in items:
            own, around = decontaminate.words(item or ""), decontaminate.words(text or "")
            if own:
                d = word_distance(own, around)
                near = d <= decontaminate.allowed(len(own), 0.8)
                if near or d <= decontaminate.allowed(len(own), 0.65) and word_distance(" ".join(own), " ".join(around)) <= 0.2 * len(" ".join(own)):
                    want.add((i, k, d))
    assert {(i, k, d) for (i, k), d in got.items()} <= want
    assert len(got) >= 0.95 * len(want) and {(i, k) for i, k, d in want if d == 0} <= set(got)
    assert (9903, 52) in got
    kept = decontaminate.keep_clean(odd_table(spark, docs), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got} and kept.columns == odd_table(spark).columns
    assert decontaminate.contaminated(odd_table(spark, docs), benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(odd_table(spark).limit(0), benchmark).count() == 0


def test_passages_with_changed_characters(spark):
    rng = random.Random(4)
    items = [(k, prose(30, 700 + k)) for k in range(20)]
    noisy = lambda t: "".join(rng.choice("abcde") if c != " " and rng.random() < 0.04 else c for c in t)
    docs = [(k, f"{prose(50, 800 + k)} {noisy(text)} {prose(50, 900 + k)}") for k, text in items]
    found = decontaminate.contaminated(odd_table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) >= 19 and all(r["doc_id"] == r["item_id"] and r["similarity"] >= 0.8 for r in found)


def test_passages_with_many_changed_characters():
    # evenly spread noise leaves few whole words; what is wanted comes from the plain edit distance of characters
    rng = random.Random(6)
    items = [(k, decontaminate.words(prose(16 + k, 1700 + k))) for k in range(40)]
    index = decontaminate.build(items)
    for rate in (0.08, 0.12, 0.15, 0.18):
        noisy = ["".join(rng.choice("abcde") if c != " " and rng.random() < rate else c for c in " ".join(w)) for _, w in items]
        want = {k for k, w in items if word_distance(" ".join(w), noisy[k]) <= 0.2 * len(" ".join(w))}
        found = index.search([f"{prose(50, 1800 + k)} {text} {prose(50, 1900 + k)}" for k, text in enumerate(noisy)])
        got = {t for t, i, _, _ in found if t == i}
        assert len(want) >= 30 and len(got & want) >= 0.95 * len(want), (rate, len(want), len(got & want))
        assert all(similar >= 0.8 for _, _, _, similar in found)


def test_spelled_distances_of_many_lengths():
    rng = random.Random(8)
    points = decontaminate.code_points("".join(rng.choice("abc") for _ in range(300)))
    items = sorted((decontaminate.code_points("".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))) for _ in range(40)), key=len, reverse=True)
    low = np.array([rng.randint(0, 200) for _ in items])
    high = low + np.array([rng.randint(1, 60) for _ in items])
    got = decontaminate.spelled_distance(items, points, low, high)
    assert got.tolist() == [word_distance(x.tolist(), points[a:b].tolist()) for x, a, b in zip(items, low, high, strict=True)]


def test_repetitions_are_never_too_few_in_silence(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_REPETITIONS", 8)
    with pytest.raises(ValueError, match="recall"):
        decontaminate.build([(1, prose(40, 3).split())], recall=0.999999)


def lettered(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("etaoinshrdlucmfwypvb") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def test_every_class_of_lengths_is_found_in_a_mixed_benchmark():
    # long replaced words leave no seeds, so the walk alone has to find them
    items = dict([(k, lettered(200, 2000 + k)) for k in range(8)] + [(100 + k, lettered(6, 3000 + k)) for k in range(150)] + [(400 + k, lettered(40, 4000 + k)) for k in range(16)])
    index = decontaminate.build(list(items.items()))
    for length, keys in ((200, range(8)), (40, range(400, 416))):
        texts, want = [], []
        for k in keys:
            for seed in range(5):
                kept = edited(items[k], decontaminate.allowed(length, 0.8), 100 * k + seed)
                changed = [items[k][i] if i >= 0 else "z" * 40 + str(j) for j, i in enumerate(kept)]
                texts.append(" ".join([*lettered(20, seed), *changed, *lettered(20, seed + 1)]))
                want.append(k)
        found = {(t, index.item_ids[i]) for t, i, _, _ in index.search(texts)}
        assert sum((t, k) in found for t, k in enumerate(want)) >= 0.9 * len(want), length


@pytest.mark.parametrize("n", [257, 6000])
def test_long_items_are_found_by_their_parts(n):
    item, rng = lettered(n, n), random.Random(n)
    index = decontaminate.build([(7, item), (8, lettered(30, 5))])
    noisy = [w if rng.random() > 0.1 else "q" * 30 for w in item]
    found = index.search([" ".join([*lettered(200, 1), *noisy, *lettered(200, 2)]), " ".join(lettered(3000, 3)), " ".join(item[: n // 4]), ""])
    assert [(t, index.item_ids[i]) for t, i, _, _ in found] == ([(0, 7), (2, 7)] if n > 1024 else [(0, 7)])


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    items = [(k, prose(20, 300 + k)) for k in range(7)]
    docs = [(k, f"{prose(10, 400 + k)} {text}") for k, text in items] + [(99, prose(100, 5))]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(odd_table(spark, docs), benchmark)
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found.collect()) == [(k, k, 0) for k in range(7)]
    assert [r["doc_id"] for r in decontaminate.keep_clean(odd_table(spark, docs), benchmark).collect()] == [99]
    assert {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated_ids(found).collect()} == {k: [k] for k in range(7)}


def test_op2_finds_every_exact_passage(spark, sf):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontaminate"](spark, sf).collect()}
    items = {r["item_id"]: f" {' '.join(decontaminate.words(r['text']))} " for r in table(spark, sf, "benchmark").collect()}
    docs = {r["doc_id"]: f" {' '.join(decontaminate.words(r['text'] or ''))} " for r in table(spark, sf, "documents").collect()}
    exact = {(i, k) for i, t in docs.items() for k, item in items.items() if item in t}
    assert exact <= got
    for i, k in got - exact:
        item = items[k].split()
        assert word_distance(item, docs[i].split()) <= decontaminate.allowed(len(item), 0.65)


def test_one_row_of_each_group_though_ids_repeat(spark):
    a, b, c = (prose(40, n) for n in (901, 902, 903))
    rows = [(1, a), (2, b), (2, a), (2, b), (3, c), (3, b), (4, ""), (4, None), (None, a), (5, a + " "), (6, prose(40, 904)), (6, prose(40, 905))]
    kept = simhash.keep_one(odd_table(spark, rows))
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=repr)
    # a stays as 1, b as 2 (once), c as 3 although another text of 3 goes, one empty text, the row without an id, both of 6
    assert got == sorted([(1, a), (2, b), (3, c), (4, ""), (None, a), (6, rows[-2][1]), (6, rows[-1][1])], key=repr)
    assert kept.columns == odd_table(spark).columns


def test_keys_of_texts_are_those_of_spark(spark):
    texts = [None, "", "a", "é漢😀", *("x" * n for n in (3, 4, 7, 8, 15, 31, 32, 33, 1000))]
    df = odd_table(spark, list(enumerate(texts)))
    want = {r["doc_id"]: r["k"] for r in df.select("doc_id", simhash.text_key(df["text"]).alias("k")).collect()}
    assert {r["doc_id"]: r["key"] for r in simhash.fingerprints(df, keyed=True).collect()} == want


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 256]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0, None] * 4), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (None, [1.0] * 8), (210, [0.5] * 3), (211, [0.25] * 3), (220, [0.5, -2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, d int, part int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.repartition(3), F.col("id") % 10 == 0, k=5, rows=16).collect())
    good = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    ids, vectors = [i for i, _ in good], [v for _, v in good]
    assert got == best_products(ids, vectors, [i for i in ids if i % 10 == 0], 5)
    assert topk.top_k(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_top_k_of_large_numbers(spark):
    rows = [(i, [float(2**20 + i), float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") < 3, k=4).collect())
    assert got == best_products(list(range(30)), [[int(x) * 256 for x in v] for _, v in rows], [0, 1, 2], 4)


def test_top_k_beyond_the_range_of_long(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, -1.0]), (2, [2e18, 5.0]), (3, [-1e18, 0.0]), (4, [1e200, 0.0]), (5, [1e307, 0.0]), (6, [3.0, 4.0]), (7, [1e305, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") < 3, k=5, rows=3).collect()}
    good = {i: [int(x * 256) for x in v] for i, v in rows if i != 5}  # 256e307 is no finite double
    for q in range(3):
        exact = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in exact]


def test_whole_numbers_as_bytes_sort_alike():
    numbers = sorted({s * n for n in (0, 1, 2, 255, 256, 257, 65535, 65536, 2**63, 2**64 - 1, 3**500) for s in (1, -1)})
    assert sorted(numbers, key=topk.sortable) == numbers
    assert all(topk.lower_bar(n) <= n for n in numbers)


def test_top_k_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (12, 32))
    vectors = [(centers[i % 12] + rng.normal(0, 0.05, 32)).round(4).tolist() for i in range(1200)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    asked, ids = F.col("id") % 50 == 0, list(range(1200))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, asked, k=5, rows=128).collect())
    assert got == best_products(ids, [[int(np.floor(x * 256)) for x in v] for v in vectors], ids[::50], 5)
    left = {r["segments"]: r["pairs"] for r in topk.pruning(df, asked, k=5, rows=128).collect()}
    assert left[0] == 24 * 1200 and list(sorted(left)) == [0, 4, 8, 16, 32]
    assert left[4] >= left[8] >= left[16] >= left[32] and left[16] < 0.15 * left[0]


@pytest.mark.parametrize("scale", [1, 2**9, 2**21])
def test_top_k_in_many_tiles_sends_no_vectors_through_the_driver(spark, monkeypatch, scale):
    """Single, double and whole numbers of any size; ties, k beyond what a block gives, other lengths, every block in tiles of its own."""
    monkeypatch.setattr(topk, "PAIRS", 1)
    monkeypatch.setattr(topk, "GROUP", 1)
    rng = np.random.default_rng(5)
    vectors = [[int(x) * scale for x in rng.integers(-9, 10, 16 if i % 3 else 4)] for i in range(300)]
    vectors[40:90] = [vectors[40]] * 50  # ties
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = [i for i in range(300) if i % 7 == 0]
    for k in (3, 20):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") % 7 == 0, k=k, rows=16).collect())
        assert got == best_products(list(range(300)), vectors, asked, k)
    work = topk.blocks(df, F.col("id") % 7 == 0, 3, 256, "vec_id", "embedding", 16)
    assert {r["offered"] for r in work.select("offered").collect()} == {False, True}
    joins = [line for line in work._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("[id#" in line for line in joins)  # with the bars; vectors meet without a join
