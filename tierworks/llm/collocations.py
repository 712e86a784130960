"""Collocations: phrases whose words stand together far more often than apart, the best of each language.

A phrase's score is the lowest over its cuts of a^2 / (l r): a its own count, l and r those of the two parts.
Phrases grow word by word, best first. A phrase is never more frequent than its beginning, so with the
beginning's count p and its first word's count f no longer phrase scores above p / f: that bound decides which beginnings
are grown. The first frontier of every language is all frequent words (their bound is the same, 1); of the pairs
those are grown whose bound reaches a threshold, in rounds: as long as fewer than the wanted number of phrases at or
above the threshold survive, the threshold of that language falls, at last to 0, where everything is grown.
What survives at the threshold is settled then: every pair scoring that much has been grown at both ends, so it is known
whether a longer phrase replaces it. Counting is over all documents; each pass counts only
what the frontier allows, told by Bloom filters of bounded size, whose false hits are counted exactly like any other phrase.

Cases: a null text is empty; a null language is ``und``; empty texts and pieces have no words; ties are broken by count and
phrase; repeated rows count each time; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierworks.llm.batches import map_texts
from tierworks.session import new_work_path

LEAST = 10  # occurrences of a phrase
BEST = 2000  # phrases reported of each language
REPLACES = 50  # per cent of a phrase's occurrences from which a longer phrase replaces it
SCALE = 1_000_000
MARGIN = 2  # the first threshold is the score that this many times the wanted phrases reach, before replacement
CHARS = 1 << 20  # characters counted at once
WINDOW = 1 << 19  # words counted at once, so three of their numbers fit 63 bits
BITS_PER_PHRASE, MOST_BITS, BITMAP = 12, 1 << 27, 1 << 15

# A to Z become a to z, the marks that end a piece become one mark, and tabs become blanks.
TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"." * 10 + b" ")


def words_of(texts: list[str]) -> list[bytes]:
    """The words of the texts in order, with a ``.`` wherever a piece ends."""
    return b".".join(t.encode() for t in texts).translate(TABLE).replace(b".", b" . ").split()


def windows(words: list[bytes], length: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """(distinct words, number of each word or -1 at the end of a piece, places where a phrase may begin)."""
    for at in range(0, len(words), WINDOW):
        part = pa.array(words[at : at + WINDOW + length - 1], pa.binary()).dictionary_encode()
        end = pc.index(part.dictionary, pa.scalar(b".", pa.binary())).as_py()
        codes = part.indices.to_numpy().astype(np.int64)
        yield part.dictionary, np.where(codes == end, -1, codes), min(WINDOW, len(words) - at)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One 64-bit number for two of them, in order."""
    m = (first + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    m = ((m ^ (m >> np.uint64(29))) + second) * np.uint64(0x94D049BB133111EB)
    return m ^ (m >> np.uint64(32))


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def spots(numbers: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three bits of each number in a filter of so many bits (a power of two)."""
    mask = np.uint64(bits - 1)
    turned = numbers * np.uint64(0xD6E8FEB86659FD93)
    return [(numbers & mask).astype(np.int64), ((numbers >> np.uint64(32)) & mask).astype(np.int64), ((turned >> np.uint64(29)) & mask).astype(np.int64)]


@dataclasses.dataclass
class Filter:
    """A Bloom filter of phrases, sent to the tasks; at most 16 MB."""

    bits: int
    content: object  # broadcast bytes

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.content.value, np.uint8)
        found = np.ones(len(numbers), bool)
        for spot in spots(numbers, self.bits):
            found &= (table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
        return found


def make_filter(phrases: DataFrame) -> Filter:
    """A filter of (lang, phrase) rows; the bits are gathered per 4 KB on the executors."""
    bits = min(MOST_BITS, max(BITMAP, 1 << (BITS_PER_PHRASE * max(1, phrases.count())).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                own = hashes(lang, phrase.encode().split(b" "))
                numbers.append(own[0] if len(own) == 1 else mixed(own[:1], own[1:])[0])
            spot = np.concatenate([*spots(np.array(numbers, np.uint64), bits), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(spot // BITMAP), pa.array(spot % BITMAP)], ["block", "bit"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "block long, bit long").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    content = bytearray(bits // 8)
    for row in found.collect():
        at = row["block"] * BITMAP // 8
        content[at : at + BITMAP // 8] = row["bitmap"]
    return Filter(bits, phrases.sparkSession.sparkContext.broadcast(bytes(content)))


Allowed = Callable[[np.ndarray, np.ndarray], np.ndarray]


def counted(df: DataFrame, length: int, allowed: Allowed | None = None) -> DataFrame:
    """(lang, phrase, a) of the phrases of ``length`` words that ``allowed`` lets pass, over all texts.

    ``allowed`` gets the numbers of the words of a window, in order, and says of every place whether the phrase
    beginning there counts. For single words a row with an empty phrase holds the number of all words.
    """

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
            by_lang.setdefault(lang, []).append(text)
        made: list[tuple[str, pa.Array, pa.Array]] = []
        for lang, own in by_lang.items():
            for distinct, codes, begins in windows(words_of(own), length):
                if len(codes) < length:
                    continue
                places = len(codes) - length + 1
                inside = np.arange(places) < begins
                key = np.zeros(places, np.int64)
                for k in range(length):
                    inside &= codes[k : k + places] >= 0
                    key = key * len(distinct) + codes[k : k + places]
                if length == 1:
                    made.append((lang, pa.array([""]), pa.array([int(inside.sum())], pa.int64())))
                if allowed is not None:
                    numbers = hashes(lang, distinct.to_pylist())
                    inside &= allowed(numbers[codes], inside)
                counts = pc.value_counts(pa.array(key[inside], pa.int64()))
                rest, parts = counts.field("values").to_numpy(zero_copy_only=False), []
                for _ in range(length):
                    rest, last = np.divmod(rest, max(1, len(distinct)))
                    parts.insert(0, distinct.take(pa.array(last, pa.int64())))
                phrase = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
                made.append((lang, phrase.cast(pa.string()), counts.field("counts").cast(pa.int64())))
        langs = pa.concat_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(p), np.int64))) for lang, p, _ in made] or [pa.array([], pa.string())])
        phrases = pa.concat_arrays([p for _, p, _ in made] or [pa.array([], pa.string())])
        counts = pa.concat_arrays([c for _, _, c in made] or [pa.array([], pa.int64())])
        return pa.RecordBatch.from_arrays([langs, phrases, counts], ["lang", "phrase", "a"])

    return map_texts(df, per_piece, "lang string, phrase string, a long", CHARS).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def ratio(over: list[Column], under: list[Column]) -> Column:
    """floor(SCALE * product / product) in exact numbers."""
    wide = [c.cast("decimal(14,0)") for c in over]
    top = F.lit(SCALE).cast("decimal(7,0)") * wide[0] * (wide[1] if len(wide) > 1 else F.lit(1).cast("decimal(1,0)"))
    below = under[0].cast("decimal(14,0)")
    for c in under[1:]:
        below = below * c.cast("decimal(14,0)")
    return F.call_function("div", top, below)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (lang, phrase, a) with the counts of both words, the score, and the bound of all longer phrases."""
    left = words.select("lang", F.col("phrase").alias("w1"), F.col("a").alias("l"))
    right = words.select("lang", F.col("phrase").alias("w2"), F.col("a").alias("r"))
    split = pairs.withColumn("w1", F.substring_index("phrase", " ", 1)).withColumn("w2", F.substring_index("phrase", " ", -1))
    found = split.join(left, ["lang", "w1"]).join(right, ["lang", "w2"])
    a, f, r = F.col("a"), F.col("l"), F.col("r")
    return found.select("lang", "phrase", "a", "l", "r", ratio([a, a], [f, r]).alias("score"), ratio([a], [f]).alias("bound"))


def scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples (lang, phrase, a) with the parts' counts at the lowest cut and the score."""
    head = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f12"), F.col("l").alias("f1"))
    tail = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    split = triples.withColumn("head", F.substring_index("phrase", " ", 2)).withColumn("tail", F.substring_index("phrase", " ", -2))
    a = F.col("a")
    cuts = (
        split.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
        .withColumn("early", ratio([a, a], [F.col("f1"), F.col("f23")])).withColumn("late", ratio([a, a], [F.col("f12"), F.col("f3")]))
    )
    first = F.col("early") <= F.col("late")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return cuts.select("lang", "phrase", "a", pick("f1", "f12").alias("l"), pick("f23", "f3").alias("r"), pick("early", "late").alias("score"))


def thresholds(pairs: DataFrame, wanted: int) -> DataFrame:
    """(lang, floor): the highest score that ``wanted`` pairs of the language reach, 0 if it has fewer.

    Taken from a histogram of the scores, which has at most a million and one values a language.
    """
    histogram = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    reach = histogram.withColumn("reach", F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("score").desc())))
    return reach.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reach") >= wanted, F.col("score"))), F.lit(0)).alias("floor"))


def survivors(pairs: DataFrame, triples: DataFrame, replaces: int) -> DataFrame:
    """Triples, and the pairs that no triple holding them replaces."""
    inside = [triples.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), F.col("a").alias("longer")) for k in (2, -2)]
    longest = inside[0].unionByName(inside[1]).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = pairs.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < replaces * F.col("a")))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    return kept.select(columns).unionByName(triples.select(columns))


def grown(spark: SparkSession, docs: DataFrame, pairs: DataFrame, least: int, best: int, replaces: int, path: str) -> DataFrame:
    """The survivors at or above each language's last threshold, at least ``best`` of them or all there are."""
    every_pair = make_filter(pairs)
    wanted, rounds, triples, before = MARGIN * best, 0, None, None
    while True:
        floors = thresholds(pairs, wanted)
        if before is not None:  # only languages that need it go on
            floors = before.join(floors, "lang").select("lang", F.when(F.col("open"), F.col("floor")).otherwise(F.col("old")).alias("floor"), "old")
        else:
            floors = floors.withColumn("old", F.lit(None).cast("long"))
        floors = stored(floors, f"{path}/floors-{rounds}")
        at = pairs.join(floors, "lang")
        fresh = lambda c: (F.col(c) >= F.col("floor")) & (F.col("old").isNull() | (F.col(c) < F.col("old")))
        heads, tails = make_filter(at.where(fresh("bound"))), make_filter(at.where(fresh("score")))

        def allowed(numbers: np.ndarray, inside: np.ndarray, heads: Filter = heads, tails: Filter = tails) -> np.ndarray:
            at = np.flatnonzero(inside)
            head, tail = mixed(numbers[at], numbers[at + 1]), mixed(numbers[at + 1], numbers[at + 2])
            passed = np.zeros(len(inside), bool)
            passed[at] = (heads.holds(head) & every_pair.holds(tail)) | (tails.holds(tail) & every_pair.holds(head))
            return passed

        new = stored(counted(docs, 3, allowed).where(F.col("a") >= least), f"{path}/triples-{rounds}")
        triples = new if triples is None else triples.unionByName(new)
        once = triples.groupBy("lang", "phrase").agg(F.max("a").alias("a"))  # a round that counts a phrase counts all of it
        reached = survivors(pairs, scored_triples(once, pairs), replaces).join(floors.select("lang", "floor"), "lang").where(F.col("score") >= F.col("floor"))
        reached = stored(reached, f"{path}/reached-{rounds}")
        enough = reached.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        before = floors.join(enough, "lang", "left").select(
            "lang", F.col("floor").alias("old"), ((F.coalesce("n", F.lit(0)) < best) & (F.col("floor") > 0)).alias("open")
        )
        before = stored(before, f"{path}/state-{rounds}")
        if before.where("open").isEmpty():
            return reached
        wanted, rounds = wanted * 4, rounds + 1


def collocations(
    df: DataFrame, least: int = LEAST, best: int = BEST, replaces: int = REPLACES, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The first ``best`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = df.sparkSession
    path = new_work_path(spark, "collocations")
    docs = df.select(F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    words = stored(counted(docs, 1).where((F.col("a") >= least) | (F.col("phrase") == "")), f"{path}/words")
    totals, frequent = words.where("phrase = ''").select("lang", F.col("a").alias("n")), words.where("phrase <> ''")
    known = make_filter(frequent)

    def allowed(numbers: np.ndarray, inside: np.ndarray) -> np.ndarray:
        often = known.holds(numbers)
        return often[:-1] & often[1:]

    pairs = stored(scored_pairs(counted(docs, 2, allowed).where(F.col("a") >= least), frequent), f"{path}/pairs")
    found = grown(spark, docs, pairs, least, best, replaces, path)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
