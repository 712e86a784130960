"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius
share a variant; in a bucket of one variant, a member within the smaller half is within the radius of all
others, so a star around it keeps every link. A bucket holds no more fingerprints than a ball of half the
radius, whatever the data. Links are verified by their bit distance, then connected.

Cases: a null text is empty; a text without words has the fingerprint zero and links like any other;
rows with the same text share a fingerprint and so a component; an empty table gives an empty result;
only the id and text columns are read. A null id takes part but never names a component of other rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierworks.llm.batches import id_text, map_texts
from tierworks.llm.components import components
from tierworks.operators.shape import keep_one as first_per_key
from tierworks.session import new_work_path

SEED = 42
BLOCK = 255  # rows whose bits can be summed in one byte each
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: str, words_per_shingle: int) -> list[int]:
    """XXH64 of every shingle of words of the ASCII-lower-cased text, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return []
    if len(words) <= words_per_shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[: len(words) - words_per_shingle]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :], strict=True)]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each group of hashes, the bits set in more than half of them. An empty group has none."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    blocks = -(-sizes // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + within * BLOCK
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(full), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat(SPREAD[octets[:, k]], starts).view(np.uint8).reshape(-1, 8)
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.astype(np.int64), first_block, axis=0)
    bits = (2 * ones > sizes[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def text_key(text):
    """The hash that tells the texts of one id apart, of a string column."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(df: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row per text: doc_id, fp (the 64 bits as a signed long) and, if asked for, the text's :func:`text_key`."""

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        lists = [shingle_hashes(t, words_per_shingle) for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        prints = majorities(np.fromiter(itertools.chain.from_iterable(lists), np.uint64, counts.sum()), counts)
        columns = {"doc_id": part.column("doc_id"), "fp": pa.array(prints.view(np.int64))}
        if keyed:
            keys = np.array([xxhash.xxh64_intdigest(t.encode(), SEED) for t in texts], np.uint64)
            columns["key"] = pa.array(keys.view(np.int64))
        return pa.RecordBatch.from_pydict(columns)

    return map_texts(id_text(df, id_col, text_col), per_piece, "doc_id long, fp long" + ", key long" * keyed)


def masks(bits: int) -> list[tuple[int, int]]:
    """All 64-bit masks of up to ``bits`` set bits, as signed longs, with their number of bits."""
    made = []
    for n in range(bits + 1):
        for places in itertools.combinations(range(64), n):
            value = sum(1 << p for p in places)
            made.append((value - (1 << 64) if value >= 1 << 63 else value, n))
    return made


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Verified links u, v among the distinct values of the column ``fp``; they keep all components."""
    near, far = max_bits // 2, max_bits - max_bits // 2
    ball = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("bits")) for m, n in masks(far)])
    variants = (
        prints.select("fp").distinct().select("fp", F.explode(ball).alias("x"))
        .select("fp", "x.bits", F.col("fp").bitwiseXOR(F.col("x.mask")).alias("variant"))
    )
    first = Window.partitionBy("variant").orderBy("bits", "fp")
    return (
        variants.select("fp", F.first("fp").over(first).alias("center"), F.first("bits").over(first).alias("bits"))
        .where((F.col("bits") <= near) & (F.col("fp") != F.col("center")))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("center"))) <= max_bits)
        .select(F.greatest("fp", "center").alias("u"), F.least("fp", "center").alias("v"))
        .distinct()
    )


def stored(df: DataFrame, *arguments, keyed: bool = False) -> DataFrame:
    """The :func:`fingerprints` of ``df``, written once."""
    path = new_work_path(df.sparkSession, "fingerprints")
    fingerprints(df, *arguments, keyed=keyed).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rooted(prints: DataFrame, max_bits: int, first) -> DataFrame:
    """fp, root (a fingerprint) and ``first``, an aggregate taken per fingerprint, of every distinct fingerprint."""
    least = prints.groupBy("fp").agg(first.alias("first"))
    roots = components(links(prints, max_bits)).withColumnRenamed("node", "fp")
    return least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    df: DataFrame, words_per_shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id reachable over links)."""
    prints = stored(df, words_per_shingle, id_col, text_col)
    placed = rooted(prints, max_bits, F.min("doc_id"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    names = placed.join(named, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    """16 lowercase hex digits of a signed long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(df: DataFrame, words_per_shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for every component: the one with the smallest id, of its texts the one with the smallest key.

    Rows are told apart by id and text, so texts that share an id without being near each other all stay. Of several
    rows with one id and text the first by all columns stays; rows with a null id all stay.
    """
    prints = stored(df, words_per_shingle, id_col, text_col, keyed=True)
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    placed = rooted(prints, max_bits, F.min(own))
    chosen = placed.groupBy("root").agg(F.min("first").alias("chosen"))
    names = placed.join(chosen, "root").select("fp", "chosen")
    rows = prints.where("doc_id IS NOT NULL").join(names, "fp").where(F.col("chosen") != F.struct("doc_id", "key"))
    gone = rows.select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct()
    id_of, key_of = df[id_col].cast("long"), text_key(df[text_col])
    kept = df.join(gone, (id_of == gone["_gone_id"]) & (key_of == gone["_gone_key"]), "left_anti")
    again = prints.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again_id"), F.col("key").alias("_again_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if again.isEmpty():
        return kept
    same = (kept[id_col].cast("long") == again["_again_id"]) & (text_key(kept[text_col]) == again["_again_key"])
    several = kept.join(again, same, "left_semi").withColumn("_again_key", text_key(kept[text_col]))
    return kept.join(again, same, "left_anti").unionByName(first_per_key(several, [id_col, "_again_key"]).drop("_again_key"))
