"""Quality of texts by compression.

One zstandard dictionary is built from texts labelled good, one from texts labelled bad. Every text is cut
into blocks of a fixed number of bytes, each compressed once with either dictionary; the bytes that the good
dictionary saves against the bad one, per byte of text, tell how much more the text resembles the good ones.
A logistic curve of that difference and the text's length, fitted on texts that the dictionaries measuring
them have not seen, turns it into a score.

Cases: a null text is empty; an empty text saves nothing and scores what the curve says of texts of no
length; null labels and ids are not learned from, of several labels of one id the largest counts; with
labels of one kind only every text scores their smoothed share (0.5 without labels); rows with the same id
stay separate; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierworks.llm.batches import crc32_bucket, id_text, map_texts
from tierworks.session import new_work_path

PER_LABEL = 1000  # labelled texts of each kind that are learned from
SAMPLES = 4096  # blocks of them, of each kind, that a dictionary is built from
SAMPLE_BYTES = 512
DICTIONARY = 1 << 16  # bytes of a dictionary
BLOCK = 2048  # bytes compressed at once
LEVEL = 3
FOLDS = 4
SHORT = 256  # bytes of text at which its length counts half


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of the samples: the builder's, or their plain content where they are too few for it."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@functools.lru_cache(maxsize=16)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compresses blocks with the dictionary, without any header."""
    bare = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None, compression_params=bare)


def saved(text: bytes, good: bytes, bad: bytes) -> float:
    """Bytes that the good dictionary saves against the bad one, per byte of the text."""
    with_good, with_bad = compressor(good).compress, compressor(bad).compress
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return sum(len(with_bad(b)) - len(with_good(b)) for b in blocks) / max(1, len(text))


def features(difference: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the curve is linear in: of long texts the difference decides, of short ones hardly."""
    short = SHORT / (SHORT + size)
    return np.stack([np.ones_like(difference), 100 * difference, short, 100 * difference * short], axis=1)


def logistic(rows: np.ndarray, labels: np.ndarray, prior: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps."""
    weights = np.zeros(rows.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + prior * weights
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + prior * np.eye(len(weights))
        weights -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return weights


@dataclasses.dataclass
class Model:
    """Dictionaries and curve; without dictionaries every text scores ``share``."""

    share: float = 0.5
    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = ()

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score and difference of each text."""
        if not self.weights:
            return np.full(len(texts), self.share), np.zeros(len(texts))
        raw = [t.encode() for t in texts]
        found = np.array([saved(r, self.good, self.bad) for r in raw], float)
        linear = features(found, np.array([len(r) for r in raw], float)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(linear, -30, 30))), found


def fit(
    df: DataFrame, labels: DataFrame, per_label: int = PER_LABEL,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """A model from at most ``per_label`` labelled texts of each kind, chosen by a hash of their ids.

    The sample is written once, each distinct text once. To the driver come its ids, at most 4,096 blocks of 512
    bytes of each kind, and a difference and a length for every text.
    """
    marks = labels.where(labels[id_col].isNotNull() & labels[label_col].isin(0, 1))
    marks = marks.groupBy(labels[id_col].cast("long").alias("key")).agg(F.max(label_col).alias("mark"))
    order = Window.partitionBy("mark").orderBy(F.xxhash64("key"), "key")
    chosen = marks.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label).collect()
    marked = {r["key"]: int(r["mark"]) for r in chosen}
    share = (sum(marked.values()) + 0.5) / (len(marked) + 1)
    if len(set(marked.values())) < 2:
        return Model(share)
    spark, path = df.sparkSession, new_work_path(df.sparkSession, "quality")
    good = F.col("doc_id").isin([k for k, m in marked.items() if m])
    texts = id_text(df.where(df[id_col].cast("long").isin(list(marked))), id_col, text_col)
    texts = texts.withColumn("mark", F.when(good, 1).otherwise(0)).groupBy("text").agg(F.max("mark").alias("mark"))
    texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")).write.parquet(path)
    sample = spark.read.schema("text string, mark int, fold int").parquet(path)

    def blocks(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        raw = [t.encode() for t in texts]
        owner, cut = [], []
        for i, r in enumerate(raw):
            mine = [r[k : k + SAMPLE_BYTES] for k in range(0, len(r), SAMPLE_BYTES)]
            owner += [i] * len(mine)
            cut += mine
        at = pa.array(owner, pa.int64())
        return pa.RecordBatch.from_arrays([part.column("mark").take(at), part.column("fold").take(at), pa.array(cut, pa.binary())], ["mark", "fold", "block"])

    by_hash = Window.partitionBy("mark").orderBy(F.xxhash64("block"), "block", "fold")
    cut = map_texts(sample, blocks, "mark int, fold int, block binary").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= SAMPLES)
    cut = sorted((r["mark"], r["n"], r["fold"], bytes(r["block"])) for r in cut.collect())

    def both(left_out: int | None) -> tuple[bytes, bytes]:
        return tuple(dictionary([b for m, _, f, b in cut if m == mark and f != left_out]) for mark in (1, 0))

    others = [both(f) for f in range(FOLDS)]

    def measured(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        raw = [t.encode() for t in texts]
        found = [saved(r, *others[f]) for r, f in zip(raw, part.column("fold").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("mark"), pa.array([len(r) for r in raw], pa.int64()), pa.array(found, pa.float64())], ["mark", "size", "difference"])

    seen = sorted(tuple(r) for r in map_texts(sample, measured, "mark int, size long, difference double").collect())
    if len({m for m, _, _ in seen}) < 2 or not all(both(None)):
        return Model(share)
    mark, size, difference = (np.array(c, float) for c in zip(*seen, strict=True))
    return Model(share, *both(None), tuple(logistic(features(difference, size), mark).tolist()))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, score (0 to 1, higher: better), difference (bytes saved per byte)."""

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        scores, found = model.scores(texts)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, pa.float64())], ["doc_id", "score", "difference"])

    return map_texts(id_text(df, id_col, text_col), per_piece, "doc_id long, score double, difference double")


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return crc32_bucket(id_col, 5) == 0
