"""Token ids of whole texts in a binary form: frequency ranks in byte-aligned variable-length coding.

A written set of ids is a folder of Parquet tables, so Spark's committer makes it whole and any store that
Spark reaches can hold it:

* ``ranks``: rank, id, n. Ids by falling frequency over all texts, ties by id.
* ``shards``: shard, start, n_ids. Shards hold ascending ranges of document ids.
* ``blocks/shard=...``: row, start, doc_ids, counts, control, data. Blocks of a shard in the order of ``row``;
  ``start`` counts ids from the beginning of the shard.

A block's ranks take one to four bytes each in ``data``; ``control`` holds two bits for each rank, four to a
byte. Decoding looks the lengths up in a table of 256 rows and the ids in the rank table.

Cases: a null or empty text has the end id only; rows with the same id are separate documents, in an order
fixed by their text; a null id sorts first; an empty table gives an empty set; only id and text are read.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.llm.batches import give_back, id_text, pieces
from tierworks.llm.bpe import REMEMBERED, Encoder
from tierworks.llm.pretokens import SPECIAL

BLOCK_IDS = 1 << 16  # a block ends with the text that reaches so many ids
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype(np.uint32)
    code = (ranks >> 8 > 0).astype(np.uint8) + (ranks >> 16 > 0) + (ranks >> 24 > 0)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    ends = np.cumsum(code.astype(np.int64) + 1)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - code - 1
    data[at] = ranks & 255
    for k in range(1, 4):
        longer = code >= k
        if not longer.any():
            break
        data[at[longer] + k] = ranks[longer] >> 8 * k & 255
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = raw[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        ranks[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


@functools.cache
def library_encoder(path: str) -> tuple[Encoder, int]:
    """The tokenizers library on distinct pre-tokens, and the size of its vocabulary.

    A byte-level merge never crosses a pre-token, so the ids of a text are those of its pre-tokens. Words go to
    the library in lines: a line break is a pre-token of its own before and after anything but white space.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    line_break = library.encode("\n", add_special_tokens=False).ids[0]

    def one_by_one(words: list[str]) -> tuple[list[int], list[int]]:
        found = [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]
        return [i for ids in found for i in ids], [len(ids) for ids in found]

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(words), np.int64)
        blank = np.array([w.isspace() for w in words], bool)
        plain = np.flatnonzero(~blank)
        lines = ["\n".join(words[i] for i in plain[a : a + 512].tolist()) + "\n" for a in range(0, len(plain), 512)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in library.encode_batch_fast(lines, add_special_tokens=False)), np.int32)
        breaks = np.flatnonzero(flat == line_break)
        counts[plain] = np.diff(np.append(-1, breaks)) - 1
        flat = flat[flat != line_break]
        if len(plain) == len(words):
            return flat, counts
        ids, own = one_by_one([words[i] for i in np.flatnonzero(blank).tolist()])
        counts[blank] = own
        out = np.empty(int(counts.sum()), np.int32)
        from_blank = np.repeat(blank, counts)
        out[from_blank], out[~from_blank] = ids, flat
        return out, counts

    return Encoder(encode_words, library.token_to_id(SPECIAL), remembered=2 * REMEMBERED), library.get_vocab_size(with_added_tokens=True)


TOKENIZED = "shard int, row long, doc_id long, start long, n int, ids binary"


def tokenized(df: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Texts in shards of ascending ids: shard, row within it, doc_id, start within it, n, ids (uint32 or uint16)."""
    rows = id_text(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = library_encoder(path)
        width = np.uint16 if max(size - 1, end_id) < 1 << 16 else np.uint32
        shard, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part, texts in pieces(batch):
                ids, counts = encoder.encode(texts)
                ids, ends = ids.astype(width), np.cumsum(counts)
                end = np.array([end_id], width).tobytes()
                raw = [ids[b - n : b].tobytes() + end for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                counts = counts + 1
                starts = start + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(texts), shard, np.int32)), pa.array(row + np.arange(len(texts))), part.column("doc_id"),
                        pa.array(starts.astype(np.int64)), pa.array(counts.astype(np.int32)), pa.array(raw, pa.binary()),
                    ],
                    ["shard", "row", "doc_id", "start", "n", "ids"],
                )
                row += len(texts)
                start += int(counts.sum())
            batch = part = texts = ids = raw = None
            give_back()

    return ordered.mapInArrow(run, TOKENIZED)


def unpack(raw: list[bytes], counts: list[int]) -> np.ndarray:
    """The ids of several texts in one array."""
    joined = b"".join(raw)
    width = np.uint16 if len(joined) == 2 * sum(counts) else np.uint32
    return np.frombuffer(joined, width)


def frequencies(tokens: DataFrame) -> DataFrame:
    """id, n over all texts; one row for each id leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_encoder.cache_clear()  # the worker goes on without the words of the stage before
        give_back()
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(unpack(batch.column("ids").to_pylist(), batch.column("n").to_pylist()))
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = "shard int, row long, start long, doc_ids array<long>, counts array<int>, control binary, data binary"


def blocks(tokens: DataFrame, rank_of: np.ndarray) -> DataFrame:
    """Texts packed into blocks, in the order they come."""

    def pack(group: list[dict]) -> dict:
        ids = unpack([g["ids"] for g in group], [g["n"] for g in group])
        control, data = encode_ranks(rank_of[ids])
        return {k: group[0][k] for k in ("shard", "row", "start")} | {
            "doc_ids": [g["doc_id"] for g in group], "counts": [g["n"] for g in group], "control": control, "data": data,
        }

    schema = pa.schema([
        ("shard", pa.int32()), ("row", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        size = 0
        for batch in batches:
            made = []
            for g in batch.select(["shard", "row", "start", "doc_id", "n", "ids"]).to_pylist():
                if group and (size >= BLOCK_IDS or g["shard"] != group[-1]["shard"] or g["row"] != group[-1]["row"] + 1):
                    made.append(pack(group))
                    group, size = [], 0
                group.append(g)
                size += g["n"]
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)
        if group:
            yield pa.RecordBatch.from_pylist([pack(group)], schema)

    return tokens.mapInArrow(run, BLOCKS)


def write_ids(df: DataFrame, target: str, path: str, end_id: int, work: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text with the tokenizer file ``path``, append ``end_id``, and write the ids to ``target``.

    ``work``: a folder for the ids between counting and coding.
    """
    spark = df.sparkSession
    tokenized(df, path, end_id, id_col, text_col).write.option("compression", "zstd").parquet(work)
    tokens = spark.read.parquet(work)
    # no more rows than the vocabulary has
    found = sorted((-r["n"], r["id"]) for r in frequencies(tokens).collect())
    ranked = spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(found)], "rank long, id long, n long")
    ranked.coalesce(1).write.parquet(f"{target}/ranks")
    ids = np.array([i for _, i in found], np.int64)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    sizes = {r["shard"]: r["n_ids"] for r in tokens.groupBy("shard").agg(F.sum(F.col("n").cast("long")).alias("n_ids")).collect()}
    starts, at = [], 0
    for shard in sorted(sizes):
        starts.append((shard, at, sizes[shard]))
        at += sizes[shard]
    spark.createDataFrame(starts, "shard int, start long, n_ids long").coalesce(1).write.parquet(f"{target}/shards")
    blocks(tokens, rank_of).write.option("compression", "zstd").partitionBy("shard").parquet(f"{target}/blocks")


def ids_by_rank(spark: SparkSession, target: str) -> np.ndarray:
    """The rank table; it has no more rows than the vocabulary."""
    rows = spark.read.parquet(f"{target}/ranks").select("rank", "id").collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: r["rank"])], np.int64)


def read_blocks(spark: SparkSession, target: str):
    """Blocks as a DataFrame, the function that decodes one block's ids, and the first id of each shard."""
    ids = ids_by_rank(spark, target).astype(np.uint32)
    starts = {r["shard"]: r["start"] for r in spark.read.parquet(f"{target}/shards").collect()}
    schema = "row long, start long, doc_ids array<long>, counts array<int>, control binary, data binary, shard int"
    return spark.read.schema(schema).parquet(f"{target}/blocks"), (lambda control, data, n: ids[decode_ranks(control, data, n)]), starts


def read_ids(spark: SparkSession, target: str) -> DataFrame:
    """One row per document of a written set: doc_id, start, ids."""
    stored, decode, starts = read_blocks(spark, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                counts = np.array(b["counts"], np.int64)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(decode(b["control"], b["data"], int(ends[-1])), pa.int64()))
                first = starts[b["shard"]] + b["start"] + ends - counts
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"], pa.int64()), pa.array(first), lists], ["doc_id", "start", "ids"])

    return stored.mapInArrow(run, "doc_id long, start long, ids array<long>")


def read_digests(spark: SparkSession, target: str) -> DataFrame:
    """One row per document of a written set: doc_id, start, n_tokens, ids_crc32; ids stay in the task."""
    stored, decode, starts = read_blocks(spark, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                counts = np.array(b["counts"], np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(decode(b["control"], b["data"], int(ends[-1])).astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                first = starts[b["shard"]] + b["start"] + ends - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(first), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
