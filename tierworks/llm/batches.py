"""Arrow batches of (id, text) rows, cut into pieces of bounded size for the Python side of an operator.

A piece holds at most ``CHARS`` characters, or one text if that text alone is longer, so a worker's
memory follows the longest single text and never the number of rows in a batch. Workers outlive their tasks
and serve all operators in turn, so what a batch has freed goes back to the system behind it.
"""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHARS = 1 << 19


def on_workers(spark: SparkSession) -> None:
    """Put this package on the path of Python workers that share the driver's files; clusters ship it as they like."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own; a null text is empty."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


@functools.cache
def _trim() -> Callable[[int], int]:
    """What makes the C library return freed memory to the system; not every one has it."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda _: 0


def give_back() -> None:
    """Return the memory that was freed, but kept for later, to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(batch: pa.RecordBatch, chars: int = CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batch with their texts; the column ``text`` holds no nulls."""
    lengths = pc.binary_length(batch.column("text")).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > chars:
            part = batch.slice(start, i - start)
            yield part, part.column("text").to_pylist()
            start, total = i, 0
        total += n
    if start < len(lengths):
        part = batch.slice(start)
        yield part, part.column("text").to_pylist()


def whole_pieces(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batch, all columns, with the texts of column ``at``; a null text is empty."""
    start = 0
    for part, texts in pieces(pa.RecordBatch.from_arrays([pc.fill_null(batch.column(at), "")], ["text"])):
        yield batch.slice(start, part.num_rows), texts
        start += part.num_rows


def map_texts(
    df: DataFrame, per_piece: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch | None], schema: str, chars: int = CHARS,
    at_end: Callable[[], None] | None = None,
) -> DataFrame:
    """``per_piece`` over every piece of every batch; it may return None for no rows. ``at_end`` ends every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part, texts in pieces(batch, chars):
                    made = per_piece(part, texts)
                    if made is not None:
                        yield made
                batch = part = texts = made = None
                give_back()
        finally:
            if at_end is not None:
                at_end()
                give_back()

    return df.mapInArrow(run, schema)


def bucket(key: Column, n: int) -> Column:
    """A stable bucket number of a key, 0 to n - 1."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def keep_rows(df: DataFrame, text_col: str, mask: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text ``mask`` keeps; nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in whole_pieces(batch, at):
                yield part.filter(pa.array(mask(texts), pa.bool_()))
            batch = part = texts = None
            give_back()

    return df.mapInArrow(run, df.schema)


def change_texts(df: DataFrame, text_col: str, change: Callable[[list[str]], list[str]]) -> DataFrame:
    """``df`` with every non-null text changed; the other columns stay as they are."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in whole_pieces(batch, at):
                changed = pa.array(change(texts), part.schema.field(at).type)
                changed = pc.if_else(pc.is_valid(part.column(at)), changed, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], changed, *part.columns[at + 1 :]], schema=part.schema)
            batch = part = texts = changed = None
            give_back()

    return df.mapInArrow(run, df.schema)


def crc32_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))
