"""The pipeline against its stages done by hand, and the registration of its queries."""

import hashlib
import re
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.check_oracles import connect, rows_of
from tests.llm.common import ODD, fingerprint, linked, odd_table
from tierworks.llm import batches, decontaminate, langid, secret_scan
from tierworks.llm.queries import ORACLE, QUERIES, table


def test_registered():
    names = __spark_entry__.queries()
    assert {*QUERIES, "pipeline"} <= set(names) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    df, cur = QUERIES[name](spark, sf), connect(sf).execute(ORACLE[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_pipeline_by_hand(spark, sf):
    documents = table(spark, sf, "documents")
    rows = sorted(documents.select("doc_id", "text").collect())
    model = langid.fit(documents.where(~langid.held_out(documents["doc_id"])))
    rejected = model.predict([t for _, t in rows])[2]
    rows = [r for r, bad in zip(rows, rejected, strict=True) if not bad]
    rows = [r for k, (r, c) in enumerate(zip(rows, linked([fingerprint(t) for _, t in rows], 2), strict=True)) if c == k]
    items = [f" {' '.join(decontaminate.words(r['text']))} " for r in table(spark, sf, "benchmark").collect()]
    rows = [r for r in rows if not any(item in f" {' '.join(decontaminate.words(r[1]))} " for item in items)]
    net = secret_scan.fit(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    texts = secret_scan.redacted([t for _, t in rows], net)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for (i, _), text in zip(rows, texts, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, sf, tmp_path):
    columns = table(spark, sf, "documents").columns
    docs = odd_table(spark, [(i, t) for i, t in ODD]).selectExpr("doc_id", "text", "lang", "source", "cast(n AS long) AS n_chars", "anchor AS fp", "n AS u")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0, name
        made = stage(spark, docs, sf)
        made.write.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns and set(columns) <= set(made.columns)
            docs = spark.read.parquet(str(tmp_path / str(k)))
    assert 0 < spark.read.parquet(str(tmp_path / "4")).count() <= len(ODD)


class OneBatch:
    """A table of one batch, mapped in this process."""

    columns, schema = ["n", "text"], None

    def __init__(self, batch):
        self.batch = batch

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter([self.batch])))


def test_rows_leave_in_pieces():
    """What a stage of whole rows holds at once follows the longest text, not the rows of a batch."""
    texts = ["x" * (batches.CHARS // 4), None, "", "long" * batches.CHARS, *["y" * (batches.CHARS // 4)] * 20, ""]
    table = OneBatch(pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts}))
    kept = batches.keep_rows(table, "text", lambda part: [t != "" for t in part])
    changed = batches.change_texts(table, "text", lambda part: [t.upper() + "!" for t in part])
    for made in (kept, changed):
        assert all(b.num_rows == 1 or sum(len(t or "") + 1 for t in b.column("text").to_pylist()) <= batches.CHARS + 2 * b.num_rows for b in made)
    rows = [r for b in kept for r in zip(b.column("n").to_pylist(), b.column("text").to_pylist(), strict=True)]
    assert rows == [(n, t) for n, t in enumerate(texts) if t]
    rows = [r for b in changed for r in zip(b.column("n").to_pylist(), b.column("text").to_pylist(), strict=True)]
    assert rows == [(n, None if t is None else t.upper() + "!") for n, t in enumerate(texts)]


def test_a_batch_gives_its_memory_back():
    """Freed memory below a block still held, which stays with a worker unless it is told to return it."""

    def held():
        return int(re.search(r"Rss:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    blocks = []

    def hoard(part, texts):
        made = [bytes(2000) for _ in range(100_000)]
        blocks.append(made[-1])
        return part

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["x"]})
    before = held()
    assert batches.map_texts(OneBatch(batch), hoard, "") == [batch]
    assert held() - before < 100
