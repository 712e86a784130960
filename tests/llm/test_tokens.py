"""BPE and token ids against the tokenizers library."""

import hashlib
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.common import ODD, odd_table
from tierworks.llm import bpe, token_ids
from tierworks.llm.queries import BYTE_BPE, QUERIES, table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_merge_as_in_the_library(library):
    rng = random.Random(1)
    letters = "'stmdrevl  \n\t　aZé1²٣!.’ -́​\x85\x1c漢"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["it's 've''ll 's we'RE", "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "", " ", "\n\n a", "a" * 1000]
    encoder = bpe.Encoder(bpe.vocabulary(BYTE_BPE).encode_words, bpe.vocabulary(BYTE_BPE).special, remembered=500)
    for a in range(0, len(texts), 400):
        part = texts[a : a + 400]
        ids, counts = encoder.encode(part)
        assert ids.tolist() == [i for t in part for i in ids_of(library, t)]
        assert counts.tolist() == [len(ids_of(library, t)) for t in part]


@pytest.mark.parametrize("few", [1, 7])
def test_words_with_one_hash(library, monkeypatch, few):
    """With hashes that collide, words are told apart by their characters."""
    real = bpe.hashes
    monkeypatch.setattr(bpe, "hashes", lambda *a: real(*a) % np.uint64(few) * np.uint64(2) + np.uint64(1))
    texts = ["some words and some other words", "words<|endoftext|> of one hash", "", "a b a b"]
    encoder = bpe.Encoder(bpe.vocabulary(BYTE_BPE).encode_words, bpe.vocabulary(BYTE_BPE).special)
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        assert ids.tolist() == [i for t in texts for i in ids_of(library, t)] and counts.tolist() == [len(ids_of(library, t)) for t in texts]


def test_a_piece_with_more_words_than_the_table(library):
    texts = [" ".join(f"w{a}x{b}" for b in range(400)) for a in range(6)]
    encoder = bpe.Encoder(bpe.vocabulary(BYTE_BPE).encode_words, bpe.vocabulary(BYTE_BPE).special, remembered=10)
    assert encoder.encode(texts)[0].tolist() == [i for t in texts for i in ids_of(library, t)]


def test_tables_of_words_grow_in_place(library):
    """Adding words costs what is added: most additions move no array, and what was learned stays."""
    encoder = bpe.Encoder(bpe.vocabulary(BYTE_BPE).encode_words, bpe.vocabulary(BYTE_BPE).special)
    rooms, used = set(), 0
    for a in range(60):
        texts = [" ".join(f"w{a}x{b}" for b in range(50)), "<|endoftext|> \ud7ff\U0010ffff it's"]
        assert encoder.encode(texts)[0].tolist() == [i for t in texts for i in ids_of(library, t)]
        used += len(bpe.pretokens(texts)[1])
        rooms |= {len(x.room) for x in (encoder.words.chars, encoder.words.hash)}
    assert len(rooms) < 30 and len(encoder.words) == encoder.counts.size == encoder.uses.size
    assert encoder.uses.all.sum() == used
    assert bpe.strings(np.frombuffer("aé漢\U0001f600b".encode("utf-32-le"), np.uint32), np.array([3, 0, 4]), np.array([1, 2, 1])) == ["\U0001f600", "aé", "b"]


def test_every_character_falls_into_the_same_word(library):
    texts = [f"a{chr(c)}a {chr(c)}1{chr(c)}{chr(c)}!" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    ids, _ = bpe.encoder(BYTE_BPE).encode(texts)
    assert ids.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_workers_forget_the_words_of_a_task(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition(8)

    def known(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.encoder(BYTE_BPE).words)] * batch.num_rows, pa.int64())], ["n"])

    assert bpe.encode_digests(docs, BYTE_BPE).where("n_tokens > 0").count() > 0
    assert {r["n"] for r in docs.mapInArrow(known, "n long").collect()} == {0}


def test_decoding_of_broken_bytes(library):
    for ids in ([222], [222, 50256, 97], [10 for _ in range(4)], []):
        assert bpe.vocabulary(BYTE_BPE).decode(np.array(ids, int)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_bpe_on_odd_rows(spark, library):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(odd_table(spark), BYTE_BPE).collect())
    want = []
    for i, t in ODD:
        ids = ids_of(library, t)
        want.append((i is None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    full = {r["doc_id"]: r for r in bpe.encode_decode(odd_table(spark), BYTE_BPE).collect()}
    assert full[8]["ids"] == ids_of(library, dict(ODD)[8]) and full[8]["decoded"] == dict(ODD)[8]
    assert bpe.encode_digests(odd_table(spark).limit(0), BYTE_BPE).count() == 0


def test_ranks_of_one_to_four_bytes():
    rng = np.random.default_rng(0)
    ranks = np.concatenate([rng.integers(0, 2**b, 50, np.uint32) for b in (8, 16, 24, 32)] + [np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)])
    for n in (0, 1, 2, 3, 4, 5, len(ranks)):
        control, data = token_ids.encode_ranks(ranks[:n])
        assert len(control) == -(-n // 4)
        assert token_ids.decode_ranks(control, data, n).tolist() == ranks[:n].tolist()


def written(spark, df):
    folder = tempfile.mkdtemp(prefix="token-ids-")
    token_ids.write_ids(df, f"{folder}/ids", BYTE_BPE, 2, f"{folder}/work")
    return f"{folder}/ids"


def test_written_ids_come_back(spark, library, monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 64)
    target = written(spark, odd_table(spark))
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids"]) for r in token_ids.read_ids(spark, target).collect()))
    assert sorted((k, i, ids) for k, i, _, ids in got) == sorted((i is not None, i or 0, [*ids_of(library, t), 2]) for i, t in ODD)
    at = 0
    for _, _, start, ids in sorted(got, key=lambda g: g[2]):
        assert start == at
        at += len(ids)
    assert [g[:2] for g in sorted(got, key=lambda g: g[2])] == [g[:2] for g in got]
    ranks = spark.read.parquet(f"{target}/ranks").orderBy("rank").collect()
    assert [(-r["n"], r["id"]) for r in ranks] == sorted((-r["n"], r["id"]) for r in ranks)


def test_no_ids(spark):
    assert token_ids.read_digests(spark, written(spark, odd_table(spark).limit(0))).count() == 0


def test_op1_whole_table(spark, sf, library):
    at, got = 0, {r["doc_id"]: r for r in QUERIES["op1_token_ids"](spark, sf).collect()}
    rows = sorted(table(spark, sf, "documents").select("doc_id", "text").collect())
    assert len(got) == len(rows)
    for key, text in rows:
        ids = np.array([*ids_of(library, text), 2], "<u4")
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op9_whole_table(spark, sf, library):
    got = {r["doc_id"]: r for r in QUERIES["op9_bpe"](spark, sf).collect()}
    for key, text in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids = ids_of(library, text)
        assert got[key]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
