"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Each round looks up the rank of every changed
pair by binary search over the sorted pair keys, takes the lowest rank of each word, and merges all its
places at once, left to right. Words without a pair left leave the array.

Cases: a null or empty text has no ids and decodes to the empty string; rows with the same id or text
stay separate rows; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierworks.llm.batches import id_text, map_texts
from tierworks.llm.pretokens import SPECIAL, SPECIAL_POINT, pretokens
from tierworks.llm.words import Growing, Words, hashes

NO_RANK = np.int32(2**31 - 1)
# Distinct words whose ids a task keeps between pieces; beyond it keeps the half used most. Only time depends on it.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 256
    for b in range(256):
        if b in set(printable):
            table[b] = chr(b)
        else:
            table[b] = chr(extra)
            extra += 1
    return table


class Vocabulary:
    """Merge table and byte strings of a byte-level BPE file (the JSON of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        chars = byte_characters()
        self.of_byte = np.array([ids[c] for c in chars], np.int32)
        byte = {c: b for b, c in enumerate(chars)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = added[SPECIAL] if SPECIAL in added else ids[SPECIAL]
        self.size = max(*ids.values(), *added.values()) + 1
        raw = [b""] * self.size
        for token, i in ids.items():
            raw[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for token, i in added.items():
            raw[i] = token.encode()
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NO_RANK where there is no such merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        done_symbols, done_words = [], []
        rank = np.full(len(symbol), NO_RANK, np.int32)
        inside = word[:-1] == word[1:]
        rank[:-1][inside] = self.rank(symbol[:-1][inside], symbol[1:][inside])
        while len(symbol):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, heads)
            counts = np.diff(np.append(heads, len(word)))
            lowest_here = np.repeat(lowest, counts)
            open_word = lowest_here != NO_RANK
            if not open_word.all():
                done_symbols.append(symbol[~open_word])
                done_words.append(word[~open_word])
                symbol, word, rank, lowest_here = (x[open_word] for x in (symbol, word, rank, lowest_here))
                if not len(symbol):
                    break
            hit = rank == lowest_here
            # of overlapping places (a a a) take every second, from the left
            at = np.flatnonzero(hit)
            run = np.cumsum(np.append(True, np.diff(at) != 1)) - 1
            run_head = at[np.flatnonzero(np.append(True, np.diff(at) != 1))]
            at = at[(at - run_head[run]) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            flags = np.zeros(len(symbol), bool)
            flags[at] = True
            flags[at[at > 0] - 1] = True
            changed = np.flatnonzero(flags)
            rank[changed] = NO_RANK
            changed = changed[changed < len(symbol) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.rank(symbol[changed], symbol[changed + 1])
        symbols, owners = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owners, kind="stable")
        return symbols[order], np.bincount(owners, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The byte strings of the ids, one after another."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        shift = np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.bytes[shift + np.arange(ends[-1])].tobytes()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def strings(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Runs of code points as strings, decoded at once."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    text = codes[np.repeat(starts - begins, lengths) + np.arange(lengths.sum())].tobytes().decode("utf-32-le", "surrogatepass")
    return [text[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


class Encoder:
    """Ids of texts; the ids of distinct words are kept between calls.

    ``encode_words(words)`` gives the ids of new words, one after another, and their numbers.
    """

    def __init__(self, encode_words, special: int, remembered: int = REMEMBERED):
        self.encode_words, self.special, self.remembered = encode_words, special, remembered
        self.forget()

    def forget(self) -> None:
        self.words = Words(max(10, int(self.remembered).bit_length() + 2))
        self.ids, self.offsets, self.counts = (Growing(np.zeros(0, np.int32)) for _ in range(3))
        self.uses = Growing(np.zeros(0, np.int64))

    def keep_used(self) -> None:
        """Forget the words used least."""
        kept = np.sort(np.argsort(-self.uses.all, kind="stable")[: self.remembered // 2])
        counts = self.counts.all[kept]
        ends = np.cumsum(counts)
        self.words = self.words.kept(kept)
        self.ids = Growing(self.ids.all[np.repeat(self.offsets.all[kept] - (ends - counts), counts) + np.arange(ends[-1])])
        self.offsets, self.counts, self.uses = Growing((ends - counts).astype(np.int32)), Growing(counts), Growing(self.uses.all[kept] // 2)

    def learn(self, h: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Encode new words and remember them."""
        special = codes[starts] == SPECIAL_POINT
        ids, counts = self.encode_words(strings(codes, starts[~special], lengths[~special]))
        if special.any():
            at = int(np.argmax(special))
            before = int(counts[:at].sum())
            ids, counts = np.insert(ids, before, self.special), np.insert(counts, at, 1)
        self.words.add(h, codes, starts, lengths)
        self.offsets.add(self.ids.size + np.cumsum(counts) - counts)
        self.ids.add(ids)
        self.counts.add(counts)
        self.uses.add(np.zeros(len(counts), np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        codes, starts, per_text = pretokens(texts)
        if len(self.words) > self.remembered:
            self.keep_used()
        lengths = np.diff(np.append(starts, len(codes)))
        h = hashes(codes, starts, lengths)
        word = self.words.find(h)
        new = np.flatnonzero(word < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            first = new[np.sort(first)]
            if len(self.words) + len(first) > 1 << (self.words.bits - 1):  # one piece with very many distinct words
                return self.encode_halves(texts)
            self.learn(h[first], codes, starts[first], lengths[first])
            word[new] = self.words.find(h[new])
        if not self.words.same(word, codes, starts):  # two words with one hash
            return self.encode_apart(codes, starts, lengths, per_text)
        np.add.at(self.uses.all, word, 1)
        counts = self.counts.all[word]
        ends = np.cumsum(counts, dtype=np.int32)  # a piece holds fewer than 2**31 ids
        place = np.repeat(self.offsets.all[word] - (ends - counts), counts)
        place += np.arange(len(place), dtype=np.int32)
        bounds = np.append(np.int32(0), ends)[np.append(0, np.cumsum(per_text))]
        return self.ids.all[place], np.diff(bounds)

    def encode_halves(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.forget()
        if len(texts) > 1:
            parts = [self.encode(texts[: len(texts) // 2]), self.encode(texts[len(texts) // 2 :])]
            return np.concatenate([i for i, _ in parts]), np.concatenate([n for _, n in parts])
        codes, starts, per_text = pretokens(texts)
        return self.encode_apart(codes, starts, np.diff(np.append(starts, len(codes))), per_text)

    def encode_apart(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the table: every word on its own."""
        special = codes[starts] == SPECIAL_POINT
        ids, own = self.encode_words(strings(codes, starts[~special], lengths[~special]))
        counts = np.ones(len(starts), np.int64)
        counts[~special] = own
        out = np.full(int(counts.sum()), self.special, np.int32)
        out[~np.repeat(special, counts)] = ids
        bounds = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(per_text))]
        return out, np.diff(bounds)


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a task, which clears it at its end: the worker goes on with other operators."""
    v = vocabulary(path)
    return Encoder(v.encode_words, v.special)


@functools.cache
def decimals(size: int) -> np.ndarray:
    return np.array([str(i) for i in range(size)], object)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, ids (array<int>), decoded (the text decoded from the ids)."""

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        ids, counts = encoder(path).encode(texts)
        ends = np.cumsum(counts)
        decoded = [vocabulary(path).decode(ids[b - n : b]).decode("utf-8", "replace") for b, n in zip(ends, counts, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return map_texts(id_text(df, id_col, text_col), per_piece, "doc_id long, ids array<int>, decoded string", at_end=lambda: encoder.cache_clear())


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, n_tokens, ids_sha256 (decimal ids, comma-joined), decoded_sha256.

    The digests are taken where the ids are made, so ids and decoded texts never leave the task.
    """

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        vocab = vocabulary(path)
        ids, counts = encoder(path).encode(texts)
        names = decimals(vocab.size)[ids]
        raw = vocab.decode(ids)
        cuts = np.concatenate([[0], np.cumsum(vocab.lengths[ids])])
        rows, at = [], 0
        for n in counts.tolist():
            said = ",".join(names[at : at + n].tolist()).encode()
            text = raw[cuts[at] : cuts[at + n]].decode("utf-8", "replace").encode()
            rows.append((hashlib.sha256(said).hexdigest(), hashlib.sha256(text).hexdigest()))
            at += n
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(id_text(df, id_col, text_col), per_piece, schema, at_end=lambda: encoder.cache_clear())
