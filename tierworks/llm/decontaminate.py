"""Benchmark decontamination: passages within a bounded edit distance of a benchmark item.

A passage matches if its words, or its characters, are similar enough to those of an item (lower-cased words,
one space between). Each criterion has a search of its own, and every pair found is verified by its exact edit
distance, the passage being free to begin and end near the place found.

Words: the CGK random walk embeds a sequence so that few edits become few differing positions; sampled
positions of the embedding of every item-sized window are matched against those of the items, in as many
repetitions as the target recall needs for the worst item of a like length. Before the walk, windows that cannot match any item are left out
without loss: after at most ``k`` edits the window that begins where the passage begins holds all but ``k`` of
an item's words, and all but ``2 k`` of its distinct pairs of neighbouring words.

Characters: a passage shares seeds, short runs of characters chosen by their hash, with its item, and in nearly
the same order. Places with as many seeds as an item keeps under random edits are verified. Length and share
of the seeds are measured for every item, so that short ones have shorter and more of them.

Cases: a null or wordless item matches nothing, a null or empty text holds nothing; repeated items and
repeated rows are each reported; an item too short for one edit must occur word for word; an item of more than
256 words is cut into parts of like length, each searched for as an item, and a text that holds a passage of one of them is
reported with the item once, distance and similarity being those of its most similar part; an empty table on
either side gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierworks.llm.batches import id_text, keep_rows, map_texts
from tierworks.session import new_work_path

SIMILARITY = 0.8  # 1 - edit distance / length of the item, in words or in characters
RECALL = 0.95  # of passages that just match, edited at random places; nearer ones are found more surely
MOST_REPETITIONS = 512
# Length of seeds and the share kept, one in so many; an item takes the first of which it keeps FEWEST_SEEDS.
SEEDS = ((6, 4), (6, 2), (6, 1), (5, 1), (4, 1), (3, 1), (2, 1))
FEWEST_SEEDS = 4
MEASURED, EDITED = 16, 32  # items of a class of lengths and random edits of each that repetitions are taken from
TRIALS = 40  # random edits of an item of which its number of seeds is taken
BITS = 20  # of the table that most places of a text fall through
SAMPLES = 1  # positions of an embedding in one hash
STRETCH = 2  # steps of the walk for each word of an item; later ones mostly stand behind its end
BLOCK_ITEMS, BLOCK_WORDS = 4096, 200_000  # what one index, sent to every task, holds at most
WINDOWS, CELLS = 256, 1 << 22  # windows that walk at once, and symbols of their embeddings
STRETCHES = 400  # stretches of text compared at once
PART = 256  # words of an item from which it is cut; each part is searched for as an item
WORD = re.compile(r"\w+")
SEED = 20_011


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def allowed(n: int, similarity: float) -> int:
    """Edits allowed for an item of n words."""
    return int((1 - similarity) * n + 1e-9)


class Walk:
    """CGK embeddings of many windows in many repetitions at once.

    Step j of repetition r outputs the symbol the walk stands on and moves on by a random bit of (r, j, symbol).
    """

    def __init__(self, symbols: int, longest: int, repetitions: int):
        rng = np.random.default_rng(SEED)
        self.hash = rng.integers(0, 2**64, symbols + 2, np.uint64)
        self.seeds = rng.integers(0, 2**64, (STRETCH * longest, repetitions), np.uint64)
        self.pad = symbols + 1
        # sampled positions as shares of an embedding
        self.shares = rng.random((repetitions, SAMPLES))
        self.salt = rng.integers(0, 2**64, repetitions, np.uint64) | np.uint64(1)

    def embed(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, repetitions: int) -> np.ndarray:
        """Shape (windows, repetitions, steps): the symbol that each step outputs."""
        steps = STRETCH * int(lengths.max())
        at = np.zeros((len(starts), repetitions), np.int64)
        out = np.empty((steps, len(starts), repetitions), np.int32)
        limit, first = lengths[:, None], starts[:, None]
        for j in range(steps):
            inside = at < limit
            symbol = np.where(inside, codes[np.minimum(first + at, len(codes) - 1)], self.pad)
            out[j] = symbol
            bit = ((self.hash[symbol] ^ self.seeds[j, :repetitions]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
            at += inside & (bit == 1)
        return out.transpose(1, 2, 0)

    def keys(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, repetitions: int) -> np.ndarray:
        """One hash for each window and repetition."""
        embedded = self.embed(codes, starts, lengths, repetitions)
        key = self.salt[None, :repetitions] * (lengths[:, None].astype(np.uint64) + np.uint64(1))
        rows, reps = np.arange(len(starts))[:, None], np.arange(repetitions)[None, :]
        for s in range(SAMPLES):
            place = (self.shares[None, :repetitions, s] * STRETCH * lengths[:, None]).astype(np.int64)
            key = (key ^ self.hash[embedded[rows, reps, place]]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        return key


def passage_distance(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Edit distance of each row of ``items`` to the nearest part of the same row of ``texts``."""
    n, m = items.shape[1], texts.shape[1]
    steps = np.arange(m + 1)
    row = np.zeros((len(items), m + 1), np.int64)
    for i in range(1, n + 1):
        ahead = np.minimum(row[:, :-1] + (texts != items[:, i - 1 : i]), row[:, 1:] + 1)
        row = np.concatenate([np.full((len(items), 1), i), ahead], axis=1)
        row = np.minimum.accumulate(row - steps, axis=1) + steps
    return row.min(axis=1)


def spelled_distance(items: list[np.ndarray], points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Edit distance of each item to the nearest part of its stretch of ``points``.

    Whole columns of the distance table at once, as bits that say where it rises and falls (Myers, Hyyro), for all
    items side by side; a column has as many 64-bit words as the longest item needs.
    """
    distinct: dict[bytes, int] = {}
    which = np.array([distinct.setdefault(x.tobytes(), len(distinct)) for x in items])
    spelled = [np.frombuffer(x, np.uint32) for x in distinct]
    letters, code = np.unique(np.concatenate(spelled), return_inverse=True)
    owner = np.repeat(np.arange(len(spelled)), [len(x) for x in spelled])
    place = np.concatenate([np.arange(len(x)) for x in spelled])
    width = int(place.max()) // 64 + 1
    masks = np.zeros((width, len(spelled), len(letters) + 1), np.uint64)  # where an item has a letter
    np.bitwise_or.at(masks, (place >> 6, owner, code), np.uint64(1) << (place & 63).astype(np.uint64))
    sizes, m = np.array([len(x) for x in items]), int((high - low).max())
    at = low[:, None] + np.arange(m)
    text = points[np.minimum(at, len(points) - 1)]
    known = np.full(int(letters[-1]) + 2, len(letters), np.int32)
    known[letters] = np.arange(len(letters))
    text = np.where(at < high[:, None], known[np.minimum(text, letters[-1] + 1)], len(letters)).T.copy()
    one, top = np.uint64(1), np.uint64(63)
    last_word, last_bit, rows = (sizes - 1) >> 6, ((sizes - 1) & 63).astype(np.uint64), np.arange(len(items))
    rises = np.full((width, len(items)), ~np.uint64(0))
    falls = np.zeros((width, len(items)), np.uint64)
    total, now, best = np.empty_like(rises), sizes.astype(np.int64), sizes.astype(np.int64)
    for j in range(m):
        same = masks[:, which, text[j]]
        both, carry = same & rises, None
        for w in range(width):  # both + rises over all words
            np.add(both[w], rises[w], out=total[w])
            over = total[w] < both[w]
            if carry is not None:
                total[w] += carry
                over |= total[w] < carry
            carry = over.astype(np.uint64)
        level = (total ^ rises) | same | falls
        up, down = falls | ~(level | rises), level & rises
        now += ((up[last_word, rows] >> last_bit) & one).astype(np.int64) - ((down[last_word, rows] >> last_bit) & one).astype(np.int64)
        np.minimum(best, now, out=best)
        for bits in (up, down):
            over = bits[:-1] >> top
            bits <<= one
            bits[1:] |= over
        rises, falls = down | ~(level | up), up & level
    return best


@dataclasses.dataclass
class Index:
    """Hashes of a block of items, long ones in parts."""

    item_ids: list[int | None]
    origin: list[int]  # number of the item that each part is of
    items: list[np.ndarray]  # symbols of the parts
    texts: list[str]  # the items' words with one space between
    similarity: float
    vocabulary: dict[str, int]
    pairs: np.ndarray  # neighbouring words of items, as numbers in order
    pair_lengths: np.ndarray  # for each pair a bit mask of the numbers of the item lengths it occurs in
    walk: Walk
    repetitions: np.ndarray  # by length
    keys: np.ndarray  # sorted
    owner: np.ndarray  # item of each key
    needs: list[tuple[int, int, int]]  # window length, least known words, least known pairs
    letters: list[Seeds]

    def candidates(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the windows that may match an item."""
        size = len(self.vocabulary)
        known = np.concatenate([[0], np.cumsum(codes < size, dtype=np.int32)])
        at = np.flatnonzero((codes[:-1] < size) & (codes[1:] < size))
        lengths_of, pair_at = np.zeros(len(codes), np.uint64), np.full(len(codes), -1, np.int32)
        if len(self.pairs):
            key = codes[at].astype(np.int64) * size + codes[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            lengths_of[at] = np.where(self.pairs[place] == key, self.pair_lengths[place], np.uint64(0))
            pair_at[at] = place
        both = np.concatenate([[0], np.cumsum(lengths_of > 0, dtype=np.int32)])
        starts, lengths = [], []
        for bit, (n, least_known, least_pairs) in enumerate(self.needs):
            if n > len(codes):
                continue
            found = np.flatnonzero(both[n - 1 : len(codes)] - both[: len(codes) - n + 1] >= least_pairs)
            found = found[known[found + n] - known[found] >= least_known]
            if least_pairs > 0 and len(found):
                span = found[:, None] + np.arange(n - 1)
                own = np.where((lengths_of[span] >> np.uint64(bit % 64)) & np.uint64(1), pair_at[span], -1)
                own.sort(axis=1)
                distinct = (own[:, :1] >= 0).sum(axis=1) + ((own[:, 1:] != own[:, :-1]) & (own[:, 1:] >= 0)).sum(axis=1)
                found = found[distinct >= least_pairs]
            starts.append(found)
            lengths.append(np.full(len(found), n))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, length = np.concatenate(starts), np.concatenate(lengths)
        whole = start + length <= ends[np.searchsorted(begins, start, side="right") - 1]
        return start[whole], length[whole]

    def search(self, texts: list[str]) -> list[tuple[int, int, int, float]]:
        """(text, item, edit distance of the words, similarity) of all passages found, one for each text and item.

        Of an item in parts those of its most similar part.
        """
        lists = [words(t) for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        unknown, get = len(self.vocabulary), self.vocabulary.get
        codes = np.fromiter(map(get, itertools.chain.from_iterable(lists), itertools.repeat(unknown)), np.int32, int(counts.sum()))
        if not len(codes) or not self.items:
            return []
        spelled = self.search_letters(lists)
        # texts shorter than a window lie in a frame of unknown words, so their windows exist too
        gap = self.needs[-1][0]
        frame = np.full(len(codes) + gap * (len(texts) + 1), unknown, np.int32)
        ends_in = np.cumsum(counts)
        begins = ends_in - counts + gap * (1 + np.arange(len(texts)))
        frame[np.arange(len(codes)) + np.repeat(begins - (ends_in - counts), counts)] = codes
        start, length = self.candidates(frame, begins, begins + counts + gap)
        pairs = set()
        for s, n, repetitions in walks(start, length, self.repetitions):
            key = self.walk.keys(frame, s, n, repetitions).ravel()
            low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
            hit = np.flatnonzero(high > low)
            spans = high[hit] - low[hit]
            window = np.repeat(hit // repetitions, spans)
            place = np.repeat(low[hit] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
            item = self.owner[place]
            same = np.array([len(self.items[i]) for i in item.tolist()], np.int64) == n[window]
            pairs.update(zip(s[window[same]].tolist(), item[same].tolist(), strict=True))
        # a pair found by its words has the fewest words changed
        found = spelled | self.verify(frame, begins, begins + counts, pairs)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for (t, i), (d, similar) in found.items():
            whole = (t, self.origin[i])
            best[whole] = max((similar, -d), best.get(whole, (similar, -d)))
        return [(t, i, -d, similar) for (t, i), (similar, d) in sorted(best.items())]

    def search_letters(self, lists: list[list[str]]) -> dict[tuple[int, int], tuple[int, float]]:
        """Word distance and similarity of the passages similar in characters, by text and item."""
        gap = max(len(t) for t in self.texts)
        joined = [" ".join(x) for x in lists]
        points, lengths = code_points(("\0" * gap).join(["", *joined, ""])), np.array([len(x) for x in joined], np.int64)
        begins = np.cumsum(lengths + gap) - lengths
        best: dict[tuple[int, int], tuple[int, float]] = {}
        spellings = [code_points(t) for t in self.texts]
        sizes = np.array([len(x) for x in spellings], np.int64)
        edits = np.array([allowed(n, self.similarity) for n in sizes.tolist()], np.int64)
        hashes = {size: run_hashes(points, size) for size in {seeds.size for seeds in self.letters}}
        tops = {size: (h >> np.uint64(64 - BITS)).astype(np.int32) for size, h in hashes.items()}
        found = []
        for seeds in self.letters:
            item, start, width = seeds.places(hashes[seeds.size], tops[seeds.size])
            text = np.searchsorted(begins, start + (width + sizes[item]) // 2, side="right") - 1
            low = np.maximum(start - edits[item], begins[text])
            high = np.minimum(start + width + sizes[item] + edits[item], begins[text] + lengths[text])
            likely = np.flatnonzero((text >= 0) & (high - low >= sizes[item] - edits[item]))
            likely = likely[seeds.kept(item[likely], low[likely], high[likely], hashes[seeds.size])]
            found.append(np.stack([item, text, low, high])[:, likely])
        if found:
            item, text, low, high = np.concatenate(found, axis=1)
            order = np.argsort(-sizes[item], kind="stable")
            for a in range(0, len(order), STRETCHES):
                part = order[a : a + STRETCHES]
                distance = spelled_distance([spellings[i] for i in item[part].tolist()], points, low[part], high[part])
                for j, d in zip(part.tolist(), distance.tolist(), strict=True):
                    t, i = int(text[j]), int(item[j])
                    similar = 1 - d / int(sizes[i])
                    if d > edits[i] or (t, i) in best and best[t, i][1] >= similar:
                        continue
                    left, right = max(int(low[j] - sizes[i]), int(begins[t])), min(int(high[j] + sizes[i]), int(begins[t] + lengths[t]))
                    around = words(points[left:right].tobytes().decode("utf-32-le", "surrogatepass"))
                    codes = np.array([self.vocabulary.get(x, len(self.vocabulary)) for x in around], np.int32)
                    best[t, i] = (int(passage_distance(self.items[i][None, :], codes[None, :])[0]), similar)
        return best

    def verify(self, frame: np.ndarray, begins: np.ndarray, ends: np.ndarray, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, float]]:
        """Word distance and similarity of the passages similar in words, by text and item."""
        best: dict[tuple[int, int], tuple[int, float]] = {}
        by_length: dict[int, list[tuple[int, int]]] = {}
        for s, i in sorted(pairs):
            by_length.setdefault(len(self.items[i]), []).append((s, i))
        for n, group in by_length.items():
            k = allowed(n, self.similarity)
            for a in range(0, len(group), 4096):
                part = group[a : a + 4096]
                s = np.array([x for x, _ in part])
                text = np.searchsorted(begins, s, side="right") - 1
                at = s[:, None] + np.arange(-k, n + k)
                inside = (at >= begins[text][:, None]) & (at < ends[text][:, None])
                around = np.where(inside, frame[np.clip(at, 0, len(frame) - 1)], len(self.vocabulary))
                distance = passage_distance(np.stack([self.items[i] for _, i in part]), around)
                for t, (_, i), d in zip(text.tolist(), part, distance.tolist(), strict=True):
                    if d <= k:
                        best[t, i] = min((d, 1 - d / n), best.get((t, i), (d, 1 - d / n)))
        return best


@dataclasses.dataclass
class Seeds:
    """Runs of ``size`` characters of a block's items, those whose hash is divisible by ``every``."""

    size: int
    every: int
    table: np.ndarray  # by the upper bits of a hash: whether a seed has them
    hashes: np.ndarray  # distinct, sorted
    first: np.ndarray  # place of each hash's first seed, and of the end
    item: np.ndarray
    offset: np.ndarray  # of each seed in its item
    least: np.ndarray  # by item: seeds a matching passage keeps
    length: np.ndarray  # by item: characters
    near: np.ndarray  # by item: how far apart the starts they tell may be
    runs: dict[int, np.ndarray]  # all runs of each item, distinct and sorted
    fewest: np.ndarray  # by item: of them a matching passage keeps

    def places(self, hashes: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first start, width) of the stretches within which a passage may start, from the hashes of all runs and their upper bits."""
        none = (np.zeros(0, np.int64),) * 3
        at = np.flatnonzero(self.table[tops])
        slot = np.searchsorted(self.hashes, hashes[at])
        same = self.hashes[np.minimum(slot, len(self.hashes) - 1)] == hashes[at]
        at, slot = at[same], slot[same]
        counts = self.first[slot + 1] - self.first[slot]
        seed = np.repeat(self.first[slot] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        if not len(seed):
            return none
        item, stride = self.item[seed], np.int64(len(hashes) + 3 * int(self.length.max()))
        key = np.sort(item * stride + np.repeat(at, counts) - self.offset[seed] + int(self.length.max()))
        item = key // stride
        last = np.arange(len(key)) + self.least[item] - 1
        full = np.flatnonzero(last < len(key))
        full = full[key[last[full]] - key[full] <= self.near[item[full]]]
        full = full[item[last[full]] == item[full]]
        if not len(full):
            return none
        item, start = item[full], key[full] % stride - int(self.length.max())
        # starts near one another are verified together
        begin = np.unique(np.stack([item, start // self.near[item]]), axis=1)
        return begin[0], begin[1] * self.near[begin[0]], 2 * self.near[begin[0]]

    def kept(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Whether the stretch holds as many of the item's runs, chosen or not, as a matching passage keeps."""
        out = np.zeros(len(item), bool)
        for j, (i, a, b) in enumerate(zip(item.tolist(), low.tolist(), high.tolist(), strict=True)):
            runs = self.runs[i]
            here = hashes[a : max(a, b - self.size + 1)]
            at = np.searchsorted(runs, here)
            at[at == len(runs)] = 0
            out[j] = len(np.unique(at[runs[at] == here])) >= self.fewest[i]
        return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` characters."""
    n = max(0, len(points) - size + 1)
    value = np.zeros(n, np.uint64)
    for j in range(size):
        value = value * np.uint64(0x100000001B3) + points[j : j + n]
    value *= np.uint64(0x9E3779B97F4A7C15)
    return (value ^ (value >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def chosen(hashes: np.ndarray, every: int) -> np.ndarray:
    return (hashes & np.uint64(every - 1)) == 0


def seeds_kept(item: np.ndarray, edits: int, size: int, every: int, rng: np.random.Generator, recall: float) -> tuple[int, int]:
    """Seeds that all but 1 - ``recall`` of random edits of the item leave, and distinct runs that each of them leaves."""
    runs = run_hashes(item, size)
    own = runs[chosen(runs, every)]
    if not edits:
        return len(own), len(np.unique(runs))
    left = [run_hashes(perturbed(item, edits, 0, rng).astype(np.uint32), size) for _ in range(TRIALS)]
    kept = sorted(int(np.isin(x, own).sum()) for x in left)
    return kept[int((1 - recall) * TRIALS / 2)], min(len(np.intersect1d(x, runs)) for x in left)


def seed_tables(texts: list[str], similarity: float, recall: float) -> list[Seeds]:
    """The seeds of a block's items, one table for each length and share of seeds."""
    rng, groups = np.random.default_rng(SEED + 2), {}
    lengths = np.array([len(t) for t in texts], np.int64)
    edits = np.array([allowed(n, similarity) for n in lengths.tolist()], np.int64)
    least, fewest = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        points = code_points(text)
        for kind in SEEDS:
            kept, all_runs = seeds_kept(points, int(edits[i]), *kind, rng, recall)
            if kept >= FEWEST_SEEDS:
                break
        if kept < FEWEST_SEEDS:  # so short that a pair of characters is left after all edits, or its only word
            kind, kept, all_runs = (2, 1) if len(text) > 1 else (1, 1), 1, 1
        least[i], fewest[i] = max(1, kept), all_runs
        groups.setdefault(kind, []).append((i, points))
    made = []
    for (size, every), own in sorted(groups.items()):
        hashes = [run_hashes(points, size) for _, points in own]
        item = np.repeat([i for i, _ in own], [len(h) for h in hashes]).astype(np.int64)
        offset, flat = np.concatenate([np.arange(len(h)) for h in hashes]), np.concatenate(hashes)
        keep = np.flatnonzero(chosen(flat, every))
        order = keep[np.argsort(flat[keep], kind="stable")]
        distinct, first = np.unique(flat[order], return_index=True)
        table = np.zeros(1 << BITS, bool)
        table[(distinct >> np.uint64(64 - BITS)).astype(np.int64)] = True
        runs = {i: np.unique(h) for (i, _), h in zip(own, hashes, strict=True)}
        made.append(Seeds(size, every, table, distinct, np.append(first, len(order)), item[order], offset[order], least, lengths, np.maximum(1, edits), runs, fewest))
    return made


def perturbed(item: np.ndarray, edits: int, unknown: int, rng: np.random.Generator) -> np.ndarray:
    """The item after so many random edits: a word replaced, left out or put in."""
    out = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out))) if out else 0
        if kind == 0 and out:
            out[at] = unknown
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, unknown)
    return np.array(out, np.int32)


def repetitions_for(items: list[np.ndarray], symbols: int, similarity: float, recall: float) -> np.ndarray:
    """Repetitions by length that find an item after as many edits as allowed with the given probability, as measured.

    Lengths are classed by powers of two, and every class is held to its worst item: of each class up to MEASURED items, the
    shortest and the longest among them, are edited at random EDITED times; the share of equal positions in the embeddings gives
    the probability that one hash of SAMPLES positions agrees.
    """
    rng = np.random.default_rng(SEED + 1)
    out = np.full(max([len(x) for x in items], default=0) + 1, 8, np.int64)
    classes: dict[int, list[np.ndarray]] = {}
    for item in sorted(items, key=len):
        classes.setdefault(len(item).bit_length(), []).append(item)
    for bits, own in classes.items():
        picked = {round(i) for i in np.linspace(0, len(own) - 1, min(len(own), MEASURED))}
        needed = 8
        for item in (own[i] for i in sorted(picked)):
            n = len(item)
            walk, k = Walk(symbols, n, 32), allowed(n, similarity)
            edited = [np.append(perturbed(item, k, symbols, rng), np.full(n, symbols, np.int32))[:n] for _ in range(EDITED)]
            one = walk.embed(np.concatenate([item, *edited]), np.arange(EDITED + 1) * n, np.full(EDITED + 1, n), 32)
            missed = 1 - ((one[:1] == one[1:]).mean(axis=2) ** SAMPLES).mean(axis=1)
            while 1 - (missed**needed).mean() < recall:
                needed += 8
                if needed > MOST_REPETITIONS:
                    raise ValueError(f"{MOST_REPETITIONS} repetitions don't reach a recall of {recall} at a similarity of {similarity}")
        out[1 << (bits - 1) : 1 << bits] = needed
    return out


def walks(starts: np.ndarray, lengths: np.ndarray, repetitions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Windows in groups that walk together: starts, lengths, repetitions."""
    wanted = repetitions[lengths]
    for r in np.unique(wanted).tolist():
        own = np.flatnonzero(wanted == r)
        at_once = max(1, min(WINDOWS, CELLS // (r * STRETCH * int(lengths[own].max()))))
        for a in range(0, len(own), at_once):
            part = own[a : a + at_once]
            yield starts[part], lengths[part], r


def parts_of(item: list[str]) -> list[list[str]]:
    """The item in parts of like length, at most PART words each.

    Edits that are few enough for the whole are few enough for one of its parts, whatever their places.
    """
    count = -(-len(item) // PART)
    bounds = [len(item) * i // count for i in range(count + 1)]
    return [item[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def build(rows: list[tuple[int | None, list[str]]], similarity: float = SIMILARITY, recall: float = RECALL) -> Index:
    """The index of a block of items given as (id, words)."""
    rows = [(i, w) for i, w in rows if w]
    ids = [i for i, _ in rows]
    origin = [at for at, (_, w) in enumerate(rows) for _ in parts_of(w)]
    rows = [(i, part) for i, w in rows for part in parts_of(w)]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, x in rows for w in x))}
    items = [np.array([vocabulary[w] for w in x], np.int32) for _, x in rows]
    lengths = np.array([len(x) for x in items], np.int64)
    distinct: dict[int, int] = {}
    for item in items:
        n = len(item)
        distinct[n] = min(distinct.get(n, n), len(set(zip(item[:-1].tolist(), item[1:].tolist(), strict=True))))
    needs = [(n, n - allowed(n, similarity), distinct[n] - 2 * allowed(n, similarity)) for n in sorted(distinct)]
    masks: dict[int, int] = {}
    number = {n: i for i, (n, _, _) in enumerate(needs)}
    for item in items:
        for key in (item[:-1].astype(np.int64) * len(vocabulary) + item[1:]).tolist():
            masks[key] = masks.get(key, 0) | 1 << number[len(item)] % 64
    pairs = np.array(sorted(masks), np.int64)
    pair_lengths = np.array([masks[k] for k in pairs.tolist()], np.uint64)
    repetitions = repetitions_for(items, len(vocabulary), similarity, recall)
    walk = Walk(len(vocabulary), max([1, *lengths.tolist()]), int(repetitions.max()))
    keys, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if items:
        flat, starts = np.concatenate(items), np.cumsum(lengths) - lengths
        made = []
        for own, n, r in walks(np.arange(len(items)), lengths, repetitions):
            made.append((walk.keys(flat, starts[own], n, r).ravel(), np.repeat(own, r)))
        keys, owner = (np.concatenate(column) for column in zip(*made, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
    texts = [" ".join(w) for _, w in rows]
    return Index(ids, origin, items, texts, similarity, vocabulary, pairs, pair_lengths, walk, repetitions, keys, owner, needs, seed_tables(texts, similarity, recall))


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[text_col].alias("text")).toLocalIterator():
        item = words(row["text"] or "")
        if block and (len(block) >= BLOCK_ITEMS or size + len(item) > BLOCK_WORDS):
            yield block
            block, size = [], 0
        block.append((row["item"], item))
        size += len(item)
    if block:
        yield block


def _matches(df: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch | None:
        found = index.search(texts)
        if not found:
            return None
        t, i, distance, similar = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(t)), pa.array([index.item_ids[k] for k in i], pa.int64()), pa.array(distance, pa.int64()), pa.array(similar, pa.float64())],
            ["doc_id", "item_id", "distance", "similarity"],
        )

    return map_texts(id_text(df, id_col, text_col), per_piece, "doc_id long, item_id long, distance long, similarity double")


def contaminated(
    df: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row for each text and item it holds a passage of: doc_id, item_id, distance (in words), similarity.

    A benchmark of more than one block is searched block by block, the results of each written before the next.
    """
    spark, path, first = df.sparkSession, None, None
    for block in blocks(benchmark, item_col, item_text_col):
        if first is None:
            first = block
            continue
        if path is None:
            path = new_work_path(spark, "contaminated")
            _matches(df, build(first, similarity, recall), id_col, text_col).write.parquet(path)
        _matches(df, build(block, similarity, recall), id_col, text_col).write.mode("append").parquet(path)
    return spark.read.parquet(path) if path else _matches(df, build(first or [], similarity, recall), id_col, text_col)


def keep_clean(df: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no passage of the benchmark, all columns as they are."""
    kept = df
    for block in blocks(benchmark, item_col, item_text_col):
        index = build(block, similarity, recall)

        def mask(texts: list[str], index: Index = index) -> list[bool]:
            bad = {found[0] for found in index.search(texts)}
            return [i not in bad for i in range(len(texts))]

        kept = keep_rows(kept, text_col, mask)
    return kept


def contaminated_ids(matches: DataFrame) -> DataFrame:
    """doc_id and its item ids in order."""
    return matches.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
