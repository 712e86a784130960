"""Removal of byte strings that occur elsewhere, by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts at any other place of the corpus.

1. Every window of LENGTH bytes is placed by its anchor, the leftmost smallest hash among its GRAM-byte
   strings. Equal windows have equal anchors, so windows whose anchor occurs once are unique. Windows of
   consecutive starts with one anchor form a region.
2. Regions whose anchor recurs are collected once for each distinct content; a region that occurs twice goes
   whole, and needs no further step if its anchor has no other content. The others are dealt by anchor into shards of bounded size. An anchor with more content than a shard
   holds is dealt into several.
3. Each shard builds the suffix array of its regions (Larsson-Sadakane refinement: sort by eight bytes, then
   refine only unsorted groups, tripling the length by the ranks) and the common prefixes of neighbours
   (Kasai, all regions side by side). Neighbours with LENGTH bytes in common are duplicates.
4. The shards of one anchor are merged: each gives its distinct windows in sorted order, cut into ranges, and
   the lists of a range are looked up in each other by binary search.

Nothing is dropped to escape a hot key: occurrences of a very frequent anchor are dealt by document, and what
is left of them meets again in steps 3 and 4.

Cases: a null text is empty; rows with the same id, or with the same id and text, are separate documents; a
text shorter than LENGTH keeps all its bytes; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierworks.llm.batches import pieces
from tierworks.llm.words import MIX, POWERS
from tierworks.session import new_work_path

LENGTH = 200
GRAM = 32  # a power of two
WINDOW = LENGTH - GRAM + 1
SHARD_BYTES = 1 << 20  # of region content in one suffix array
FEW = 10_000  # occurrences of one anchor that a task may always hold
HOT_ANCHORS = 10_000  # an anchor is dealt by document if it has more than one in so many of all occurrences
BLOCK = 1 << 15  # windows whose anchors are looked for at once
PLACE = np.uint64((1 << 16) - 1)  # bits that hold a place within a block
RANK_BITS = 21  # three ranks make one number in shards of up to so many bits

# ---------------------------------------------------------------- anchors


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, by prefix sums."""
    up, down = POWERS.get(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) + 1 - GRAM]
    h ^= h >> np.uint64(31)
    h *= MIX
    return h ^ (h >> np.uint64(33))


def anchor_runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first start, anchor hash) of each run of windows with one anchor; in blocks that stay in the processor's cache."""
    count, last = len(raw) - LENGTH + 1, -1
    starts, anchors = [], []
    places = np.arange(BLOCK + WINDOW - 1, dtype=np.uint64)
    for a in range(0, count, BLOCK):
        h = gram_hashes(raw[a : a + BLOCK + LENGTH - 1])
        # the hash's upper bits, then the position: the least is the leftmost smallest
        low = (h & ~PLACE) | places[: len(h)]
        size = 1
        while 2 * size <= WINDOW:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        windows = len(h) - WINDOW + 1
        low = np.minimum(low[:windows], low[WINDOW - size : WINDOW - size + windows])
        heads = np.flatnonzero(low[1:] != low[:-1]) + 1
        place = (low & PLACE).astype(np.int64)
        if a + place[0] != last:
            heads = np.append(0, heads)
        starts.append(a + heads)
        anchors.append(h[place[heads]])
        last = a + int(place[-1])
    return np.concatenate(starts), np.concatenate(anchors)


def regions(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, end of the last window) of all regions of texts lying side by side."""
    long = ends - begins >= LENGTH
    first, behind = begins[long], ends[long] - LENGTH + 1  # window starts of each text that has any
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads, anchors = anchor_runs(raw)
    # runs are cut where the windows of a text begin and end; only windows that lie within one text count
    starts = np.unique(np.concatenate([heads, first, behind]))
    stops = np.append(starts[1:], starts[-1])
    owner = np.searchsorted(first, starts, side="right") - 1
    inside = (owner >= 0) & (starts < behind[owner])
    starts, stops = starts[inside], stops[inside]
    return anchors[np.searchsorted(heads, starts, side="right") - 1], starts, stops + LENGTH - 1


def side_by_side(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(texts), np.uint8), ends - lengths, ends


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tie and text; doc_id and tie together name a content of an id, null ids among them."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text", F.col("doc_id").isNull().cast("int")).alias("tie"), F.col("doc_id").isNull().alias("no_id"), "text")


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def anchor_counts(rows: DataFrame) -> DataFrame:
    """anchor, n (occurrences in all texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch):
                h, _, _ = regions(*side_by_side([t.encode() for t in texts]))
                values, counts = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts.astype(np.int32))], ["anchor", "n"])

    return rows.select("text").mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))


def occurrences(rows: DataFrame, hot: dict[int, int]) -> DataFrame:
    """anchor, salts, salt, content (hash), doc_id, tie, start, end, n of the regions of all texts.

    ``hot``: number of salts of frequent anchors; their occurrences are dealt by document. Others have one. Occurrences of one
    content within a piece are one row with their number; the places they cover are rows with n = 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.array(sorted(hot), np.int64)
        dealt_over = np.array([hot[a] for a in sorted(hot)], np.int32)
        for batch in batches:
            for part, texts in pieces(batch):
                encoded = [t.encode() for t in texts]
                raw, begins, ends = side_by_side(encoded)
                h, starts, stops = regions(raw, begins, ends)
                if not len(h):
                    continue
                whole = raw.tobytes()
                content = np.array([hash_of(whole[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)
                owner = np.searchsorted(begins, starts, side="right") - 1
                # a text of no bytes begins where the next does: the last that begins there is the one
                order = np.lexsort((starts, content, signed(h)))
                same = np.append(False, (content[order][1:] == content[order][:-1]) & (h[order][1:] == h[order][:-1]))
                heads = order[~same]
                n = np.diff(np.append(np.flatnonzero(~same), len(order)))
                ids, ties = part.column("doc_id").to_numpy(), part.column("tie").to_numpy()
                salt, salts = np.zeros(len(heads), np.int32), np.ones(len(heads), np.int32)
                if len(frequent):
                    own = signed(h[heads])
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    known = frequent[at] == own
                    salts[known] = dealt_over[at[known]]
                    first = owner[heads[known]]
                    salt[known] = (ties[first] ^ ids[first]) % salts[known]
                base = begins[owner]
                again = order[np.repeat(n > 1, n)]
                covered = merged_by_owner(owner[again], starts[again] - base[again], stops[again] - base[again])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([signed(h[heads]), ties[covered[0]] ^ covered[1]])), pa.array(np.concatenate([salts, np.ones(len(covered[0]), np.int32)])), pa.array(np.concatenate([salt, np.zeros(len(covered[0]), np.int32)])),
                        pa.array(np.concatenate([content[heads], np.zeros(len(covered[0]), np.int64)])),
                        pa.array(np.concatenate([ids[owner[heads]], ids[covered[0]]])), pa.array(np.concatenate([ties[owner[heads]], ties[covered[0]]])),
                        pa.array(np.concatenate([(starts - base)[heads], covered[1]]).astype(np.int32)), pa.array(np.concatenate([(stops - base)[heads], covered[2]]).astype(np.int32)),
                        pa.array(np.concatenate([n, np.zeros(len(covered[0]), np.int64)]).astype(np.int32)),
                    ],
                    ["anchor", "salts", "salt", "content", "doc_id", "tie", "start", "end", "n"],
                )

    return rows.select("doc_id", "tie", "text").mapInArrow(run, "anchor long, salts int, salt int, content long, doc_id long, tie long, start int, end int, n int")


def hash_of(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where they touch or overlap."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    heads = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[heads], ends[np.append(heads[1:], len(starts)) - 1]


def merged_by_owner(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``merged`` within each owner."""
    if not len(owner):
        return owner, starts, ends
    shift = int(ends.max()) + 2
    a, b = merged(owner * shift + starts, owner * shift + ends)
    return a // shift, a % shift, a % shift + (b - a)


# ---------------------------------------------------------------- suffix arrays


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, the first byte highest."""
    out = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        out = (out[:-size] << np.uint64(8 * size)) | out[size:]
    return out[: len(text)]


def suffix_array(first: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the LENGTH bytes from them, by Larsson-Sadakane refinement.

    ``first``: the eight bytes from each position, in regions each closed by a zero; ``left``: bytes left in the
    region from each position. A suffix that ends within the sorted length needs no refinement, as no window starts
    there. Where three ranks fit into one number, a round triples the sorted length, otherwise it doubles it.
    """
    n = len(first)
    times, bits = (3, RANK_BITS) if n <= 1 << RANK_BITS else (2, 31)
    suffixes = np.argsort(first)
    ordered = first[suffixes]
    head = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    alone = head & np.append(head[1:], True)
    slots = np.flatnonzero(~alone)
    done = 8
    while done < LENGTH and len(slots):
        # a group whose bytes end within the sorted length ends as a whole
        slots = slots[left[suffixes[slots]] >= done]
        if not len(slots):
            break
        at = np.sort(suffixes[slots])
        key = rank[at]
        for k in range(1, times):
            key = (key << bits) | rank[np.minimum(at + k * done, n - 1)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        head = np.append(True, key[1:] != key[:-1])
        suffixes[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        slots = slots[~(head & np.append(head[1:], True))]
        done *= times
    return suffixes, rank


def common_prefixes(first: np.ndarray, suffixes: np.ndarray, rank: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Kasai's common prefixes, up to LENGTH, of the suffix of each window start with its neighbour before.

    All regions go side by side: at step t their t-th windows, each beginning with one byte less than the
    last one had in common, if the last one's neighbour without its first byte still sorts before it. Suffixes
    of one group are equal as far as they are sorted. Positions that start no window have 0.
    """
    n = len(first)
    before, follows = np.empty(n, np.int64), np.append(rank, n)
    before[suffixes[1:]], before[suffixes[0]] = suffixes[:-1], -1
    words = np.concatenate([first, np.zeros(LENGTH + 8, np.uint64)])
    common = np.zeros(n, np.int32)
    order = np.argsort(-windows, kind="stable")
    starts, windows = starts[order], windows[order]
    have = np.zeros(len(starts), np.int64)
    for t in range(int(windows.max(initial=0))):
        lanes = int(np.searchsorted(-windows, -t, side="left"))  # regions with more than t windows
        at = starts[:lanes] + t
        other = before[at]
        h = np.zeros(lanes, np.int64)
        if t:
            last = before[at - 1]
            h = np.where((last >= 0) & (follows[last + 1] < rank[at]), np.maximum(have[:lanes] - 1, 0), 0)
        h[other < 0] = 0
        h[(other >= 0) & (rank[other] == rank[at])] = LENGTH
        open_lanes = np.flatnonzero((other >= 0) & (h < LENGTH))
        while len(open_lanes):
            differ = words[at[open_lanes] + h[open_lanes]] ^ words[other[open_lanes] + h[open_lanes]]
            equal = 8 - np.searchsorted(BYTE_PLACES, differ, side="right")
            h[open_lanes] += equal
            open_lanes = open_lanes[(equal == 8) & (h[open_lanes] < LENGTH)]
        have[:lanes] = np.minimum(h, LENGTH)
        common[at] = have[:lanes]
    return common


BYTE_PLACES = np.uint64(1) << np.uint64(8) * np.arange(8, dtype=np.uint64)


class Shard:
    """The suffix array of a shard's regions and the windows that occur in it more than once."""

    def __init__(self, contents: list[bytes]):
        lengths = np.fromiter(map(len, contents), np.int64, len(contents))
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        joined = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8)
        self.raw = joined
        text = joined + np.uint8(1)  # UTF-8 has no byte 255, so the closing byte becomes 0
        position = np.arange(len(text))
        region = np.repeat(np.arange(len(contents)), lengths + 1)
        left = (self.starts + lengths)[region] - position
        windows = np.maximum(lengths - LENGTH + 1, 0)
        first = words_of(text)
        suffixes, rank = suffix_array(first, left)
        common = common_prefixes(first, suffixes, rank, self.starts, windows)
        valid = left >= LENGTH
        joins = common[suffixes] >= LENGTH  # with the neighbour before
        twice = np.zeros(len(text), bool)
        twice[suffixes[joins]] = True
        twice[suffixes[:-1][joins[1:]]] = True
        self.twice = twice & valid
        own = valid[suffixes]
        self.sorted_windows = suffixes[own & ~(joins & own)]  # the first of each class of equal windows
        self.region = region


def covered(shard: Shard, singles: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
    """(region, starts, ends) of the bytes to remove in the regions ``singles`` marks."""
    at = np.flatnonzero(shard.twice & singles[shard.region])
    for r, a, b in _by_region(shard.region[at], at - shard.starts[shard.region[at]]):
        yield r, a, b


def _by_region(owner: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
    who, a, b = merged_by_owner(owner, starts, starts + LENGTH)
    for r in np.unique(who).tolist():
        lo, hi = np.searchsorted(who, [r, r + 1])
        yield r, a[lo:hi].tolist(), b[lo:hi].tolist()


REMOVED = "doc_id long, tie long, starts array<int>, ends array<int>"
REMOVED_ARROW = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def shard_duplicates(shards: DataFrame) -> DataFrame:
    """Bytes to remove from regions that occur once, by the suffix array of each shard."""

    def run(table: pa.Table) -> pa.Table:
        found = Shard(table.column("bytes").to_pylist())
        ids, ties = table.column("doc_id").to_numpy(), table.column("tie").to_numpy()
        base, singles = table.column("start").to_numpy(), table.column("n").to_numpy() == 1
        rows = [(int(ids[r]), int(ties[r]), [int(base[r]) + x for x in a], [int(base[r]) + x for x in b]) for r, a, b in covered(found, singles)]
        return pa.Table.from_arrays([pa.array([x[k] for x in rows], REMOVED_ARROW.field(k).type) for k in range(4)], schema=REMOVED_ARROW)

    return shards.groupBy("anchor", "salt").applyInArrow(run, REMOVED)


WINDOWS = "anchor long, part int, salt long, keys binary, doc_ids array<long>, ties array<long>, starts array<int>"


def shard_windows(shards: DataFrame) -> DataFrame:
    """The distinct windows of shards that share an anchor with others: sorted 16-byte keys, in ranges.

    A window that its shard holds twice, or whose region does, is known already; its start is -1.
    """
    schema = pa.schema([
        ("anchor", pa.int64()), ("part", pa.int32()), ("salt", pa.int64()), ("keys", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("ties", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())),
    ])

    def run(table: pa.Table) -> pa.Table:
        found = Shard(table.column("bytes").to_pylist())
        ids, ties, base = (table.column(c).to_numpy() for c in ("doc_id", "tie", "start"))
        once = table.column("n").to_numpy() == 1
        parts = table.column("parts")[0].as_py()
        raw = found.raw.tobytes()
        at = found.sorted_windows
        keys = np.array([hashlib.blake2b(raw[p : p + LENGTH], digest_size=16).digest() for p in at.tolist()], "S16")
        # numpy's S16 drops closing zeros, so keys are kept as two numbers
        pair = np.frombuffer(b"".join(k.ljust(16, b"\0") for k in keys.tolist()), ">u8").reshape(-1, 2)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        pair, at = pair[order], at[order]
        part = (pair[:, 0] >> np.uint64(32)).astype(np.int64) * parts >> 32  # ranges of the sorted keys
        region = found.region[at]
        starts = np.where(found.twice[at] | ~once[region], -1, base[region] + at - found.starts[region])
        rows = []
        for p in np.unique(part).tolist():
            lo, hi = np.searchsorted(part, [p, p + 1])
            rows.append({
                "anchor": table.column("anchor")[0].as_py(), "part": p, "salt": table.column("salt")[0].as_py(), "keys": pair[lo:hi].tobytes(),
                "doc_ids": ids[region[lo:hi]].tolist(), "ties": ties[region[lo:hi]].tolist(), "starts": starts[lo:hi].tolist(),
            })
        return pa.Table.from_pylist(rows, schema)

    return shards.groupBy("anchor", "salt").applyInArrow(run, WINDOWS)


def merge_shards(windows: DataFrame) -> DataFrame:
    """Windows that another shard of their anchor holds as well, by binary search in its sorted list."""

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, ">u8").reshape(-1, 2) for k in table.column("keys").to_pylist()]
        seen = np.zeros((0, 2), np.uint64)
        hits = [np.zeros(len(x), bool) for x in lists]
        where = np.zeros((0, 2), np.int64)  # list and place of each window seen
        for i, own in enumerate(lists):
            at = np.searchsorted(seen[:, 0], own[:, 0])
            found = np.zeros(len(own), bool)
            while True:  # equal first halves lie side by side
                inside = (at < len(seen)) & ~found
                inside[inside] &= seen[at[inside], 0] == own[inside, 0]
                if not inside.any():
                    break
                same = np.zeros(len(own), bool)
                same[inside] = seen[at[inside], 1] == own[inside, 1]
                for k in np.flatnonzero(same).tolist():
                    j, place = where[at[k]]
                    hits[i][k] = hits[j][place] = True
                found |= same
                at = at + (inside & ~same)
            new = np.flatnonzero(~found)
            seen, where = np.concatenate([seen, own[new]]), np.concatenate([where, np.stack([np.full(len(new), i), new], axis=1)])
            order = np.lexsort((seen[:, 1], seen[:, 0]))
            seen, where = seen[order], where[order]
        rows = []
        for i, hit in enumerate(hits):
            ids, ties, starts = (table.column(c)[i].as_py() for c in ("doc_ids", "ties", "starts"))
            rows += [(ids[k], ties[k], [starts[k]], [starts[k] + LENGTH]) for k in np.flatnonzero(hit).tolist() if starts[k] >= 0]
        return pa.Table.from_arrays([pa.array([x[k] for x in rows], REMOVED_ARROW.field(k).type) for k in range(4)], schema=REMOVED_ARROW)

    return windows.groupBy("anchor", "part").applyInArrow(run, REMOVED)


# ---------------------------------------------------------------- the whole

def packed_texts(rows: DataFrame) -> DataFrame:
    """doc_id, tie, no_id, packed (compressed bytes): a third of the text travels to the joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [compressor.compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), batch.column("no_id"), pa.array(texts, pa.binary())], ["doc_id", "tie", "no_id", "packed"])

    return rows.mapInArrow(run, "doc_id long, tie long, no_id boolean, packed binary")


def unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def region_rows(stored: DataFrame, shared_only: bool = False) -> DataFrame:
    """The content of every region kept for its content: anchor, salt (its shard), parts, doc_id, tie, start, n, bytes.

    ``shared_only``: only regions of anchors that are dealt over several shards.
    """
    schema = pa.schema([
        ("anchor", pa.int64()), ("salt", pa.int64()), ("parts", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()),
        ("start", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("kept")
            found, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
            anchor, shard, parts, start, end, n = (found.field(c) for c in ("anchor", "shard", "parts", "start", "end", "n"))
            spans = list(zip(start.to_pylist(), end.to_pylist(), strict=True))
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at, contents, size = 0, [], 0
            for row, (packed, to) in enumerate(zip(batch.column("packed"), ends.tolist(), strict=True)):
                raw = unpacked(packed.as_py())
                own = [raw[x:y] for x, y in spans[at + len(contents) : to]]
                contents += own
                size += sum(map(len, own))
                if size >= SHARD_BYTES or row == batch.num_rows - 1:
                    here = pa.array(owner[at:to])
                    columns = [*(c[at:to] for c in (anchor, shard, parts)), batch.column("doc_id").take(here), batch.column("tie").take(here), start[at:to], n[at:to]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(contents, pa.binary())], schema=schema)
                    at, contents, size = to, [], 0

    kept = F.filter("regions", lambda r: r["kept"] & (r["shard"] >= 0) if shared_only else r["kept"])
    found = stored.select("doc_id", "tie", "packed", kept.alias("kept")).where(F.size("kept") > 0)
    return found.mapInArrow(run, "anchor long, salt long, parts int, doc_id long, tie long, start int, n int, bytes binary")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>"


def results(texts: DataFrame) -> DataFrame:
    """What is left of each text; ``spans``: intervals to remove, in any order, or null."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
        ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in schema]
            nothing = np.zeros(0, np.int64)
            for doc_id, no_id, packed, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "no_id", "packed", "spans")), strict=True):
                raw = unpacked(packed)
                if not spans:
                    a = b = nothing
                else:
                    a, b = merged(np.array([s["a"] for s in spans], np.int64), np.array([s["b"] for s in spans], np.int64))
                cuts = np.concatenate([[0], np.stack([a, b], axis=1).ravel(), [len(raw)]]).tolist()
                kept = hashlib.sha256(b"".join(raw[x:y] for x, y in zip(cuts[0::2], cuts[1::2], strict=True))).hexdigest()
                for column, value in zip(columns, (None if no_id else doc_id, len(raw), int((b - a).sum()), len(a), kept, a.tolist(), b.tolist()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.select("doc_id", "no_id", "packed", "spans").mapInArrow(run, RESULT)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed starts and ends."""
    spark = df.sparkSession
    rows = keyed(df, id_col, text_col)

    # frequent anchors: at most HOT_ANCHORS rows, each with more than one in HOT_ANCHORS of all occurrences
    path = new_work_path(spark, "anchors")
    anchor_counts(rows).where("n > 1").write.parquet(path)
    counts = spark.read.parquet(path)
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(FEW, total // HOT_ANCHORS)
    hot = {r["anchor"]: -(-r["n"] // least) for r in counts.where(F.col("n") > least).collect()}

    # regions whose anchor recurs; one of each content is kept for the suffix arrays
    dealt = occurrences(rows, hot).repartition("anchor", "salt")
    by_anchor, by_content = Window.partitionBy("anchor", "salt"), Window.partitionBy("anchor", "salt", "content")
    # an anchor's only content goes whole and has no window in common with any other
    several_contents = (F.col("salts") > 1) | (F.col("in_content") < F.col("in_anchor"))
    kept = (F.col("n") > 0) & (F.col("place") == 1) & several_contents
    shards_here = F.greatest(F.lit(1), F.ceil(F.col("size") / SHARD_BYTES)).cast("int")
    shared = (F.col("salts") > 1) | (F.col("shards_here") > 1)
    own_shard = F.pmod(F.xxhash64("doc_id", "tie", "start"), F.col("shards_here").cast("long"))
    recurring = (
        dealt.withColumn("in_anchor", F.sum("n").over(by_anchor)).where("in_anchor <> 1 OR salts > 1")
        .withColumn("in_content", F.sum("n").over(by_content))
        .withColumn("place", F.row_number().over(by_content.orderBy("doc_id", "tie", "start")))
        .withColumn("size", F.sum(F.when(kept, F.col("end") - F.col("start")).otherwise(0).cast("long")).over(by_anchor))
        .withColumn("shards_here", shards_here)
        .select(
            "doc_id", "tie",
            F.struct(
                "anchor", "start", "end", F.least(F.col("in_content"), F.lit(2)).cast("int").alias("n"), kept.alias("kept"),
                ((F.col("n") == 0) | (F.col("in_content") > 1)).alias("whole"),
                F.when(shared, F.shiftleft(F.col("salt").cast("long"), 32) + own_shard).otherwise(-1).alias("shard"),
                F.when(F.col("salts") > 1, 4 * F.col("salts")).otherwise(F.col("shards_here")).alias("parts"),
            ).alias("region"),
        )
    )
    per_text = recurring.groupBy("doc_id", "tie").agg(
        F.collect_list("region").alias("regions"), F.bool_or((F.col("region.shard") >= 0) & F.col("region.kept")).alias("in_shared")
    )
    path = new_work_path(spark, "regions")
    packed_texts(rows).join(per_text, ["doc_id", "tie"], "left").write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)

    # shards: anchors together, or one anchor over several
    some = stored.where("regions IS NOT NULL")
    size = F.aggregate(F.filter("regions", lambda r: r["kept"]), F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    n_shards = max(1, math.ceil((some.agg(F.sum(size)).first()[0] or 0) / SHARD_BYTES))
    placed = F.when(F.col("salt") >= 0, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))
    removed = shard_duplicates(region_rows(some).withColumn("anchor", placed))
    several = some.where("in_shared")
    if not several.isEmpty():
        removed = removed.unionByName(merge_shards(shard_windows(region_rows(several, shared_only=True))))
    path = new_work_path(spark, "removed")
    removed.write.parquet(path)
    removed = spark.read.parquet(path)

    # what is left: texts without a recurring region keep all; the others meet their intervals
    intervals = removed.select("doc_id", "tie", F.explode(F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b"))).alias("span"))
    spans = intervals.groupBy("doc_id", "tie").agg(F.collect_list("span").alias("found"))
    whole = F.transform(F.filter("regions", lambda r: r["whole"]), lambda r: F.struct(r["start"].alias("a"), r["end"].alias("b")))
    rest = stored.where("regions IS NULL").select("doc_id", "no_id", "packed", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    cut = some.join(spans, ["doc_id", "tie"], "left").select("doc_id", "no_id", "packed", F.concat(whole, F.coalesce("found", F.expr("array()").cast("array<struct<a:int,b:int>>"))).alias("spans"))
    return results(rest.unionByName(cut))
