"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are turned into integers. For segments of a vector, the squared distance of two vectors is at least
the sum over segments of length * ((difference of means)^2 + (difference of deviations)^2); with the exact
norms this bounds the inner product from above. A query meets every candidate of a block at the coarsest
resolution, then only survivors at finer ones, and exact products are taken of the pairs that are left.

The queries are cut into blocks, the candidates into blocks, and the pairs of blocks into tiles: a group of query
blocks beside a group of candidate blocks. A tile is one task, which holds its queries while the candidates pass, so
a query is sent once for each group of candidates, nothing is joined and nothing passes the driver.
A first pass takes the exact scores of the k candidates of each block that the coarsest bounds put highest;
the k-th best of them over all blocks is the score that a query's candidates have to beat in the second pass,
where it rises with what a tile finds. Each tile gives at most k rows for a query, of which the best k
are kept. ``pruning`` tells how many pairs were left at every resolution.

Cases: a row with a null id, or a vector that is null, empty or holds a null or non-finite component, takes
no part; vectors of different lengths never meet; ties go to the smaller id; repeated rows are separate
candidates but one query, and a query never meets a row of its own id; fewer candidates than k give fewer
rows; an empty table gives an empty result; only the id and vector columns are read. Components count as
whole numbers of any size while the scaled component is a finite double (else the vector takes no part);
candidates are ordered by exact scores, and a score beyond the range of long is shown as that range's end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierworks.session import new_work_path

SCALE = 256
ROWS = 4096  # vectors in a block
BLOCK = 2**20  # and components in it
SLAB = 256  # queries of a block that meet its candidates at once
EXACT_FLOAT = 2.0**52  # products below it are exact in doubles
EXACT_SINGLE = 2.0**24  # and in single precision
FIRST = 8  # exact scores are first taken of so many times k candidates with the highest bounds
GROUP = 2**23  # components of the queries that a tile holds
PASSING = 2**24  # and of the candidates that pass them
PAIRS = 2**24  # pairs of vectors that a tile has at least
SPARSE = 64  # below one pair left in so many, bounds are taken pair by pair
NONE, LAST = -(2**62), 2**63 - 1  # score and id of an empty place
LONG = 2**63 - 1


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, v (array<double> of whole numbers), d (length): floor(scale * x) of every component, bad vectors left out."""
    scaled = lambda x: x.cast("double") * scale
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(scaled(x)) | (F.abs(scaled(x)) == float("inf")))
    rows = df.where(df[id_col].isNotNull() & (F.size(vector_col) > 0)).where(~bad)
    # doubles from 2^53 on are whole, and beyond the range of F.floor
    v = F.transform(vector_col, lambda x: F.when(F.abs(scaled(x)) < EXACT_FLOAT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return rows.select(df[id_col].cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("d"))


def narrow(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers in the smallest type that holds them."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(next((t for t, top in ((np.int8, 127), (np.int16, 32767), (np.int32, 2**31 - 1)) if most <= top), np.float64))


def packed(rows: DataFrame, n_blocks: int, most: int) -> DataFrame:
    """Blocks of about ``most`` vectors, fewer of long ones: d, place (even numbers of the blocks), ids and bars (lists), kind (type of a number)
    and data (the numbers, row by row)."""
    n_tasks = min(n_blocks, max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-n_blocks // 16)))
    most += -(-most // 8)  # rows are dealt out nearly evenly

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, float, np.ndarray]]] = {}
        place = TaskContext.get().partitionId()

        def out(d: int) -> pa.RecordBatch:
            nonlocal place
            own = held.pop(d)
            data = narrow(np.array([v for *_, v in own], float))
            columns = [
                pa.array([d], pa.int32()), pa.array([place], pa.int32()), pa.array([[i for i, *_ in own]], pa.list_(pa.int64())),
                pa.array([[b for _, b, _ in own]], pa.list_(pa.float64())), pa.array([data.dtype.str]), pa.array([data.tobytes()], pa.binary()),
            ]
            place += n_tasks
            return pa.RecordBatch.from_arrays(columns, ["d", "place", "ids", "bars", "kind", "data"])

        for batch in batches:
            vectors = batch.column("v")
            for i, (key, bar, d) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "bar", "d")), strict=True)):
                held.setdefault(d, []).append((key, bar, vectors[i].values.to_numpy()))
                if len(held[d]) == most or len(held[d]) * d >= BLOCK:
                    yield out(d)
        for d in list(held):
            yield out(d)

    schema = "d int, place int, ids array<long>, bars array<double>, kind string, data binary"
    return rows.select("id", "bar", "v", "d").repartition(n_tasks).mapInArrow(run, schema)


def statistics(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each segment, both times the root of the segment's length."""
    cuts = np.linspace(0, vectors.shape[1], segments + 1).astype(int)[:-1]
    sizes = np.diff(np.append(cuts, vectors.shape[1])).astype(float)
    means = np.add.reduceat(vectors, cuts, axis=1) / sizes
    with np.errstate(over="ignore", invalid="ignore"):  # where squares pass the range of doubles, no bound is taken
        squares = np.add.reduceat(vectors * vectors, cuts, axis=1) / sizes
        return means * np.sqrt(sizes), np.sqrt(np.maximum(squares - means * means, 0)) * np.sqrt(sizes)


def levels(d: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest has segments of about two components."""
    return [n for n in (4, 8, 16, 32, 64) if 2 * n <= d] or [1]


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Row by row, exact; in whole numbers of any size where doubles don't suffice."""
    size = max(np.abs(queries).max(initial=0), np.abs(candidates).max(initial=0))
    if size < 2**26 and size * size * queries.shape[1] < EXACT_FLOAT:
        return np.einsum("ij,ij->i", queries, candidates).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q, c, strict=True)) for q, c in zip(queries, candidates, strict=True)], object)


def segment_vectors(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations side by side; the product of two such rows bounds the product of the vectors from above.

    It is (norm + norm - lower distance) / 2, as a vector's norm is that of its means and deviations.
    """
    return np.hstack(statistics(vectors, segments))


def lower_bar(score: int) -> float:
    """A double that is not above the score."""
    if abs(score) >= 10**300:
        return 1e299 if score > 0 else -np.inf
    return float(score) - 1e-9 * abs(float(score))


def sortable(score: int) -> bytes:
    """Bytes that sort as the whole numbers do."""
    size = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return b"\1" + size.to_bytes(4) + score.to_bytes(size)
    return b"\0" + (2**32 - 1 - size).to_bytes(4) + (256**size + score).to_bytes(size)


class Block:
    """Vectors with their statistics at every resolution, worked out when first asked for."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        with np.errstate(over="ignore"):
            self.norms = np.linalg.norm(vectors, axis=1)
        self.vectors, self.ids, self.made = vectors, ids, {}
        self.longest = self.norms.max(initial=0)
        self.steps = levels(vectors.shape[1])

    def at(self, segments: int) -> np.ndarray:
        if segments not in self.made:
            self.made[segments] = segment_vectors(self.vectors, segments)
        return self.made[segments]

    def kept(self, what: str | int, kind: type, *more: np.ndarray | float) -> np.ndarray:
        """The vectors or their statistics in a type, with further columns."""
        if (what, kind) not in self.made:
            own = self.vectors if what == "v" else segment_vectors(self.vectors, what)
            self.made[what, kind] = np.column_stack([own, *(np.broadcast_to(m, len(own)) for m in more)]).astype(kind)
        return self.made[what, kind]


class Asked:
    """A block of queries in slabs, with the scores to beat and, as a tile goes on, the best k that were found."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, bars: np.ndarray, k: int):
        self.bars = bars
        self.scores, self.ids = np.full((len(ids), k), NONE, np.int64), np.full((len(ids), k), LAST, np.int64)
        self.slabs = [(at, Block(vectors[at : at + SLAB], ids[at : at + SLAB])) for at in range(0, len(ids), SLAB)]
        self.first, self.met = np.full((len(ids), k), -np.inf), set()

    def fresh(self, at: int) -> bool:
        """Whether the slab meets its first candidates of the tile; true once."""
        if new := at not in self.met:
            self.met.add(at)
        return new

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of the queries, which are numbered within the block."""
        k = self.scores.shape[1]
        last, last_id = self.scores[q, k - 1], self.ids[q, k - 1]
        better = (scores > last) | ((scores == last) & (ids < last_id))
        q, ids, scores = q[better], ids[better], scores[better]
        if not len(q):
            return
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        begins = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        counts = np.diff(np.append(begins, len(q)))
        rows, at = q[begins], np.repeat(np.arange(len(begins)), counts)
        rank = np.arange(len(q)) - np.repeat(begins, counts)
        top = rank < k
        new, new_ids = np.full((len(rows), k), NONE, np.int64), np.full((len(rows), k), LAST, np.int64)
        new[at[top], rank[top]], new_ids[at[top], rank[top]] = scores[top], ids[top]
        both, both_ids = np.hstack([self.scores[rows], new]), np.hstack([self.ids[rows], new_ids])
        order = np.lexsort((both_ids.ravel(), -both.ravel(), np.repeat(np.arange(len(rows)), 2 * k))).reshape(-1, 2 * k)[:, :k]
        self.scores[rows], self.ids[rows] = both.ravel()[order], both_ids.ravel()[order]
        least = self.scores[rows, k - 1]
        self.bars[rows] = np.maximum(self.bars[rows], np.where(least > NONE, least, -np.inf))


def precision(queries: Block, candidates: Block) -> type | None:
    """The type of numbers in which the products of the vectors are exact; None if whole numbers of any size are needed."""
    size = queries.longest * candidates.longest
    return np.float32 if size < EXACT_SINGLE else np.float64 if size < EXACT_FLOAT else None


def bounds(queries: Block, candidates: Block, segments: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products are upper bounds of the scores at a resolution. Two more columns leave room for rounding."""
    room = 2e-5 if kind is np.float32 else 1e-7
    return queries.kept(segments, kind, room * queries.norms, 0.5), candidates.kept(segments, kind, candidates.norms, 1.0)


def own_rows(queries: Block, candidates: Block) -> tuple[np.ndarray, np.ndarray]:
    """Candidates whose id is one of the queries', and for them where query and candidate differ in their id."""
    columns = np.flatnonzero(np.isin(candidates.ids, queries.ids))
    return columns, queries.ids[:, None] != candidates.ids[columns][None, :]


def coarse(queries: Block, candidates: Block) -> np.ndarray:
    """Upper bounds of all scores at the coarsest resolution; -inf where a query meets a row of its own id."""
    segments = candidates.steps[0]
    if kind := precision(queries, candidates):
        asked, offered = bounds(queries, candidates, segments, kind)
        bound = asked @ offered.T
        columns, other = own_rows(queries, candidates)
        bound[:, columns] = np.where(other, bound[:, columns], -np.inf)
        return bound
    room = 0.5 + 1e-9 * queries.norms[:, None] * candidates.norms[None, :]  # for rounding
    bound = np.nan_to_num(queries.at(segments) @ candidates.at(segments).T + room, nan=np.inf, posinf=np.inf)
    bound[queries.ids[:, None] == candidates.ids[None, :]] = -np.inf
    return bound


def first_scores(queries: Block, candidates: Block, k: int) -> np.ndarray:
    """(Lower ends of) exact scores of each query's k candidates with the highest bounds; -inf where there are fewer."""
    bound = coarse(queries, candidates)
    n, k = np.arange(len(bound)), min(k, bound.shape[1])
    if k <= 16:
        some, met = np.empty((len(bound), k), np.int64), np.empty((len(bound), k), bool)
        for i in range(k):
            some[:, i] = bound.argmax(axis=1)
            met[:, i] = bound[n, some[:, i]] > -np.inf
            bound[n, some[:, i]] = -np.inf
    else:
        some = np.argpartition(-bound, k - 1, axis=1)[:, :k]
        met = np.take_along_axis(bound, some, 1) > -np.inf
    scores = np.full(some.shape, -np.inf)
    q, i = np.nonzero(met)
    found = products(queries.vectors[q], candidates.vectors[some[q, i]])
    scores[q, i] = found if found.dtype == np.int64 and precision(queries, candidates) else [lower_bar(int(s)) for s in found]
    return scores


def not_above(bars: np.ndarray, kind: type) -> np.ndarray:
    """The bars in a type of numbers, none of them raised."""
    with np.errstate(over="ignore"):
        cast = bars.astype(kind)
    return np.where(cast > bars, np.nextafter(cast, kind(-np.inf)), cast)


def raised(queries: Block, candidates: Block, bars: np.ndarray, kind: type, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bars after the exact scores of the FIRST * k highest bounds, and which pairs these are."""
    n = min(FIRST * k, bound.shape[1])
    some = np.argpartition(-bound, n - 1, axis=1)[:, :n]
    q, i = np.nonzero(np.take_along_axis(bound, some, 1) > -np.inf)
    scores, front = np.full(some.shape, -np.inf), np.zeros(bound.shape, bool)
    scores[q, i] = np.einsum("ij,ij->i", queries.kept("v", kind)[q], candidates.kept("v", kind)[some[q, i]])
    front[q, some[q, i]] = True
    return (np.maximum(bars, not_above(np.partition(scores, n - k, axis=1)[:, n - k], kind)) if n >= k else bars), front


def beaten(
    queries: Block, candidates: Block, bars: np.ndarray, kind: type, k: int, fresh: bool
) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(query numbers, candidate numbers, scores) of the pairs that are not below the bars, and the numbers of pairs as in
    :func:`best_of_block`. Bounds are products of whole slabs while many pairs are left, then of the pairs that are.
    ``fresh``: no score of the tile has raised the bars yet, so the highest bounds go first."""
    bars = not_above(bars, kind)
    left = np.zeros(len(candidates.steps) + 2, np.int64)
    left[0] = len(bars) * len(candidates.ids)
    alive, q, c = np.ones((len(bars), len(candidates.ids)), bool), None, None
    columns, other = own_rows(queries, candidates)
    alive[:, columns] = other

    def pairs_left() -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(np.flatnonzero(alive.ravel()), alive.shape[1])

    for i, segments in enumerate(candidates.steps, start=1):
        asked, offered = bounds(queries, candidates, segments, kind)
        if q is None and left[i - 1] * SPARSE < left[0]:
            q, c = pairs_left()
        if q is None:
            bound = asked @ offered.T
            alive &= bound >= bars[:, None]
            left[i] = np.count_nonzero(alive)
        else:
            good = np.einsum("ij,ij->i", asked[q], offered[c]) >= bars[q]
            q, c = q[good], c[good]
            left[i] = len(q)
        if not left[i]:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)), left
    left[-1] = left[-2]
    asked, offered = queries.kept("v", kind), candidates.kept("v", kind)
    if q is None and left[-1] * SPARSE < left[0]:
        q, c = pairs_left()
    if q is None:
        if fresh:
            bound[~alive] = -np.inf
            bars, front = raised(queries, candidates, bars, kind, k, bound)
            alive &= bound >= bars[:, None]
            left[-1] = np.count_nonzero(alive | front)
        scores = asked @ offered.T
        alive &= scores >= bars[:, None]
        q, c = pairs_left()
        scores = scores[q, c]
    else:
        scores = np.einsum("ij,ij->i", asked[q], offered[c])
        good = scores >= bars[q]
        q, c, scores = q[good], c[good], scores[good]
    return (q, c, scores.astype(np.int64)), left


def best_of_block(queries: Block, candidates: Block, bars: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(query number, candidate number, score) of each query's k best candidates that are not below its bar, for numbers of any size.

    ``bars`` is raised to the k-th best score found. Also the numbers of pairs met, left after every resolution,
    and compared by their exact scores.
    """
    bound = coarse(queries, candidates)
    left = np.zeros(len(candidates.steps) + 2, np.int64)
    left[0] = bound.size
    found = []
    for q in range(len(bound)):
        alive = np.flatnonzero((bound[q] >= bars[q]) & (bound[q] > -np.inf))
        finest = bound[q][alive]
        left[1] += len(alive)
        for i, segments in enumerate(candidates.steps[1:], start=2):
            room = 0.5 + 1e-9 * queries.norms[q] * candidates.norms[alive]
            finest = np.nan_to_num(candidates.at(segments)[alive] @ queries.at(segments)[q] + room, nan=np.inf, posinf=np.inf)
            kept = finest >= bars[q]
            alive, finest = alive[kept], finest[kept]
            left[i] += len(alive)
        # the highest bounds first: their exact scores raise the bar for the rest
        best: list[tuple[int, int, int]] = []
        if len(alive) > FIRST * k:
            front = np.zeros(len(alive), bool)
            front[np.argpartition(-finest, FIRST * k)[: FIRST * k]] = True
            parts = [alive[front], alive[~front]]
            ends = finest[~front]
        else:
            parts, ends = [alive], None
        for n, chosen in enumerate(parts):
            if n:
                chosen = chosen[ends >= bars[q]]
            left[-1] += len(chosen)
            vectors = candidates.vectors[chosen]
            scores = products(np.broadcast_to(queries.vectors[q], vectors.shape), vectors)
            best = sorted([*best, *zip((-int(s) for s in scores), candidates.ids[chosen].tolist(), chosen.tolist(), strict=True)])[:k]
            if len(best) == k:
                bars[q] = max(bars[q], lower_bar(-best[-1][0]))
        found += [(q, c, -s) for s, _, c in best]
    return found, left


def unpacked(kind: str, data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(kind)).reshape(-1, d).astype(float)


def tiles(asked: DataFrame, offered: DataFrame, high: int, wide: int) -> DataFrame:
    """Every block of queries in one task with every block of candidates: the stated query set against all rows.

    A query block goes to one tile for each of the ``wide`` groups of candidate blocks, a candidate block to one for each of
    the ``high`` groups of query blocks; every tile is a partition in which the queries come first.
    """
    columns = ["tile", "offered", "d", "ids", "bars", "kind", "data"]
    asked = asked.withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    asked = asked.withColumns({"tile": F.expr(f"pmod(place, {high}) * {wide} + across"), "offered": F.lit(False)})
    offered = offered.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    offered = offered.withColumns({"tile": F.expr(f"down * {wide} + pmod(place, {wide})"), "offered": F.lit(True)})
    rows = asked.select(*columns).unionByName(offered.select(*columns))
    return rows.repartitionById(high * wide, "tile").sortWithinPartitions("tile", "offered")


def meetings(
    batches: Iterator[pa.RecordBatch], k: int, meet: Callable[[Asked, int, Block, Block], pa.RecordBatch | None], end: Callable[[Asked], pa.RecordBatch | None]
) -> Iterator[pa.RecordBatch]:
    """``meet`` over every slab of queries and block of candidates of a tile, ``end`` over its blocks of queries."""
    held: dict[int, list[Asked]] = {}
    tile = None

    def ended() -> Iterator[pa.RecordBatch]:
        for d in list(held):
            for asked in held.pop(d):
                if (made := end(asked)) is not None:
                    yield made

    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            if row["tile"].as_py() != tile:
                yield from ended()
                tile = row["tile"].as_py()
            d = row["d"].as_py()
            vectors, ids = unpacked(row["kind"].as_py(), row["data"].as_buffer(), d), row["ids"].values.to_numpy()
            if not row["offered"].as_py():
                bars = row["bars"].values.to_numpy(zero_copy_only=False).astype(float)
                held.setdefault(d, []).append(Asked(vectors, ids.copy(), np.where(np.isnan(bars), -np.inf, bars), k))
                continue
            candidates = Block(vectors, ids) if d in held else None
            for asked in held.get(d, []):
                for at, queries in asked.slabs:
                    if (made := meet(asked, at, queries, candidates)) is not None:
                        yield made
    yield from ended()


def blocks(df: DataFrame, is_query: Column, k: int, scale: int, id_col: str, vector_col: str, rows: int) -> DataFrame:
    """The work of the second pass: tiles of blocks, the queries with the scores that the first pass found for them."""
    vectors = integers(df, id_col, vector_col, scale)
    sums = {"n": F.lit(1), "q": is_query.cast("int"), "c": F.col("d"), "qc": F.when(is_query, F.col("d"))}
    n = {k: v or 0 for k, v in vectors.agg(*(F.sum(v.cast("long")).alias(k) for k, v in sums.items())).first().asDict().items()}
    n_queries, n_candidates = max(1, -(-n["q"] // rows), -(-n["qc"] // BLOCK)), max(1, -(-n["n"] // rows), -(-n["c"] // BLOCK))
    tasks = min(4 * df.sparkSession.sparkContext.defaultParallelism, max(1, n["q"] * n["n"] // PAIRS))
    high = min(n_queries, max(1, -(-n["qc"] // GROUP)))
    wide = min(n_candidates, max(-(-tasks // high), -(-n["c"] // PASSING)))
    none = F.lit(None).cast("double").alias("bar")
    asked = vectors.where(is_query).dropDuplicates(["id", "v"])
    path = new_work_path(df.sparkSession, "vectors")
    packed(vectors.select("*", none), n_candidates, rows).write.parquet(path)
    offered = df.sparkSession.read.parquet(path)

    def meet(asked: Asked, at: int, queries: Block, candidates: Block) -> None:
        held = asked.first[at : at + len(queries.ids)]
        both = np.hstack([held, first_scores(queries, candidates, k)])
        held[:] = -np.partition(-both, k - 1, axis=1)[:, :k]

    def end(asked: Asked) -> pa.RecordBatch:
        ids = np.concatenate([queries.ids for _, queries in asked.slabs])
        q, i = np.nonzero(asked.first > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(asked.first[q, i])], ["id", "bar"])

    first = tiles(packed(asked.select("*", none), n_queries, rows), offered, high, wide)
    first = first.mapInArrow(lambda batches: meetings(batches, k, meet, end), "id long, bar double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("bar")))
    bars = first.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("id", "bar")
    return tiles(packed(asked.join(bars, "id", "left"), n_queries, rows), offered, high, wide)


def found_rows(query_ids: np.ndarray, ids: np.ndarray, scores: list[int]) -> pa.RecordBatch:
    shown = [min(max(s, -LONG - 1), LONG) for s in scores]
    columns = [pa.array(query_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(shown, pa.int64()), pa.array(map(sortable, scores), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "exact"])


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest inner products.

    ``is_query``: a condition on the id column (named ``id`` here) that states the query rows.
    """

    def meet(asked: Asked, at: int, queries: Block, candidates: Block) -> pa.RecordBatch | None:
        bars = asked.bars[at : at + len(queries.ids)]
        if kind := precision(queries, candidates):
            (q, c, scores), _ = beaten(queries, candidates, bars, kind, k, asked.fresh(at))
            asked.add(q + at, candidates.ids[c], scores)
            return None
        found, _ = best_of_block(queries, candidates, bars, k)
        q, c, scores = ([f[i] for f in found] for i in range(3))
        return found_rows(queries.ids[q], candidates.ids[c], scores)

    def end(asked: Asked) -> pa.RecordBatch:
        ids = np.concatenate([queries.ids for _, queries in asked.slabs])
        q, i = np.nonzero(asked.scores > NONE)
        return found_rows(ids[q], asked.ids[q, i], asked.scores[q, i].tolist())

    work = blocks(df, is_query, k, scale, id_col, vector_col, rows)
    found = work.mapInArrow(lambda batches: meetings(batches, k, meet, end), "query_id long, vec_id long, score long, exact binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(
    df: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS
) -> DataFrame:
    """What :func:`top_k` compares: d, segments (0: all pairs, then every resolution, d: exact scores), pairs left."""

    def meet(asked: Asked, at: int, queries: Block, candidates: Block) -> pa.RecordBatch:
        bars = asked.bars[at : at + len(queries.ids)]
        if kind := precision(queries, candidates):
            (q, c, scores), left = beaten(queries, candidates, bars, kind, k, asked.fresh(at))
            asked.add(q + at, candidates.ids[c], scores)
        else:
            _, left = best_of_block(queries, candidates, bars, k)
        d = queries.vectors.shape[1]
        return pa.RecordBatch.from_arrays([pa.array([d] * len(left)), pa.array([0, *candidates.steps, d]), pa.array(left)], ["d", "segments", "pairs"])

    work = blocks(df, is_query, k, scale, id_col, vector_col, rows)
    left = work.mapInArrow(lambda batches: meetings(batches, k, meet, lambda _: None), "d long, segments long, pairs long")
    return left.groupBy("d", "segments").agg(F.sum("pairs").alias("pairs"))
