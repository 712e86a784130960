"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed letter n-grams; every language has several centroids from
spherical k-means; a text takes the language of the centroid with the highest cosine. It is rejected if it
is farther from the centroids than nearly all texts of that language and length, and no nearer than texts of
another language are. Both are measured on texts, and beginnings of texts, kept from the centroids they meet.

Cases: a null text or one without a letter is ``und`` with score 0 and rejected; without training rows all
are; a null label is not learned from; rows with the same id stay separate; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierworks.llm.batches import crc32_bucket, id_text, keep_rows, map_texts
from tierworks.llm.pretokens import LETTER, classes, code_points
from tierworks.session import new_work_path

DIMENSIONS = 4096
LONGEST_GRAM = 3
ROWS = 256  # texts whose dense vectors are made at once
PER_LANGUAGE = 400  # labelled texts of each language that the centroids are fitted on
LANGUAGES = 256  # values of the label column that are learned
SAMPLE = 8192  # texts of all languages together
CENTROIDS = 4
BINS = 40
PARTS = 16  # tasks the sample is dealt over
FOLDS = 4  # parts of the sample, each measured against centroids of the others
# A text is rejected below this quantile of its language's own cosines, but not above that one of foreign cosines.
OWN, FOREIGN = 0.002, 0.99
FEWEST = 20  # cosines of a language and length from which its own quantile is taken, else that of all languages


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of letters and word gaps, and the number of letters of each text."""
    lowered = [" " + t.lower() for t in texts]
    codes = code_points("".join(lowered)).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = classes()[codes] == LETTER
    letters = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    head = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    keep |= head
    codes[~letter] = 32
    codes, owner = codes[keep], owner[keep]
    counts = np.zeros(len(texts) * DIMENSIONS, np.int64)
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        inside = owner[:m] == owner[n - 1 :]
        slot = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        counts += np.bincount((owner[:m] * DIMENSIONS + slot)[inside], minlength=len(counts))
    return counts.reshape(len(texts), DIMENSIONS), letters


def damped(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts, dtype=np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclasses.dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # one row each, of length 1
    owner: np.ndarray  # index of the language of each centroid
    idf: np.ndarray
    floors: np.ndarray  # lowest accepted cosine by language and length bin

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        names, scores, rejected = [], [], []
        for at in range(0, len(texts), ROWS):
            counts, letters = gram_counts(texts[at : at + ROWS])
            if not self.languages:
                best, cosine = np.zeros(len(letters), int), np.zeros(len(letters))
            else:
                cosines = unit(damped(counts) * self.idf) @ self.centroids.T
                best = cosines.argmax(axis=1)
                cosine = np.clip(cosines[np.arange(len(best)), best].astype(float), 0, 1)
            known = (letters > 0) & bool(self.languages)
            names += [self.languages[self.owner[b]] if k else "und" for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, cosine, 0.0))
            floor = self.floors[self.owner[best], length_bin(letters)] if self.languages else 0.0
            rejected.append(~known | (cosine < floor))
        return names, np.concatenate([*scores, []]), np.concatenate([*rejected, np.zeros(0, bool)]).astype(bool)


def length_bin(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), BINS - 1)


def clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the mean and then, each time, the row farthest from all centers."""
    centers = unit(rows.mean(axis=0, keepdims=True))
    while len(centers) < min(k, len(rows)):
        far = (rows @ centers.T).max(axis=1).argmin()
        centers = np.vstack([centers, rows[far]])
    for _ in range(rounds):
        nearest = (rows @ centers.T).argmax(axis=1)
        centers = unit(np.vstack([rows[nearest == c].mean(axis=0) for c in np.unique(nearest)]))
    return centers


def train(languages: list[str], counts: np.ndarray, letters: np.ndarray, k: int = CENTROIDS) -> Model:
    """Centroids and inverse document frequencies of labelled texts; the model rejects no text with a letter yet."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.05)
    rows = unit(damped(counts) * idf)
    names, labels = sorted(set(languages)), np.array(languages)
    parts = [clusters(rows[labels == name], k) for name in names]
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    centroids = np.vstack(parts).astype(np.float32) if parts else np.zeros((0, DIMENSIONS), np.float32)
    return Model(names, centroids, owner, idf, np.zeros((len(names), BINS)))


def beginnings(text: str) -> list[str]:
    """The text, and for every shorter length bin its first letters to the middle of the bin."""
    at = np.flatnonzero(classes()[code_points(text)] == LETTER)
    sizes = [3 << b for b in range(BINS) if 3 << b < len(at) and 4 << b <= 1 << int(np.log2(len(at)))]
    return [*(text[: at[n - 1] + 1] for n in sizes), text]


def distances(model: Model, language: str, texts: list[str]) -> list[tuple[int, float, float | None]]:
    """(length bin, cosine to the language, cosine to the nearest other language) of each text with a letter."""
    out, mine = [], np.array([model.languages[i] == language for i in model.owner], bool)
    for at in range(0, len(texts), ROWS):
        counts, letters = gram_counts(texts[at : at + ROWS])
        cosines = unit(damped(counts) * model.idf) @ model.centroids.T
        for cosine, n, b in zip(cosines, letters, length_bin(letters).tolist(), strict=True):
            if n and mine.any():
                out.append((b, float(cosine[mine].max()), None if mine.all() else float(cosine[~mine].max())))
    return out


def floors(languages: list[str], found: list[tuple[str, int, float, float | None]]) -> np.ndarray:
    """Lowest accepted cosine by language and length bin, from (language, bin, own cosine, foreign cosine)."""
    out = np.zeros((len(languages), BINS))
    bins = np.array([f[1] for f in found], int)
    own, foreign = (np.array([np.nan if f[i] is None else f[i] for f in found], float) for i in (2, 3))
    labels = np.array([f[0] for f in found])
    cap = -np.inf
    for b in range(BINS):
        here = bins == b
        other = foreign[here & ~np.isnan(foreign)]
        # a longer text of another language is at least as near as a shorter one
        cap = max(cap, float(np.quantile(other, FOREIGN))) if len(other) >= FEWEST else cap
        for i, name in enumerate(languages):
            mine = own[here & (labels == name)]
            mine = mine if len(mine) >= FEWEST else own[here]
            # lengths hardly ever seen are held to what the next shorter one is; the shortest are not rejected
            low = float(np.quantile(mine, OWN)) if len(mine) >= FEWEST else np.nan
            out[i, b] = (out[i, b - 1] if b else 0.0) if np.isnan(low) else min(low, cap) if np.isfinite(cap) else low
    return out


def fit(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    languages: int = LANGUAGES, sample_size: int = SAMPLE,
) -> Model:
    """A model from at most ``per_language`` texts of each language, chosen by a hash of their ids.

    Of a column with more than ``languages`` values the most frequent are learned (ties to the smaller), and all languages
    together give at most ``sample_size`` texts, so many languages give fewer texts each. The first scans read ids and
    labels only and find the hash that bounds each language's sample. The sample is written once; its vectors come to the
    driver, at most sample_size x 8 KB, and then the cosines of its texts and their beginnings, from which the rejection
    floors are taken.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    frequent = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    per_language = max(1, min(per_language, sample_size // max(1, len(frequent))))
    rows = rows.where(F.col(lang_col).isin([r["lang"] for r in frequent]))
    rank = F.coalesce(F.xxhash64(rows[id_col]), F.lit(0))
    order = Window.partitionBy("lang").orderBy("rank")
    bounds = (
        rows.select(F.col(lang_col).alias("lang"), rank.alias("rank"))
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
        .groupBy("lang").agg(F.max("rank").alias("bound")).collect()
    )
    chosen = F.lit(False)
    for b in bounds:
        chosen = chosen | ((rows[lang_col] == b["lang"]) & (rank <= b["bound"]))
    path = new_work_path(labelled.sparkSession, "languages")
    fold = F.pmod(rank, F.lit(FOLDS)).cast("int").alias("fold")
    sample = rows.where(chosen).select(F.col(lang_col).alias("lang"), F.coalesce(rows[text_col], F.lit("")).alias("text"), fold)
    sample.limit(per_language * max(1, len(bounds))).repartition(PARTS, F.xxhash64("text")).write.parquet(path)
    sample = labelled.sparkSession.read.schema("lang string, text string, fold int").parquet(path)

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        made = [gram_counts(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]
        vectors = [row.tobytes() for counts, _ in made for row in np.minimum(counts, 65535).astype(np.uint16)]
        letters = np.concatenate([n for _, n in made])
        return pa.RecordBatch.from_arrays(
            [part.column("lang"), pa.array(vectors, pa.binary()), pa.array(letters, pa.int64()), part.column("fold")], ["lang", "counts", "letters", "fold"]
        )

    found = map_texts(sample, per_piece, "lang string, counts binary, letters long, fold int").where("letters > 0").toArrow()
    counts = np.frombuffer(b"".join(found.column("counts").to_pylist()), np.uint16).reshape(-1, DIMENSIONS)
    langs = found.column("lang").to_pylist()
    order = sorted(range(len(counts)), key=lambda i: (langs[i], counts[i].tobytes()))
    langs, counts = [langs[i] for i in order], counts[order].astype(np.int64)
    letters, folds = found.column("letters").to_numpy()[order], found.column("fold").to_numpy()[order]
    model = train(langs, counts, letters)
    if not model.languages:
        return model
    others = []
    for f in range(FOLDS):
        rest = np.flatnonzero(folds != f)
        others.append(train([langs[i] for i in rest], counts[rest], letters[rest]))

    def measured(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        rows = []
        for lang, text, f in zip(part.column("lang").to_pylist(), texts, part.column("fold").to_pylist(), strict=True):
            rows += [(lang, *d) for d in distances(others[f], lang, beginnings(text))]
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["lang", "bin", "own", "foreign"])

    seen = map_texts(sample, measured, "lang string, bin int, own double, foreign double").collect()
    model.floors = floors(model.languages, [tuple(r) for r in seen])
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, lang_pred, score (best cosine), rejected."""

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        names, scores, rejected = model.predict(texts)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            ["doc_id", "lang_pred", "score", "rejected"],
        )

    return map_texts(id_text(df, id_col, text_col), per_piece, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the model doesn't reject, all columns as they are."""
    return keep_rows(df, text_col, lambda texts: (~model.predict(texts)[2]).tolist())


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return crc32_bucket(id_col, 4) == 2
