"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report verb, clause break, other. Small transducers,
each of which knows one pattern, rewrite the symbols of a clause: an insult with a target in its clause is
aimed, one soon after a negation is denied, one in reported speech is told, a threat at a target is a menace.
They are composed into one transducer, run over the clauses that hold an insult or a threat, and the
rewritten symbols carry the weights.

A text's score is the chance that any of its matches makes it toxic. The matches of learned stems count by the sum
of their weights, calibrated on labelled rows. Those of the hand-written words count by pattern: each pattern has
a chance of its own, for which a prior speaks as so many texts would (``PRIORS``) and labelled rows the rest. So an aimed
insult stays toxic where the labelled rows know no such word. Denied and told matches and threats without a target
count once a text, however often they occur.

The insult words and stems come from a hand-written list and from labelled texts: stems that toxic texts
use far more than clean ones, by more than chance explains. One that clean texts hold as well, but hardly
ever twice, counts only where a text repeats it.

Cases: a null or empty text, or one without a match, gets the lowest score; rows with the same id or text
stay separate; without labels of both kinds the hand-written list and fixed calibration are used; an empty
table gives an empty result; only the named columns are read; a null id or label is not learned from.
"""

from __future__ import annotations

import collections
import dataclasses
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierworks.llm.batches import crc32_bucket, id_text, map_texts
from tierworks.session import new_work_path

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK, AIMED, DENIED, TOLD, MENACE, AIM = range(12)
REPEATED = 12  # a word that is an insult in a text with another of its stem, else any other word; decided before the grammar
HINT = 13  # the same, but alone it is an insult of little weight

# Words of each class in the four languages.
INSULTS = """idiot idiots moron morons scum clown clowns worthless pathetic trash disgusting loser losers stupid dumb imbecile
    fool filthy garbage vermin coward retard bastard bitch asshole jerk dumbass
    idiotin dummkopf trottel abschaum arschloch widerlich wertlos versager blöd blödmann schwachkopf dreckig
    imbécile crétin débile ordure minable pathétique salaud connard abruti stupide dégoûtant
    idiota imbécil estúpido estúpida basura escoria patético asqueroso inútil payaso tonto cabrón""".split()
THREATS = """kill hurt destroy beat stab shoot murder strangle burn töten umbringen verletzen schlagen erschießen tuer frapper
    blesser détruire brûler matar golpear destruir herir quemar""".split()
TARGETS = """you your yours yourself he him she her they them these those people du dich dir dein euch ihr sie
    tu te toi vous ton votre ils elles tú ti usted ustedes tus su ellos ellas""".split()
NEGATIONS = "not never no isn aren wasn don doesn nor neither nicht kein keine nie niemals pas jamais non nunca jamás tampoco".split()
REPORTS = """said says told wrote writes called quoted claimed reported sagte sagt schrieb nannte behauptete zitierte
    déclaré écrit appelé cité dijo dice escribió llamó citó afirmó""".split()
# How much of a word's weight a rewritten symbol keeps.
FACTORS = {INSULT: 1.0, THREAT: 0.3, AIMED: 1.5, DENIED: 0.25, TOLD: 0.4, MENACE: 2.0, AIM: 0.5}
SEED_WEIGHT = 2.5
# Prior chance that one match of a hand-written word makes its text toxic, by pattern.
PRIORS = {INSULT: 0.4, THREAT: 0.05, AIMED: 0.8, DENIED: 0.05, TOLD: 0.1, MENACE: 0.85, AIM: 0.3}
PRIOR_TEXTS = 40.0  # labelled texts that the prior of a pattern is worth
ONCE = (THREAT, DENIED, TOLD)  # patterns that count once a text
NEGATION_REACH = 3  # words after a negation that it denies

TOXIC, CLEAN = 1200, 3600  # labelled texts learned from
STEMS = (4, 5, 6, 7, 8)  # lengths of stems; a whole word ends in "$"
FEWEST = 3  # a stem is learned if so many toxic texts hold it (or repeat it)
SIBLINGS = 4  # so many stems give way to the beginning that they share
SINGLE = 0.25  # part of its weight that such a beginning keeps where a text holds it once
ODDS = 30.0  # and so much rather than the clean texts
REPEAT_ODDS = 10.0  # or so much more often, counted in uses and in texts that repeat it
CHANCE = 0.01  # expected number of stems learned by chance, were the uses independent
TOKEN = re.compile(r"\w+|[.!?;\n]+")


@dataclasses.dataclass(frozen=True)
class Transducer:
    """(state, symbol) -> (state, symbol); what has no arc stays as it is. A break leads to state 0."""

    arcs: dict[tuple[int, int], tuple[int, int]]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (0 if symbol == BREAK else state, symbol))


def target_grammar() -> Transducer:
    """An insult after a target is aimed; a target after an insult adds an aim."""
    return Transducer({
        (0, TARGET): (1, TARGET), (0, INSULT): (2, INSULT), (1, INSULT): (1, AIMED), (2, TARGET): (1, AIM),
    })


def threat_grammar() -> Transducer:
    """A target after a threat makes a menace."""
    return Transducer({(0, THREAT): (1, THREAT), (1, TARGET): (0, MENACE), (1, AIM): (0, MENACE)})


def negation_grammar() -> Transducer:
    """What follows a negation within reach is denied. States count the words left."""
    arcs = {}
    for left in range(NEGATION_REACH + 1):
        arcs[left, NEGATION] = (NEGATION_REACH, NEGATION)
        if left:
            for symbol in (OTHER, TARGET, REPORT, AIM):
                arcs[left, symbol] = (left - 1, symbol)
            for symbol in (INSULT, AIMED, THREAT, MENACE):
                arcs[left, symbol] = (left - 1, DENIED)
    return Transducer(arcs)


def report_grammar() -> Transducer:
    """What follows a report verb in its clause is told."""
    arcs = {(0, REPORT): (1, REPORT)}
    arcs |= {(1, symbol): (1, TOLD) for symbol in (INSULT, AIMED, THREAT, MENACE)}
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer that does what the first and then the second does."""
    numbers, arcs, open_states = {(0, 0): 0}, {}, [(0, 0)]
    while open_states:
        state = open_states.pop()
        for symbol in range(12):
            a, middle = first.step(state[0], symbol)
            b, out = second.step(state[1], middle)
            if (a, b) not in numbers:
                numbers[a, b] = len(numbers)
                open_states.append((a, b))
            arcs[numbers[state], symbol] = (numbers[a, b], out)
    return Transducer(arcs)


def grammar() -> Transducer:
    made = target_grammar()
    for part in (threat_grammar(), negation_grammar(), report_grammar()):
        made = compose(made, part)
    return made


def base_lexicon() -> dict[str, tuple[int, float]]:
    """Whole words (ending in "$") with their symbol and weight."""
    lexicon = {}
    for symbol, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)):
        lexicon |= {w + "$": (symbol, SEED_WEIGHT) for w in words}
    return lexicon


class Symbols(dict):
    """Symbol, weight and stem of each word, worked out when a word is first met; starts anew when full."""

    def __init__(self, lexicon: dict[str, tuple[int, float]], full: int = 400_000):
        super().__init__()
        self.lexicon, self.full = lexicon, full
        self.lengths = sorted({len(s) for s in lexicon if not s.endswith("$")}, reverse=True)

    def __missing__(self, word: str) -> tuple[int, float, str]:
        if len(self) >= self.full:
            self.clear()
        stems = [word + "$", *(word[:n] for n in self.lengths if len(word) >= n)]
        held = [(*self.lexicon[s], s) for s in stems if s in self.lexicon]
        if not held and word[0] in ".!?;\n":
            held = [(BREAK, 0.0, "")]
        # what always counts goes before what counts when repeated
        self[word] = found = next((h for h in held if h[0] < REPEATED), held[0] if held else (OTHER, 0.0, ""))
        return found


@dataclasses.dataclass
class Evidence:
    """What the grammar finds in a text: all weights, those of learned stems, hand-written matches by pattern, the matches."""

    total: float = 0.0
    learned: float = 0.0
    patterns: collections.Counter = dataclasses.field(default_factory=collections.Counter)
    matches: list[tuple[str, int, float]] = dataclasses.field(default_factory=list)


@dataclasses.dataclass
class Model:
    lexicon: dict[str, tuple[int, float]]
    slope: float = 2.0
    offset: float = -2.0
    chances: dict[int, float] = dataclasses.field(default_factory=lambda: dict(PRIORS))

    def __post_init__(self) -> None:
        self.grammar, self.words, self.written = grammar(), Symbols(self.lexicon), frozenset(base_lexicon())

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "slope": self.slope, "offset": self.offset, "chances": self.chances}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def evidence(self, text: str) -> Evidence:
        """The matched clauses' weights and the matches: word, rewritten symbol, weight."""
        tokens = TOKEN.findall(text.lower())
        tagged = list(map(self.words.__getitem__, tokens))
        codes = np.fromiter((t[0] for t in tagged), np.int8, len(tagged))
        again = np.flatnonzero(codes >= REPEATED).tolist()
        if again:
            uses = collections.Counter(tagged[i][2] for i in again)
            for i in again:
                kind, weight, stem = tagged[i]
                alone = uses[stem] == 1
                codes[i] = OTHER if alone and kind == REPEATED else INSULT
                tagged[i] = (int(codes[i]), weight * SINGLE if alone else weight, stem)
        hits = np.flatnonzero((codes == INSULT) | (codes == THREAT))
        if not len(hits):
            return Evidence()
        breaks = np.concatenate([[-1], np.flatnonzero(codes == BREAK), [len(codes)]])
        found = Evidence()
        for clause in np.unique(np.searchsorted(breaks, hits)).tolist():
            state, last, written = 0, SEED_WEIGHT, True
            for i in range(breaks[clause - 1] + 1, breaks[clause]):
                state, out = self.grammar.step(state, tagged[i][0])
                if out in FACTORS:
                    if tagged[i][0] in (INSULT, THREAT):
                        last, written = tagged[i][1], tagged[i][2] in self.written
                    found.matches.append((tokens[i], out, last * FACTORS[out]))
                    found.total += last * FACTORS[out]
                    if written:
                        found.patterns[out] += 1
                    else:
                        found.learned += last * FACTORS[out]
        return found

    def weight(self, text: str) -> tuple[float, list[tuple[str, int, float]]]:
        """The sum of the matched clauses' weights, and the matches."""
        found = self.evidence(text)
        return found.total, found.matches

    def score(self, weight: float, patterns: collections.Counter | None = None) -> float:
        """The chance that a text is toxic, from the weight of its learned stems and its hand-written matches."""
        clean = 1 / (1 + math.exp(max(-30.0, min(30.0, self.slope * math.log1p(weight) + self.offset))))
        for pattern, n in (patterns or {}).items():
            clean *= (1 - self.chances[pattern]) ** (1 if pattern in ONCE else n)
        return 1 - clean


def stems(text: str) -> tuple[collections.Counter, int]:
    """How often the text uses each word, with an end mark, and its beginnings; the number of all uses of words."""
    words = collections.Counter(w for w in TOKEN.findall(text.lower()) if len(w) >= STEMS[0] and w[0] not in ".!?;\n")
    uses: collections.Counter = collections.Counter()
    for w, n in words.items():
        uses[w + "$"] += n
        for k in STEMS:
            if len(w) >= k:
                uses[w[:k]] += n
    return uses, words.total()


def odds(toxic: Column | float, clean: Column | float, all_toxic: float, all_clean: float) -> Column | float:
    """Smoothed share of the toxic over that of the clean."""
    return ((toxic + 0.5) / (all_toxic + 1)) / ((clean + 0.5) / (all_clean + 1))


def surprise(toxic: Column, clean: Column, share: float) -> Column:
    """-log of a bound (Chernoff's) on the chance that so large a part of the uses is toxic, ``share`` of all being so."""
    both = toxic + clean
    part = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    return F.when(toxic > both * share, part(toxic, share) + part(clean, 1 - share)).otherwise(0.0)


def pruned(support: dict[str, int], weights: dict[str, float]) -> dict[str, float]:
    """Of stems that begin alike the longest that keeps nine tenths of the texts, then none that a kept one covers."""
    by_start: dict[str, list[str]] = {}
    for t in weights:
        if not t.endswith("$"):
            for n in range(STEMS[0], len(t)):
                by_start.setdefault(t[:n], []).append(t)
    kept = {s: w for s, w in weights.items() if s.endswith("$") or not any(support[t] >= 0.9 * support[s] for t in by_start.get(s, ()))}
    return {s: w for s, w in kept.items() if not any(s[:n] in kept and kept[s[:n]] >= w - 0.01 for n in STEMS if n < len(s))}


def learned(counts: list[tuple[str, int, int, int, int]], toxic: int, clean: int) -> dict[str, tuple[int, float]]:
    """Insult stems with weights, from (stem, toxic texts, clean texts, toxic and clean texts that repeat it)."""
    always, repeated = ({}, {}), ({}, {})
    for stem, a, b, a2, b2 in counts:
        once, twice = odds(a, b, toxic, clean), odds(a2, b2, toxic, clean)
        if a >= FEWEST and once >= ODDS:
            always[0][stem], always[1][stem] = a, min(6.0, math.log(once))
        elif a2 >= FEWEST and twice >= REPEAT_ODDS:
            repeated[0][stem], repeated[1][stem] = a2, min(6.0, math.log(twice))
    twice, once = pruned(*repeated), pruned(*always)
    # where many words with one beginning were learned one by one, the beginning stands for them
    hints = set()
    for start in twice:
        siblings = [s for s in once if s.startswith(start)]
        if len(siblings) >= SIBLINGS:
            hints.add(start)
            for s in siblings:
                del once[s]
    return {s: (HINT if s in hints else REPEATED, w) for s, w in twice.items()} | {s: (INSULT, w) for s, w in once.items()}


def calibrated(weights: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit on log(1 + weight), with a small prior."""
    x, slope, offset = np.log1p(weights), 2.0, -2.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([((p - labels) * x).sum() + 0.05 * (slope - 2), (p - labels).sum() + 0.05 * (offset + 2)])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        slope, offset = np.array([slope, offset]) - np.clip(np.linalg.solve(h, g), -1, 1)
    return max(0.1, float(slope)), float(offset)


def pattern_chances(learned: np.ndarray, patterns: list[collections.Counter], labels: np.ndarray, rounds: int = 50) -> dict[int, float]:
    """The most likely chance of each pattern, the prior counted in, where each match alone may make a text toxic.

    ``learned``: the chances from learned stems. Found by expectation and maximisation: a toxic text's mark is shared
    out among its matches, a clean text speaks against each of its own.
    """
    order = list(PRIORS)
    uses = np.array([[min(p[s], 1) if s in ONCE else p[s] for s in order] for p in patterns], float).reshape(-1, len(order))
    prior = np.array([PRIORS[s] for s in order])
    chances = prior.copy()
    for _ in range(rounds):
        clean = (1 - learned) * np.prod((1 - chances) ** uses, axis=1)
        due = np.where(labels == 1, 1 / np.maximum(1 - clean, 1e-9), 0.0)
        guilty = np.minimum(due[:, None] * chances, 1) * uses
        chances = (PRIOR_TEXTS * prior + guilty.sum(axis=0)) / (PRIOR_TEXTS + uses.sum(axis=0))
    return dict(zip(order, chances.tolist(), strict=True))


def fit(
    df: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """A model from at most ``toxic`` and ``clean`` labelled texts, chosen by a hash of their ids.

    The sample is written once. Stems are counted on the executors; to the driver come the ids of the sample,
    the counts of the stems learned and one weight for each text of the sample.
    """
    marks = labels.where(labels[id_col].isNotNull() & F.col(label_col).isNotNull()).groupBy(labels[id_col].cast("long").alias("key")).agg(F.max(label_col).alias("mark"))
    order = Window.partitionBy("mark").orderBy(F.xxhash64("key"), "key")
    chosen = marks.where("mark IN (0, 1)").withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.when(F.col("mark") == 1, toxic).otherwise(clean)).collect()
    base = base_lexicon()
    marked = {r["key"]: r["mark"] for r in chosen}
    n_toxic = sum(m == 1 for m in marked.values())
    if not n_toxic or n_toxic == len(marked):
        return Model(base)
    spark, path = df.sparkSession, new_work_path(df.sparkSession, "toxicity")
    id_text(df.where(df[id_col].cast("long").isin(list(marked))), id_col, text_col).write.parquet(path + "/sample")
    sample = spark.read.schema("doc_id long, text string").parquet(path + "/sample")

    def stem_rows(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        rows = []
        for i, t in zip(part.column("doc_id").to_pylist(), texts, strict=True):
            uses, words = stems(t)
            rows += [(s, marked[i], n) for s, n in uses.items()] + [("", marked[i], words)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["stem", "mark", "uses"])

    distinct = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")
    each, bad, twice = map_texts(distinct, stem_rows, "stem string, mark long, uses long", chars=1 << 18), F.col("mark"), (F.col("uses") > 1).cast("long")
    each.groupBy("stem").agg(
        F.sum(bad).alias("a"), F.sum(1 - bad).alias("b"), F.sum(bad * twice).alias("a2"), F.sum((1 - bad) * twice).alias("b2"),
        F.sum(bad * F.col("uses")).alias("ua"), F.sum((1 - bad) * F.col("uses")).alias("ub"),
    ).write.parquet(path + "/stems")
    counts = spark.read.parquet(path + "/stems")
    total, all_stems = counts.where("stem = ''").first(), counts.count() - 1  # the texts and words counted
    found = {}
    if total["a"] and total["b"] and total["ua"] and total["ub"]:
        telling = counts.where("stem <> ''").where(F.col("a") >= FEWEST)
        telling = telling.where((odds(F.col("a"), F.col("b"), total["a"], total["b"]) >= ODDS) | (odds(F.col("ua"), F.col("ub"), total["ua"], total["ub"]) >= REPEAT_ODDS))
        telling = telling.where(surprise(F.col("ua"), F.col("ub"), total["ua"] / (total["ua"] + total["ub"])) >= math.log(all_stems / CHANCE))
        found = learned([(r["stem"], r["a"], r["b"], r["a2"], r["b2"]) for r in telling.orderBy("stem").collect()], total["a"], total["b"])
    model = Model(found | base)

    def weigh(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        own = [model.evidence(t) for t in texts]
        counts = pa.array([[e.patterns[s] for s in PRIORS] for e in own], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([e.learned for e in own], pa.float64()), counts], ["doc_id", "weight", "patterns"])

    weighed = map_texts(sample, weigh, "doc_id long, weight double, patterns array<long>")
    weighed = weighed.groupBy("doc_id").agg(F.max(F.struct("weight", "patterns")).alias("e")).select("doc_id", "e.*").collect()
    weighed = sorted(weighed, key=lambda r: r["doc_id"])
    if weighed:
        weights, truth = np.array([r["weight"] for r in weighed]), np.array([marked[r["doc_id"]] for r in weighed], float)
        patterns = [collections.Counter(dict(zip(PRIORS, r["patterns"], strict=True))) for r in weighed]
        # a text that hand-written words make toxic says nothing of the learned stems' absence
        told = (weights > 0) | ~np.array([any(p.values()) for p in patterns])
        model.slope, model.offset = calibrated(weights[told], truth[told])
        model.chances = pattern_chances(np.array([model.score(w) for w in weights]), patterns, truth)
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", matches: bool = True) -> DataFrame:
    """One row per text: doc_id, score, weight and, if asked for, matches (array of word, pattern, weight)."""
    names = {INSULT: "insult", THREAT: "threat", AIMED: "aimed", DENIED: "denied", TOLD: "told", MENACE: "menace", AIM: "aim"}
    match = pa.list_(pa.struct([("word", pa.string()), ("pattern", pa.string()), ("weight", pa.float64())]))

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        found = [model.evidence(t) for t in texts]
        made = [pa.array([model.score(e.learned, e.patterns) for e in found], pa.float64()), pa.array([e.total for e in found], pa.float64())]
        if matches:
            made.append(pa.array([[{"word": w, "pattern": names[s], "weight": x} for w, s, x in e.matches] for e in found], match))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "score", "weight", "matches"][: len(made) + 1])

    columns = "doc_id long, score double, weight double" + ", matches array<struct<word:string,pattern:string,weight:double>>" * matches
    return map_texts(id_text(df, id_col, text_col), per_piece, columns)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return crc32_bucket(id_col, 5) == 0
