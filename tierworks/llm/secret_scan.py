"""Secret scans: base patterns, and a character convolutional network over every other candidate.

A candidate is a run of eight or more key characters with a digit among them, seen with the characters
before and after it. The network (numpy) is trained on labelled findings: all candidates of the corpus that
a base pattern found, all others that are plainly no keys (ambiguous ones are left out), and a fixed set made from a seed for kinds of values the corpus may
lack. Tasks train on their own findings and the networks are averaged, round by round. Scores are calibrated on one of four findings, held
out, and the threshold is the highest that keeps the wanted recall of all of these. Base findings always stay; the network adds spans.

Cases: a null or empty text has no spans; rows with the same id or text stay separate; without findings to
learn from the fixed set alone trains the network; an empty table gives an empty result; only the id and
text columns are read. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierworks.llm.batches import change_texts, id_text, map_texts
from tierworks.session import cut_lineage, new_work_path

KINDS = ("assign", "access", "hex", "learned")
# The base patterns; a match is kept if the group given is at least so long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY = "A-Za-z0-9+/_.=-"
CANDIDATE = re.compile(rf"(?<![{KEY}])(?=[A-Za-z+/_.=-]*[0-9])[{KEY}]{{8,}}")
# Candidates that are plainly no keys: numbers, dates, versions, and paths or names of plain words and short numbers.
PART = r"(?:[A-Za-z]?[a-z]{1,14}[0-9]{0,4}|[0-9]{1,8})"
PLAIN = re.compile(rf"[+]?[0-9][0-9./=_+-]*|v?[0-9]+(?:[.][0-9]+)+(?:[-+][a-z]+[.]?[0-9]*)?|[/.=_+-]*{PART}(?:[/.=_+-]+{PART})*[/.=_+-]*")
LEAD = re.compile(r"(?:pwd|pass\w*|auth\w*|bearer|\w*key|secret|token|credential\w*)\W*$", re.IGNORECASE)
REPLACEMENT = "[REDACTED]"

BEFORE, VALUE, AFTER = 24, 40, 8  # characters the network sees of a candidate and around it
LENGTH = BEFORE + VALUE + AFTER
STEP = 10  # characters from one window of a long candidate to the next
WIDTH, EMBEDDING, FILTERS = 5, 8, 16
EXAMPLES = 4000  # findings one network is trained on before it is averaged with the others
RECALL = 0.99
EPOCHS = 12
ROUNDS = 4  # times that the networks are averaged
BIN = 1000  # steps of one in which logits are counted
SEED = 7

Span = tuple[int, int, int]  # kind, start, end


def base_findings(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the base patterns, by start and kind."""
    found = []
    if ":" in text or "=" in text:  # every assignment has one
        found += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Every run of key characters, and of a longer one than the network sees the overlapping windows after its beginning."""
    spans = [m.span() for m in CANDIDATE.finditer(text)]
    return [(a, b) for start, end in spans for a, b in [(start, end), *((w, min(w + VALUE, end)) for w in range(start + STEP, end - VALUE + STEP, STEP))]]


def context(text: str, start: int, end: int) -> str:
    """The candidate's first characters with their surroundings, LENGTH characters."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    value = text[start : min(end, start + VALUE)].ljust(VALUE, "\0")
    return before + value + text[end : end + AFTER].ljust(AFTER, "\0")


def plain(seen: str) -> bool:
    """Whether the candidate of a context, all of which is seen, is plainly no key."""
    value = seen[BEFORE : BEFORE + VALUE].rstrip("\0")
    return PLAIN.fullmatch(value) is not None and LEAD.search(seen[:BEFORE].lstrip("\0")) is None


def symbols(contexts: list[str]) -> np.ndarray:
    """One row each: 0 for padding, 1 for anything outside ASCII, else a number of its own."""
    points = np.frombuffer("".join(contexts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(contexts), LENGTH)
    return np.where(points == 0, 0, np.where(points < 128, points + 1, 1)).astype(np.int64)


@dataclasses.dataclass
class Network:
    """Embedding, one convolution, maxima over the parts before, within and after the value, one output."""

    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float = 1.0  # calibration: probability = 1 / (1 + exp(-(slope * logit + shift)))
    shift: float = 0.0
    threshold: float = 0.5

    PARTS = ((0, BEFORE - WIDTH + 1), (BEFORE - 2, BEFORE + VALUE - WIDTH + 1), (BEFORE + VALUE - 2, LENGTH - WIDTH + 1))

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        seen = self.embedding[rows]
        windows = np.concatenate([seen[:, i : LENGTH - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)
        active = np.maximum(windows @ self.kernel + self.bias, 0)
        best = [a + active[:, a:b].argmax(axis=1) for a, b in self.PARTS]
        pooled = np.concatenate([np.take_along_axis(active, at[:, None], 1)[:, 0] for at in best], axis=1)
        return pooled @ self.weights + self.offset, pooled, best, windows

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(rows[i : i + 512])[0] for i in range(0, len(rows), 512)] or [np.zeros(0)])

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(rows) + self.shift, -50, 50)))

    @classmethod
    def start(cls, rng: np.random.Generator) -> Network:
        return cls(
            rng.normal(0, 0.3, (129 + 1, EMBEDDING)), rng.normal(0, 0.2, (WIDTH * EMBEDDING, FILTERS)), np.zeros(FILTERS),
            rng.normal(0, 0.2, 3 * FILTERS), 0.0,
        )

    def vector(self) -> np.ndarray:
        """What is trained, in one row."""
        return np.concatenate([self.embedding.ravel(), self.kernel.ravel(), self.bias, self.weights, [self.offset]])

    @classmethod
    def of(cls, vector: np.ndarray) -> Network:
        table, kernel, bias, weights, offset = np.split(vector, np.cumsum([130 * EMBEDDING, WIDTH * EMBEDDING * FILTERS, FILTERS, 3 * FILTERS]))
        return cls(table.reshape(130, EMBEDDING), kernel.reshape(WIDTH * EMBEDDING, FILTERS), bias, weights, float(offset[0]))

    def learn(self, rows: np.ndarray, y: np.ndarray, share: float, epochs: int, rng: np.random.Generator, rate: float = 0.01) -> None:
        """Some epochs over the findings; ``share`` of all findings are secrets, and both labels count alike."""
        own, state, t = np.arange(len(y)), {}, 0
        share = float(np.clip(share, 0.05, 0.95))
        for _ in range(epochs):
            rng.shuffle(own)
            for a in range(0, len(own), 128):
                batch, t = own[a : a + 128], t + 1
                self.step(rows[batch], y[batch], np.where(y[batch] == 1, 0.5 / share, 0.5 / (1 - share)), state, t, rate)

    def calibrate(self, logit: np.ndarray, truth: np.ndarray, times: np.ndarray, recall: float) -> None:
        """Slope, shift and threshold from held-out logits, each of which occurs some ``times``."""
        slope, shift = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic fit with a small prior
            p = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -50, 50)))
            g = np.array([(times * (p - truth) * logit).sum() + 0.1 * (slope - 1), (times * (p - truth)).sum() + 0.1 * shift])
            w = times * p * (1 - p)
            h = np.array([[(w * logit * logit).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.1]])
            slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(h, g), -1, 1)
        self.slope, self.shift = float(slope), float(shift)
        secret = truth == 1
        p = 1 / (1 + np.exp(-np.clip(self.slope * logit[secret] + self.shift, -50, 50)))
        order = np.argsort(p, kind="stable")
        upto = np.cumsum(times[secret][order])
        self.threshold = float(p[order][np.searchsorted(upto, int((1 - recall) * upto[-1]), side="right")]) if len(upto) else 0.5

    def step(self, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, state: dict[str, tuple[np.ndarray, np.ndarray]], t: int, rate: float = 0.01) -> None:
        """One Adam step on a batch."""
        logit, pooled, best, windows = self.forward(rows)
        error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels) * weight / len(rows)
        back = np.outer(error, self.weights) * (pooled > 0)
        kernel, bias, table = np.zeros_like(self.kernel), np.zeros_like(self.bias), np.zeros_like(self.embedding)
        n = np.arange(len(rows))[:, None]
        for p, at in enumerate(best):
            g = back[:, p * FILTERS : (p + 1) * FILTERS]
            bias += g.sum(axis=0)
            kernel += np.einsum("nf,nfw->wf", g, windows[n, at])
            into = (g[:, :, None] * self.kernel.T[None]).reshape(len(rows), FILTERS, WIDTH, EMBEDDING)
            for i in range(WIDTH):
                np.add.at(table, rows[n, at + i], into[:, :, i])
        gradients = {"embedding": table, "kernel": kernel, "bias": bias, "weights": pooled.T @ error + 1e-4 * self.weights, "offset": error.sum()}
        for name, g in gradients.items():
            m, v = state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = (m, v)
            setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))


def fixed_findings(n: int = 400) -> tuple[list[str], list[int]]:
    """Labelled contexts made from a seed: keys of common forms, and values that only look like keys."""
    rng = np.random.default_rng(SEED)

    def pick(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(alphabet), rng.integers(low, high + 1)))

    word = lambda: pick(string.ascii_lowercase, 2, 9)
    letters_digits, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    secret = [
        lambda: ("token = ", pick(hexes, 20, 40)), lambda: ("password=", pick(hexes, 10, 20)),
        lambda: ("key: ", "sk_live_" + pick(letters_digits, 20, 28)), lambda: ("", "ghp_" + pick(letters_digits, 36, 36)),
        lambda: ("", "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16)), lambda: ("secret=", pick(letters_digits + "+/", 24, 40)),
        lambda: ("pwd: ", pick(letters_digits, 10, 16)), lambda: ("Bearer ", "eyJ" + pick(letters_digits + "_-", 30, 40)),
        lambda: ("auth=", pick(hexes, 32, 40)),
    ]
    plain = [
        lambda: (word() + "@", f"mail{rng.integers(10)}.example.com"), lambda: ("", f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"),
        lambda: ("", pick(string.digits, 8, 16)), lambda: ("version ", f"{rng.integers(30)}.{rng.integers(30)}.{rng.integers(3000)}"),
        lambda: ("https:", f"//{word()}.org/{word()}/{word()}{rng.integers(99)}"), lambda: ("", f"{word()}_{word()}_{rng.integers(10, 99)}"),
        lambda: ("", f"{word()}-{word()}-{rng.integers(2030)}"), lambda: ("+", pick(string.digits, 9, 12)), lambda: ("", f"{word()}/{word()}{rng.integers(9)}.txt"),
    ]
    contexts, labels = [], []
    for label, makers in ((1, secret), (0, plain)):
        for i in range(n):
            lead, value = makers[i % len(makers)]()
            text = f"{word()} {word()} {word()} {lead}"
            contexts.append(context(text + value + f" {word()} {word()}", len(text), len(text) + len(value)))
            labels.append(label)
    return contexts, labels


def train(contexts: list[str], labels: list[int], recall: float = RECALL) -> Network:
    """A network on three of four findings, calibrated and given its threshold on the fourth."""
    rng = np.random.default_rng(SEED)
    rows, y = symbols(contexts), np.array(labels, float)
    held = rng.random(len(y)) < 0.25
    net, own = Network.start(rng), ~held
    net.learn(rows[own], y[own], y[own].mean(), EPOCHS, rng)
    net.calibrate(net.logits(rows[held]), y[held], np.ones(held.sum()), recall)
    return net


FOUND = "doc_id long, base array<struct<kind:int,start:int,end:int>>, candidates array<struct<start:int,end:int,context:string,labelled:int,plain:boolean>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, base spans, candidates with their context and whether a base span meets them."""

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        base, rest = [], []
        for text in texts:
            found = base_findings(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in found])
            rest.append([
                {"start": a, "end": b, "context": context(text, a, b), "labelled": int(any(x < b and a < y for _, x, y, _ in found)), "plain": plain(context(text, a, b))}
                for a, b in candidates(text)
            ])
        base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        rest_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("context", pa.string()), ("labelled", pa.int32()), ("plain", pa.bool_())]))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, base_type), pa.array(rest, rest_type)], ["doc_id", "base", "candidates"])

    return map_texts(id_text(df, id_col, text_col), per_piece, FOUND)


def fit(found: DataFrame, examples: int = EXAMPLES, recall: float = RECALL) -> Network:
    """A network from all candidates of either label and the fixed set.

    The candidates are dealt by a hash to parts of about ``examples``. In every round each part goes on
    from the network so far, over its own candidates and the fixed set, and the mean of the parts' networks, each
    counting by its candidates, is the next. One of four candidates is held out; the logits of these are counted in small steps.
    """
    contexts, labels = fixed_findings()
    net, fixed, truth = train(contexts, labels, recall), symbols(contexts), np.array(labels, float)
    rows = found.select("doc_id", F.explode("candidates").alias("c")).where("c.labelled = 1 OR c.plain")
    rows = rows.select("c.context", "c.labelled", F.xxhash64("doc_id", "c.start", "c.context").alias("h"))
    path = new_work_path(found.sparkSession, "training")
    rows.withColumn("held", F.pmod("h", F.lit(4)) == 0).write.parquet(path)
    rows = found.sparkSession.read.parquet(path)
    sizes = {(r["held"], r["labelled"]): r["count"] for r in rows.groupBy("held", "labelled").count().collect()}
    n = sizes.get((False, 0), 0) + sizes.get((False, 1), 0)
    if not n:
        return net
    parts = -(-n // examples)
    share = (sizes.get((False, 1), 0) + parts * truth.sum()) / (n + parts * len(truth))
    own = rows.where("NOT held").withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)))
    own = cut_lineage(own.repartition(int(parts), "part").sortWithinPartitions("part", "h", "context", "labelled"))
    for turn in range(ROUNDS):
        net = _averaged(own, net, fixed, truth, float(share), turn, 3 if parts < ROUNDS else 1)
    kept = np.random.default_rng(SEED).random(len(truth)) < 0.25
    seen = [(net.logits(fixed[kept]), truth[kept], np.ones(kept.sum()))]
    counted = _logits(rows.where("held"), net).groupBy("labelled", "at").agg(F.count(F.lit(1)).alias("n")).orderBy("labelled", "at").collect()
    if counted:
        at, label, times = np.array([(r["at"], r["labelled"], r["n"]) for r in counted], float).T
        seen.append((at / BIN, label, times))
    net.calibrate(*map(np.concatenate, zip(*seen, strict=True)), recall)
    return net


def _averaged(own: DataFrame, net: Network, fixed: np.ndarray, truth: np.ndarray, share: float, turn: int, epochs: int) -> Network:
    """The mean of the networks that the parts make of ``net``; numbers are summed exactly, so their order is of no account."""
    begin, trained = net.vector(), np.random.default_rng(SEED).random(len(truth)) >= 0.25

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        whole = pa.Table.from_batches(got)
        part = whole.column("part").to_numpy()
        for p in np.unique(part):
            mine = whole.filter(pa.array(part == p))
            mixed = Network.of(begin.copy())
            seen = np.concatenate([symbols(mine.column("context").to_pylist()), fixed[trained]])
            y = np.concatenate([mine.column("labelled").to_numpy().astype(float), truth[trained]])
            mixed.learn(seen, y, share, epochs, np.random.default_rng([SEED, turn, int(p)]), 0.01 / (1 + turn))
            yield pa.RecordBatch.from_arrays([pa.array([mine.num_rows], pa.int64()), pa.array([mixed.vector()], pa.list_(pa.float64()))], ["n", "v"])

    made = own.mapInArrow(run, "n long, v array<double>").select("n", F.posexplode("v").alias("i", "x"))
    total = made.groupBy("i").agg(F.sum(F.round(F.col("x") * F.col("n") * 1e9).cast("decimal(30,0)")).alias("x"), F.sum("n").alias("n"))
    return Network.of(np.array([float(r["x"]) / 1e9 / r["n"] for r in total.orderBy("i").collect()]))


def _logits(rows: DataFrame, net: Network) -> DataFrame:
    """The label of every finding and its logit, down to the next step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor(np.clip(net.logits(symbols(batch.column("context").to_pylist())), -50, 50) * BIN).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("labelled"), pa.array(at)], ["labelled", "at"])

    return rows.select("context", "labelled").mapInArrow(run, "labelled int, at long")


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])))


def report(found: DataFrame, net: Network) -> DataFrame:
    """One row per scanned text: doc_id, n_assign, n_access, n_hex, n_learned, base_sha256, spans, scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, rest = batch.column("base").to_pylist(), batch.column("candidates").to_pylist()
            flat = [c["context"] for row in rest for c in row]
            scores = net.probabilities(symbols(flat)).tolist() if flat else []
            counts, digests, lines, per_row, at = ([], [], [], []), [], [], [], 0
            for own, more in zip(base, rest, strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in own]
                mine = scores[at : at + len(more)]
                at += len(more)
                added = [(3, c["start"], c["end"]) for c, p in zip(more, mine, strict=True) if not c["labelled"] and p >= net.threshold]
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in spans + added))
                digests.append(hashlib.sha256(joined(spans).encode()).hexdigest())
                lines.append(joined(spans + added))
                per_row.append(mine)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(lines, pa.string()), pa.array(per_row, pa.list_(pa.float64()))],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_learned", "base_sha256", "spans", "scores"],
            )

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string, scores array<double>")


def secrets(df: DataFrame, examples: int = EXAMPLES, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every text once, fit the network on the findings, and report; the texts are read once only."""
    path = new_work_path(df.sparkSession, "findings")
    scan(df, id_col, text_col).write.parquet(path)
    found = df.sparkSession.read.parquet(path)
    return report(found, fit(found, examples, recall))


def redacted(texts: list[str], net: Network) -> list[str]:
    """The texts with every secret replaced; of an assignment only the value goes."""
    found = [base_findings(t) for t in texts]
    rest = [[(a, b) for a, b in candidates(t) if not any(x < b and a < y for _, x, y, _ in f)] for t, f in zip(texts, found, strict=True)]
    flat = [context(t, a, b) for t, spans in zip(texts, rest, strict=True) for a, b in spans]
    bad = iter((net.probabilities(symbols(flat)) >= net.threshold).tolist() if flat else [])
    out = []
    for text, own, more in zip(texts, found, rest, strict=True):
        spans = sorted([(s, b) for _, _, b, s in own] + [span for span in more if next(bad)])
        parts, at = [], 0
        for a, b in spans:
            if a >= at:
                parts += [text[at:a], REPLACEMENT]
            at = max(at, b)
        out.append("".join([*parts, text[at:]]) if spans else text)
    return out


def redact(df: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets of its texts replaced, all rows and columns kept."""
    return change_texts(df, text_col, lambda texts: redacted(texts, net))
