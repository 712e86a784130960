"""Small tables with the odd cases, and brute-force versions of the operators."""

import collections
import hashlib
import random
import re

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, anchor string, n int"
LONG = "so long a text " * 20_000

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "!!! ... ###"), (5, "one"), (5, "one"), (6, "Two words"), (7, LONG), (None, "a text without an id"), (None, None),
    (8, "it's <|endoftext|> 've we'll　 x\r\n\x00 é ß 漢字 \U0001f600"), (9, "a" * 3000), (10, "SAME text here and there"), (11, "same TEXT here and there"),
]


def odd_table(spark, rows=ODD, lang="en"):
    """The rows with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", "x", 1) for i, t in rows], SCHEMA)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, bits):
    """Smallest number reachable, for each of the prints, over pairs at most ``bits`` apart."""
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def repeats(docs, length=200):
    """(id, bytes, removed, spans, digest of the rest) of each text, by counting every window."""
    seen = collections.Counter()
    for _, text in docs:
        raw = (text or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(raw, gone, strict=True) if not y)
        out.append((key, len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def word_distance(item, text):
    """Edit distance of the item to the nearest part of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def base_spans(text):
    """The base patterns of the secret scan, straight from their description."""
    found = []
    for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def best_products(ids, vectors, queries, k):
    """(query, rank, id, score) rows; vectors are lists of whole numbers."""
    out = []
    for q in queries:
        v = vectors[ids.index(q)]
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in zip(ids, vectors, strict=True) if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "er", "th", "ion", "st", "le", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values = np.array(scores)[order]
    for v in np.unique(values):
        at = np.flatnonzero(values == v)
        ranks[order[at]] = at.mean() + 1
    y = np.array(labels)
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
