"""License scans by ordered signature rules.

Every rule is a regular expression over the lower-cased text with a label, a priority, a confidence and the
keywords without which it isn't tried: every match of its pattern holds one of each. A blank in a name or a
notice stands for any white space and comment marks, so wrapped lines are seen. Findings are taken by priority; one that lies within a
finding already taken is suppressed. Gaps of any length and texts of any number of findings take time in proportion. The base phrases are looked up on words and always stay.

Cases: a null or empty text has no words and no labels; rows with the same id or text stay separate; an empty
table gives an empty result; only the id and text columns are read. Only A-Z are lower-cased; first_word and
last_word are null without a base phrase.
"""

from __future__ import annotations

import bisect
import dataclasses
import functools
import itertools
import re
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierworks.llm.batches import id_text, map_texts

# The base phrases and their labels.
BASE = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# Hand-written signatures: label, how the license is named in prose, its short identifier, its address.
# An empty pattern leaves the rules of that form out.
FAMILIES = [
    ("gpl-3.0", r"gnu (?:general public license|gpl),?\s*(?:\(gpl\),?\s*)?(?:version|v\.?)\s*3(?:\.0)?", r"gpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0", r"gnu (?:general public license|gpl),?\s*(?:\(gpl\),?\s*)?(?:version|v\.?)\s*2(?:\.0)?", r"gpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-1.0", r"gnu (?:general public license|gpl),?\s*(?:version|v\.?)\s*1(?:\.0)?", r"gpl-?v?1(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/old-licenses/gpl-1\.0"),
    ("lgpl-3.0", r"gnu lesser general public license,?\s*(?:version|v\.?)\s*3(?:\.0)?", r"lgpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", r"gnu lesser general public license,?\s*(?:version|v\.?)\s*2\.1", r"lgpl-?v?2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", r"gnu library general public license", r"lgpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("agpl-3.0", r"gnu affero general public license,?\s*(?:version|v\.?)\s*3(?:\.0)?", r"agpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.3", r"gnu free documentation license,?\s*(?:version|v\.?)\s*1\.3", r"gfdl-1\.3(?:-only|-or-later)?", r"gnu\.org/licenses/fdl-1\.3"),
    ("gfdl-1.2", r"gnu free documentation license,?\s*(?:version|v\.?)\s*1\.2", r"gfdl-1\.2(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    ("gpl", r"gnu general public licen[sc]e", r"gpl", r"gnu\.org/licenses/gpl"),
    ("lgpl", r"gnu lesser general public licen[sc]e", r"lgpl", r"gnu\.org/licenses/lgpl"),
    ("agpl", r"gnu affero general public licen[sc]e", r"agpl", r"gnu\.org/licenses/agpl"),
    ("apache-2.0", r"apache (?:software )?license,?\s*(?:version|v\.?)?\s*2(?:\.0)?", r"apache-?2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", r"apache (?:software )?license,?\s*(?:version|v\.?)?\s*1\.1", r"apache-?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-1.0", r"apache (?:software )?license,?\s*(?:version|v\.?)?\s*1\.0", r"apache-?1\.0", r"apache\.org/licenses/license-1\.0"),
    ("apache", r"apache (?:software )?license", r"apache", r"apache\.org/licenses"),
    ("mit", r"(?:the )?mit(?:/x11)? licen[sc]e", r"mit", r"opensource\.org/licenses/mit"),
    ("mit-0", r"mit no attribution licen[sc]e", r"mit-0", r"opensource\.org/licenses/mit-0"),
    ("x11", r"x11 licen[sc]e", r"x11", r""),
    ("bsd-2-clause", r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e", r"bsd-2(?:-clause)?", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", r"(?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e", r"bsd-3(?:-clause)?", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", r"(?:original|4-clause|four-clause) bsd licen[sc]e", r"bsd-4(?:-clause)?", r""),
    ("0bsd", r"zero-clause bsd licen[sc]e", r"0bsd", r"opensource\.org/licenses/0bsd"),
    ("bsd", r"bsd(?:-style)? licen[sc]e", r"bsd", r"opensource\.org/licenses/bsd"),
    ("isc", r"isc licen[sc]e", r"isc", r"opensource\.org/licenses/isc"),
    ("mpl-2.0", r"mozilla public licen[sc]e,?\s*(?:version|v\.?)?\s*2(?:\.0)?", r"mpl-?2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", r"mozilla public licen[sc]e,?\s*(?:version|v\.?)?\s*1\.1", r"mpl-?1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl", r"mozilla public licen[sc]e", r"mpl", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl-2.0", r"eclipse public licen[sc]e,?\s*(?:-\s*)?(?:version|v\.?)?\s*2(?:\.0)?", r"epl-?2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", r"eclipse public licen[sc]e,?\s*(?:-\s*)?(?:version|v\.?)?\s*1(?:\.0)?", r"epl-?1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("cddl-1.0", r"common development and distribution licen[sc]e", r"cddl-?1(?:\.[01])?", r"opensource\.org/licenses/cddl-1\.0"),
    ("eupl-1.2", r"european union public licen[sc]e", r"eupl-?1\.[12]", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("artistic-2.0", r"artistic licen[sc]e,?\s*(?:version\s*)?2(?:\.0)?", r"artistic-2\.0", r"opensource\.org/licenses/artistic-2\.0"),
    ("artistic-1.0", r"artistic licen[sc]e", r"artistic-1\.0", r"opensource\.org/licenses/artistic-license"),
    ("bsl-1.0", r"boost software licen[sc]e", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib", r"opensource\.org/licenses/zlib"),
    ("unlicense", r"the unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the .{1,8} you want to public licen[sc]e", r"wtfpl", r"wtfpl\.net"),
    ("cc0-1.0", r"cc0 1\.0(?: universal)?", r"cc0(?:-1\.0)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by-nc-nd-4.0", r"cc by-nc-nd 4\.0", r"cc-by-nc-nd-4\.0", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("cc-by-nc-sa-4.0", r"cc by-nc-sa 4\.0", r"cc-by-nc-sa-4\.0", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-4.0", r"cc by-nc 4\.0", r"cc-by-nc-4\.0", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-sa-4.0", r"cc by-sa 4\.0", r"cc-by-sa-4\.0", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-nd-4.0", r"cc by-nd 4\.0", r"cc-by-nd-4\.0", r"creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-4.0", r"cc by 4\.0|creative commons attribution 4\.0", r"cc-by-4\.0", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-sa-3.0", r"cc by-sa 3\.0|creative commons attribution-?share-?alike 3\.0", r"cc-by-sa-3\.0", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-nc-3.0", r"cc by-nc 3\.0|creative commons attribution-?non-?commercial 3\.0", r"cc-by-nc-3\.0", r"creativecommons\.org/licenses/by-nc/3\.0"),
    ("cc-by-3.0", r"cc by 3\.0|creative commons attribution 3\.0", r"cc-by-3\.0", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-sa-2.0", r"cc by-sa 2\.[05]", r"cc-by-sa-2\.[05]", r"creativecommons\.org/licenses/by-sa/2\.[05]"),
    ("cc-by-2.0", r"cc by 2\.[05]", r"cc-by-2\.[05]", r"creativecommons\.org/licenses/by/2\.[05]"),
    ("cc-by", r"cc by|creative commons attribution", r"cc-by", r"creativecommons\.org/licenses/by"),
    ("odbl-1.0", r"open (?:data commons open )?database licen[sc]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", r"public domain dedication and licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("ofl-1.1", r"sil open font licen[sc]e", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("psf-2.0", r"python software foundation licen[sc]e", r"psf-2\.0|python-2\.0", r"docs\.python\.org/.{0,12}license"),
    ("postgresql", r"postgresql licen[sc]e", r"postgresql", r"opensource\.org/licenses/postgresql"),
    ("ncsa", r"university of illinois/ncsa open source licen[sc]e", r"ncsa", r"opensource\.org/licenses/ncsa"),
    ("ms-pl", r"microsoft public licen[sc]e", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("osl-3.0", r"open software licen[sc]e", r"osl-3\.0", r"opensource\.org/licenses/osl-3\.0"),
    ("afl-3.0", r"academic free licen[sc]e", r"afl-3\.0", r"opensource\.org/licenses/afl-3\.0"),
    ("bsl-1.1", r"business source licen[sc]e", r"busl-1\.1", r"mariadb\.com/bsl"),
    ("sspl-1.0", r"server side public licen[sc]e", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    ("elastic-2.0", r"elastic licen[sc]e", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("openrail", r"(?:creativeml )?open ?rail(?:-[ms]+)?(?: licen[sc]e)?", r"(?:creativeml-)?openrail(?:-m|\+\+)?", r"huggingface\.co/spaces/.{0,30}license"),
]

# Hand-written notices that name no family: label, pattern.
NOTICES = [
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("bsd", r"redistribution and use in source and binary forms"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("public-domain", r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("proprietary", r"all rights reserved"),
    ("proprietary", r"proprietary and confidential"),
    ("copyright", r"copyright (?:\(c\)|©)?\s*(?:19|20)\d\d"),
    ("copyright", r"©\s*(?:19|20)\d\d"),
    ("unspecified", r"licensed under (?:the )?[a-z0-9][^\n.]{1,40}"),
    ("unspecified", r"see (?:the )?license(?: file)? (?:for|in)"),
]


@dataclasses.dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # lower first
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]


# White space, and comment marks at the beginning of a line. Every part takes all it can and gives nothing back, so a
# gap is read once however long it is.
GAP = r"(?:[^\S\n]++|\n[^\S\n]*+(?:(?://++|/?\*++|#++|;++|--|%++|>++|dnl\b|rem\b)[^\S\n]*+)*+)++"


def wrapped(pattern: str) -> str:
    """The pattern, its blanks standing for any gap."""
    return re.sub(r"( |\\s[+*])(\??)", lambda m: f"(?:{GAP})?" if m[2] or m[1] == r"\s*" else GAP, pattern)


def literals(pattern: str) -> str:
    """Words of which every match of the pattern holds one, "|" between; "" if there is no such set."""
    def held(parsed) -> set[str]:
        best, run = set(), ""

        def better(found: set[str]) -> None:
            nonlocal best
            if found and (not best or min(map(len, found)) > min(map(len, best))):
                best = found

        for kind, value in [*parsed, (None, None)]:
            if kind is parser.LITERAL and not chr(value).isspace():
                run += chr(value)
                continue
            if run:
                better({run})
            run = ""
            if kind is parser.SUBPATTERN:
                better(held(value[3]))
            elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
                better(held(value[2]))
            elif kind is parser.BRANCH:
                each = [held(x) for x in value[1]]
                better(set().union(*each) if all(each) else set())
        return best

    return "|".join(sorted(held(parser.parse(pattern))))


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: identifiers, grants, addresses, names, then notices; a family's place decides within a form."""
    made = []
    for place, (label, name, short, address) in enumerate(FAMILIES):
        name = wrapped(name)
        forms = [
            (0, 0.99, rf"spdx-license-identifier:\s*(?:{short})(?![\w.+-])" if short else ""),
            (1, 0.97, wrapped("licen[sc]ed under (?:the )?(?:terms of (?:the )?)?") + f"(?:{name})"),
            (1, 0.95, wrapped("licen[sc]ed under (?:the )?") + rf"(?:{short})(?![\w.+-])" if short else ""),
            (2, 0.95, rf"(?:https?://)?(?:www\.)?{address}" if address else ""),
            (3, 0.9, wrapped("(?:re)?distributed under (?:the )?(?:terms of (?:the )?)?") + f"(?:{name})"),
            (3, 0.9, rf"licen[sc]e\s*[:=]\s*[\"']?(?:{short})(?![\w.+-])" if short else ""),
            (4, 0.8, rf"(?<!\w)(?:{name})(?!\w)"),
        ]
        made += [Rule(label, 1000 * form + place, sure, (literals(p),), re.compile(p)) for form, sure, p in forms if p]
    for place, (label, p) in enumerate(NOTICES):
        made.append(Rule(label, 9000 + place, 0.5, (literals(wrapped(p)),), re.compile(wrapped(p))))
    return tuple(sorted(made, key=lambda r: r.priority))


def lower_ascii(text: str) -> str:
    """A-Z in lower case, all other characters and all positions as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


Finding = tuple[str, int, int, float]  # label, start, end, confidence


def signatures(lowered: str) -> list[Finding]:
    """Findings of the rules that survive, by start. ``lowered``: the text in ASCII lower case."""
    taken: list[Finding] = []
    starts: list[int] = []  # of what is taken, in order
    reach: list[int] = []  # the farthest end of all that start no later
    seen = {}
    for rule in rules():
        for word in rule.keywords:
            if word not in seen:
                seen[word] = not word or any(w in lowered for w in word.split("|"))
        if not all(seen[word] for word in rule.keywords):
            continue
        # matches of one rule never overlap, so only earlier rules can hold one
        spans = [m.span() for m in rule.pattern.finditer(lowered)]
        new = [(rule.label, a, b, rule.confidence) for a, b in spans if not (at := bisect.bisect_right(starts, a)) or reach[at - 1] < b]
        if new:
            taken = sorted([*taken, *new], key=lambda f: f[1])
            starts, reach = [f[1] for f in taken], list(itertools.accumulate((f[2] for f in taken), max))
    return sorted(taken, key=lambda f: (f[1], f[2], f[0]))


def base_places(lowered: bytes) -> list[tuple[str, int]]:
    """(label, number of the first word) of every place of a base phrase."""
    if not ((b"license" in lowered and (b"gnu" in lowered or b"apache" in lowered or b"mit" in lowered)) or (b"cc" in lowered and b"by" in lowered)):
        return []
    words = [w.decode("utf-8", "surrogatepass") for w in WORD.findall(lowered)]
    heads = {p[0]: (p, label) for p, label in BASE.items()}
    places = []
    for i, w in enumerate(words):
        if w in heads:
            phrase, label = heads[w]
            if tuple(words[i : i + len(phrase)]) == phrase:
                places.append((label, i))
    return places


IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def word_count(lowered: bytes) -> int:
    if not lowered:
        return 0
    inside = IN_WORD[np.frombuffer(lowered, np.uint8)]
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, findings array<struct<label:string,start:int,end:int,confidence:double>>"


def licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: words, base places and labels, all labels, score, and the findings with their spans.

    ``score``: 1 - product of (1 - confidence) over the findings and base places, a base place counting 0.9.
    """
    finding = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(finding)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "findings"]

    def row(text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass").lower()
        places, found = base_places(raw), signatures(raw.decode("utf-8", "surrogatepass"))
        base = sorted({label for label, _ in places})
        at = [i for _, i in places]
        doubt = 0.1 ** len(places) * float(np.prod([1 - f[3] for f in found]))
        return (
            word_count(raw), len(places), min(at, default=None), max(at, default=None), ",".join(base),
            ",".join(sorted({*base, *(f[0] for f in found)})), 1 - doubt, [dict(zip(("label", "start", "end", "confidence"), f, strict=True)) for f in found],
        )

    def per_piece(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        columns = zip(*[row(t) for t in texts], strict=True)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", *names])

    return map_texts(id_text(df, id_col, text_col), per_piece, COLUMNS)
