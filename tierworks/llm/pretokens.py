"""Byte-level pre-tokens of many texts at once, by character classes in flat numpy arrays.

The rule is the published one of byte-level BPE vocabularies:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
A pre-token begins where the class changes; one plain space joins what follows it; of a longer run of
white space the last character stands apart; an apostrophe that begins a token takes its ending along.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
SPECIAL = "<|endoftext|>"
SPECIAL_POINT = 0x110000  # stands for SPECIAL among code points

# Code points of the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(SPECIAL_POINT + 1, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def token_starts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Indices at which a pre-token begins. ``begins``: where each text begins in ``codes``."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[first[:n]] = 9
    white = kind == SPACE
    # a change of class, but not from a plain space to what it joins
    start = kind != before
    after_plain = np.zeros(n, bool)
    after_plain[1:] = (codes[:-1] == 32) & ~white[1:] & ~first[1:n]
    start &= ~after_plain
    # the last of a longer run of white space, if a text goes on behind it
    more = np.zeros(n, bool)
    more[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    start |= more
    quote = np.flatnonzero(start & (codes == 39))
    if len(quote):
        padded = np.append(codes, [0, 0]).astype(np.uint32)
        ends = np.append(first, [True, True])
        a, b = padded[quote + 1], padded[quote + 2]
        inside1 = ~ends[quote + 1]
        inside2 = inside1 & ~ends[quote + 2]
        one = inside1 & np.isin(a, [115, 116, 109, 100])
        two = inside2 & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        taken = one | two
        quote, length = quote[taken], np.where(one[taken], 2, 3)
        start[quote + 1] = False
        behind = quote + length
        start[behind[behind < n]] = True
    return np.flatnonzero(start)


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, where each pre-token begins, and how many each text has.

    SPECIAL is one pre-token and stands as the single number SPECIAL_POINT; what is beside it ends or begins there.
    """
    parts, begins, ends, at = [], [], [], 0
    plain = "".join(texts)
    if SPECIAL not in plain:
        codes = code_points(plain)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        begins = (ends - lengths)[lengths > 0]
    else:
        for text in texts:
            for k, segment in enumerate(text.split(SPECIAL)):
                for part in ([np.array([SPECIAL_POINT], np.uint32)] if k else []) + [code_points(segment)]:
                    if len(part):
                        parts.append(part)
                        begins.append(at)
                        at += len(part)
            ends.append(at)
        codes, begins, ends = np.concatenate(parts), np.array(begins, np.int64), np.array(ends, np.int64)
    starts = token_starts(codes, begins)
    return codes, starts, np.diff(np.append(0, np.searchsorted(starts, ends)))
