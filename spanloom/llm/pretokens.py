"""Pre-tokens of byte-level BPE: the matches of the pattern, found for many texts at once from character classes.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its matches cover
the text, so it is enough to find where each begins: where the class (letter, number, space, other) changes, moved
onto a single blank before a run, and where a contraction begins or ends.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point, with the Unicode properties that the pattern names."""
    table = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, everything):
            table[[ord(c) for c in m[0]]] = kind
    return table


def split_batch(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of the texts in order, and how many each text has."""
    joined = "".join(texts)
    if not joined:
        return [], np.zeros(len(texts), np.int64)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    n = len(code)
    kind = class_table()[code]
    first = np.zeros(n + 1, bool)  # first character of a text
    first[0] = True
    first[ends] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # a run of spaces before another run gives its last character away: a blank joins the run, another is alone
    space = kind == SPACE
    follows = np.zeros(n, bool)
    follows[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    blank = code == 32
    last = np.flatnonzero(follows)
    start[last] = True
    start[last[blank[last]] + 1] = False
    # contractions: an apostrophe that begins a match, with the letters behind it
    quote = np.flatnonzero((code[:-1] == 39) & start[:n][:-1]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        limit = ends[np.searchsorted(ends, quote, side="right")]
        # quotes in order: one may begin only because the contraction before it ended there, which the class change also tells
        c1 = np.where(quote + 1 < limit, code[np.minimum(quote + 1, n - 1)], 0)
        c2 = np.where(quote + 2 < limit, code[np.minimum(quote + 2, n - 1)], 0)
        size = np.where(np.isin(c1, [115, 116, 109, 100]), 2, 0)
        size = np.where(((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108), 3, size)
        hit = size > 0
        start[quote[hit] + 1] = False
        after = quote[hit] + size[hit]
        start[after[after < n]] = True
    at = np.flatnonzero(start[:n])
    bounds = [*at.tolist(), n]
    words = [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    upto = np.searchsorted(at, ends, side="left")
    return words, np.diff(upto, prepend=0)
