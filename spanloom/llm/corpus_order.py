"""The corpus order of a set of byte strings by prefix-free parsing.

A place where the rolling hash of the next eight bytes is a multiple of ``PERIOD`` is a trigger. Strings are cut into
phrases from one trigger to the end of the next, so that neighbouring phrases share the trigger's bytes. Where a phrase
ends follows from its bytes alone, so of two different rests of phrases neither is a prefix of the other, and suffixes
of strings are ordered by two ranks: that of the rest of their first phrase among the suffixes of the dictionary of
distinct phrases, and that of the phrases behind it among the suffixes of the parse. Both suffix arrays are made by
prefix doubling, of bytes and of phrase ranks.
"""

from __future__ import annotations

import numpy as np

GRAM = 8
#: A trigger is expected once in so many places.
PERIOD = 32


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts like the bytes; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(2 * GRAM, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for k in range(GRAM):
        part = padded[k : k + (len(padded) - k) // GRAM * GRAM].view(">u8")
        out[k::GRAM] = part[: len(out[k::GRAM])]
    return out


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the eight bytes from each place on; the high 32 bits, with zeros below."""
    n = len(data) - GRAM + 1
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        part = data[k : k + (len(data) - k) // GRAM * GRAM].view("<u8")
        gram[k::GRAM] = part[: len(gram[k::GRAM])]
    with np.errstate(over="ignore"):
        gram *= np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
    return gram & np.uint64(0xFFFFFFFF00000000)


def ranked(keys: np.ndarray) -> np.ndarray:
    """For each row the number of rows with a smaller key."""
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    sorted_keys = keys[order]
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def refine(rank: np.ndarray, rows: np.ndarray, then: np.ndarray) -> None:
    """Order the given rows, all those of some ranks, further by ``then`` (0 to the number of ranks); ranks stay numbers of smaller rows."""
    keys = rank[rows] * (len(rank) + 1) + then
    order = np.argsort(keys)
    keys = keys[order]
    before = keys // (len(rank) + 1)
    place = np.arange(len(order))
    group, part = np.ones(len(order), bool), np.ones(len(order), bool)
    group[1:] = before[1:] != before[:-1]
    part[1:] = keys[1:] != keys[:-1]
    rank[rows[order]] = before + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))


def tied(rank: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Those of the rows that share their rank with another."""
    return rows[np.bincount(rank[rows], minlength=len(rank))[rank[rows]] > 1]


def doubled(rank: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """Ranks of suffixes from ranks of their first ``step`` items; ``left`` is the number of items of each suffix."""
    rows = tied(rank, np.arange(len(rank)))
    while len(rows := rows[left[rows] >= step]):
        # a shorter one of the same rank is equal to all of that rank, to its end
        behind = np.zeros(len(rows), np.int64)
        more = left[rows] > step
        behind[more] = rank[rows[more] + step] + 1
        refine(rank, rows, behind)
        step *= 2
        rows = tied(rank, rows)
    return rank


def suffix_ranks(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The rank of every suffix of the phrases joined in ``data``; ``left`` is the number of bytes to the phrase's end."""
    head = words(data)
    short = np.minimum(left, GRAM)
    part = np.flatnonzero(short < GRAM)
    head[part] &= ~(~np.uint64(0) >> (np.uint64(8) * short[part].astype(np.uint64)))
    rank = ranked(head)
    # zeros of the text against zeros behind its end
    rows = tied(rank, np.arange(len(rank)))
    refine(rank, rows, short[rows])
    return doubled(rank, left, GRAM)


def repeated_windows(strings: list[bytes], more: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of ``length`` bytes that start at 0 to ``more`` of each string, in order, occur twice or more."""
    whole = b"".join(strings)
    data = np.frombuffer(whole, np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    begins = ends - [len(s) for s in strings]
    if len(data) < length:
        return np.zeros(0, bool)
    # phrases: from each begin or trigger to the end of the next trigger, or of the string
    hit = np.flatnonzero((rolling(data) >> np.uint64(32)) % np.uint64(PERIOD) == 0)
    hit = hit[hit + GRAM <= ends[np.searchsorted(ends, hit, side="right")]]
    at = np.union1d(begins, hit)
    string = np.searchsorted(ends, at, side="right")
    inner = np.append(string[1:] == string[:-1], False)
    to = np.where(inner, np.append(at[1:], 0) + GRAM, ends[string])
    number: dict[bytes, int] = {}
    phrase = np.fromiter((number.setdefault(whole[a:b], len(number)) for a, b in zip(at.tolist(), to.tolist(), strict=True)), np.int64, len(at))
    # the dictionary's suffix array, as ranks
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    starts = np.cumsum(sizes) - sizes
    dictionary = np.frombuffer(b"".join(number), np.uint8)
    of_suffix = suffix_ranks(dictionary, np.repeat(starts + sizes, sizes) - np.arange(len(dictionary)))
    # the parse's suffix array, as ranks
    final = np.searchsorted(string, np.arange(len(strings)), side="right")
    of_parse = doubled(ranked(of_suffix[starts[phrase]]), final[string] - np.arange(len(at)), 1)
    # windows in corpus order: the rest of the phrase that each starts in, then the phrases behind
    count = more + 1
    window = np.repeat(begins - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    first = np.searchsorted(at, window, side="right") - 1
    behind = np.where(inner[first], np.append(of_parse, 0)[first + 1] + 1, 0)
    order = np.argsort(of_suffix[starts[phrase[first]] + window - at[first]] * (len(at) + 1) + behind)
    # neighbours with a common prefix of ``length`` bytes
    near = np.arange(len(order) - 1)
    head = words(data)
    for k in [length - GRAM, *range(0, length - GRAM, GRAM)]:
        near = near[head[window[order[near]] + k] == head[window[order[near + 1]] + k]]
    again = np.zeros(len(order), bool)
    again[order[near]] = True
    again[order[near + 1]] = True
    return again
