"""A quality classifier from weak labels.

Heuristic labellers vote for good, bad or nothing on each document. Expectation-maximisation over the counts of vote
patterns estimates how often each labeller is right and how common good documents are; no true label is read. The
posterior of a document's pattern is the soft label that trains a linear scorer over hashed features (shapes of words,
and classes of size, lines, symbols and repetition), which then scores every document.

There are at most three to the number of labellers patterns, so their counts fit the driver. Each text is read once: its
pattern and features are written to the shared folder. The scorer is fitted on about ``max_rows`` documents, chosen by a
hash of the features, so that copies are chosen together and teach once.

Defined cases: null and empty texts get a vote against them, as texts with few words do, and are scored like any other
text. Repeated rows are each scored. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .batches import bytes_of, map_slices
from .quality_rules import SYMBOLS, base_counts

DIMENSIONS = 1 << 14
#: Longer words are looked at anew each time, so that remembered words stay small.
CACHED_BYTES = 64
LABELLERS = ("length", "symbols", "symbol_words", "symbol_runs", "repeated_lines", "repeated_words", "word_length", "capitals", "bars", "sentences")
#: Symbols that end a word, and runs of three or more of one symbol.
SYMBOL_END, SYMBOL_RUN = re.compile(rb"[#*$%&|<>](?=[\x20\x09-\x0d]|$)"), re.compile(rb"([#*$%&|<>])\1\1+")


def votes(text: bytes) -> list[int]:
    """1 good, -1 bad, 0 no opinion, by labeller."""
    n_words, chars, n_symbols, n_dup, n_repeat = base_counts(text)
    if not n_words:
        return [-1] + [0] * (len(LABELLERS) - 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = len(re.findall(rb"[A-Z]", text))
    lower = len(re.findall(rb"[a-z]", text))
    ends = sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines)
    share, mean = n_symbols / chars, chars / n_words
    ending, runs = (len(SYMBOL_END.findall(text)), len(SYMBOL_RUN.findall(text))) if n_symbols else (0, 0)
    return [
        -1 if n_words < 20 else int(n_words >= 50),
        -1 if share > 0.06 else int(share < 0.01),
        -1 if ending > 0.2 * n_words else int(ending < 0.05 * n_words),
        -1 if runs > 0.1 * n_words else int(runs == 0),
        -1 if n_dup > 0.3 * len(lines) else int(n_dup == 0),
        -1 if n_repeat > 0.3 * n_words else int(n_repeat < 0.1 * n_words),
        -1 if mean > 12 or mean < 2.5 else int(3 < mean < 9),
        -1 if upper > lower else int(upper < 0.2 * lower),
        -1 if text.count(b"|") > 0.1 * n_words else int(b"|" not in text),
        -1 if ends < 0.3 * len(lines) else int(ends > 0.7 * len(lines)),
    ]


@dataclass(frozen=True)
class LabelModel:
    """The share of good documents, and by labeller how likely each vote (-1, 0, 1) is for bad and for good documents."""

    prior: float
    chance: np.ndarray  # labeller x class x vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """How likely each pattern's document is good."""
        each = np.log(self.chance[np.arange(patterns.shape[1])[None, :], :, patterns + 1]).sum(axis=1)
        odds = each[:, 1] - each[:, 0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation, begun with documents that no labeller votes against as likely good. The smoothing keeps every vote possible.

    A labeller must not vote against good documents more often than against bad ones: where the counts say so, both
    classes get its common rate of such votes.
    """
    good = np.where(patterns.min(axis=1) < 0, 0.2, 0.9)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts], axis=1)
        chance = np.stack([[[weight[patterns[:, k] == v, c].sum() + 0.5 for v in (-1, 0, 1)] for c in (0, 1)] for k in range(patterns.shape[1])])
        common = chance[:, :, 0].sum(axis=1) / chance.sum(axis=(1, 2))
        chance /= chance.sum(axis=2, keepdims=True)
        for k in np.flatnonzero(chance[:, 1, 0] > chance[:, 0, 0]):
            chance[k, :, 1:] *= ((1 - common[k]) / (1 - chance[k, :, 0]))[:, None]
            chance[k, :, 0] = common[k]
        model = LabelModel(float(np.clip((good * counts).sum() / counts.sum(), 0.02, 0.98)), chance)
        now = model.posterior(patterns)
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return model


#: Small letters and bytes of other scripts become a, capitals A, digits 0; the rest stays.
CLASSES = bytes(ord("a") if 97 <= k <= 122 or k >= 128 else ord("A") if 65 <= k <= 90 else ord("0") if 48 <= k <= 57 else k for k in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)


def place(classes: bytes) -> int:
    """The feature of a word given by the classes of its bytes: its length class and its first shapes."""
    return zlib.crc32(b"%d%s" % (min(len(classes), 15) // 3, RUNS.sub(rb"\1", classes)[:6])) % DIMENSIONS


known_place = lru_cache(1 << 16)(place)


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values (root of the share) of a text's features."""
    often = Counter(text.translate(CLASSES).split())
    seen = often.total()
    counts = np.bincount(np.array([known_place(w) if len(w) <= CACHED_BYTES else place(w) for w in often], np.int64), np.fromiter(often.values(), float, len(often)), DIMENSIONS)
    kinds = len(set(text.split())) / seen if seen else 0
    for name, value in (("kinds", int(10 * kinds)), ("size", min(12, seen.bit_length())), ("lines", min(12, text.count(b"\n").bit_length())), ("symbols", min(9, int(40 * sum(text.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS))) / max(1, len(text)))))):
        counts[zlib.crc32(f"{name}={value}".encode()) % DIMENSIONS] += max(1, seen)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / max(1, seen))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, rounds: int = 300, rate: float = 1.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes with the same weight, by steps of falling size."""
    of = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    share = np.clip(soft.mean(), 0.02, 0.98)
    weight = soft / (2 * share) + (1 - soft) / (2 * (1 - share))
    w, b = np.zeros(DIMENSIONS), 0.0
    speed = np.zeros(DIMENSIONS)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, value * w[at], len(rows)) + b, -30, 30)))
        d = weight * (p - soft) / len(rows)
        g = np.bincount(at, d[of] * value, DIMENSIONS) + ridge * w
        speed = 0.9 * speed - rate * g
        w += speed
        b -= rate * d.sum()
    return w, b


def packed(text: bytes) -> tuple[bytes, bytes]:
    """``hashed`` as bytes: places of two bytes, values of four."""
    at, value = hashed(text)
    return at.astype("<u2").tobytes(), value.astype("<f4").tobytes()


def unpacked(at: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(value, "<f4").astype(float)


def with_votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pattern, and the packed features (at, value) of every document, written to the shared folder."""
    arrow = pa.schema([("doc_id", pa.int64()), ("pattern", pa.int32()), ("at", pa.binary()), ("value", pa.binary())])

    def cast(part):
        raw = bytes_of(part, 1)
        features = [packed(t) for t in raw]
        return {"doc_id": part.column(0), "pattern": [code(votes(t)) for t in raw], "at": [a for a, _ in features], "value": [v for _, v in features]}

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return materialize(map_slices(texts, cast, "doc_id long, pattern int, at binary, value binary", arrow, 1), "votes")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 10_000) -> DataFrame:
    """One row per document: doc_id, ``posterior`` of its votes, ``score``, ``predicted`` (1 good) and ``kept``."""
    voted = with_votes(docs, id_col, text_col)
    table = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    if not table:
        return docs.sparkSession.createDataFrame([], "doc_id long, posterior double, score double, predicted int, kept boolean")
    patterns, counts = np.array([decode(r["pattern"]) for r in table]), np.array([r["n"] for r in table], float)
    model = fit_labels(patterns, counts)
    share = min(1.0, max_rows / counts.sum())
    sampled = voted.where(F.pmod(F.xxhash64("at", "value"), F.lit(1 << 53)).cast("double") < share * (1 << 53))
    # equal texts would outweigh others, so each set of votes and features teaches once
    got = sampled.select("pattern", "at", "value").distinct().collect()
    if got:
        w, b = fit_scorer([unpacked(r["at"], r["value"]) for r in got], model.posterior(np.array([decode(r["pattern"]) for r in got])))
    else:
        w, b = np.zeros(DIMENSIONS), 0.0
    posterior = {r["pattern"]: p for r, p in zip(table, model.posterior(patterns).tolist(), strict=True)}
    out = pa.schema([("doc_id", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("predicted", pa.int32()), ("kept", pa.bool_())])

    def judge(part):
        x = np.array([w[a] @ v for a, v in map(unpacked, part.column(2).to_pylist(), part.column(3).to_pylist())]) + b
        values = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return {"doc_id": part.column(0), "posterior": [posterior[k] for k in part.column(1).to_pylist()], "score": values, "predicted": (values >= 0.5).astype(np.int32), "kept": values >= 0.5}

    return map_slices(voted, judge, "doc_id long, posterior double, score double, predicted int, kept boolean", out, 3)


def code(pattern: list[int]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(pattern))


def decode(number: int) -> list[int]:
    return [number // 3**k % 3 - 1 for k in range(len(LABELLERS))]
