"""Labellers, features and fits of the learned operators against plain versions of their rules."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from spanloom.llm import toxicity_grammar, weak_quality

TEXTS = ["", " \n ", "One. Two!\nThree? Four", "a|b | c |d|\n| e", "word## wor$$ **** x***** y&&& $%# " * 4, "SHOUT LOUD now\n" * 9, "same line\n" * 30, "été naïve 😀 x1 22 333 4444 " * 15, "a " * 19, "a " * 20, "word " * 49, "word " * 50,
         "This sentence ends.\nThis one too!\n\nAnd a third?\n" * 3, 'He said "go"\nand went\n' * 2, "incomprehensibilities uncharacteristically " * 12, "no symbols here at all, just prose and more of it. " * 8, "x###", "#", "# #\t#\n#"]


def plain_votes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [-1] + [0] * 9
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeat = len({k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)})
    symbols = sum(c in "#*$%&|<>" for c in text)
    ending = sum(w[-1] in "#*$%&|<>" for w in words)
    runs = sum(1 for w in words for m in re.finditer(r"(.)\1*", w) if m[1] in "#*$%&|<>" and len(m[0]) >= 3)
    dup = len(lines) - len(set(lines))
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    ends = sum(x.strip(" \t\r\v\f")[-1] in '.!?"' for x in lines)
    three = lambda bad, good: -1 if bad else 1 if good else 0
    return [three(n < 20, n >= 50), three(symbols / chars > 0.06, symbols / chars < 0.01), three(ending > 0.2 * n, ending < 0.05 * n), three(runs > 0.1 * n, runs == 0), three(dup > 0.3 * len(lines), dup == 0),
            three(repeat > 0.3 * n, repeat < 0.1 * n), three(chars / n > 12 or chars / n < 2.5, 3 < chars / n < 9), three(upper > lower, upper < 0.2 * lower), three(text.count("|") > 0.1 * n, "|" not in text), three(ends < 0.3 * len(lines), ends > 0.7 * len(lines))]


def test_votes():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab AB.\n|#$", k=rng.randrange(1, 200))) for _ in range(300)]
    for t in texts:
        assert weak_quality.votes(t.encode()) == plain_votes(t), t


def plain_features(text):
    size = weak_quality.DIMENSIONS
    out = [0.0] * size
    raw = text.encode()
    shape = lambda b: 97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    words = raw.split()
    for w in words:
        classes = [shape(b) for b in w]
        first = [c for k, c in enumerate(classes) if k == 0 or c != classes[k - 1]][:6]
        out[zlib.crc32(str(min(len(w), 15) // 3).encode() + bytes(first)) % size] += 1
    n = len(words)
    kinds = len(set(words)) / n if n else 0
    symbols = sum(b in b"#*$%&|<>" for b in raw)
    for name in (f"kinds={int(10 * kinds)}", f"size={min(12, n.bit_length())}", f"lines={min(12, raw.count(10).bit_length())}", f"symbols={min(9, int(40 * symbols / max(1, len(raw))))}"):
        out[zlib.crc32(name.encode()) % size] += max(1, n)
    return np.sqrt(np.array(out) / max(1, n))


def test_features():
    for t in TEXTS:
        dense = np.zeros(weak_quality.DIMENSIONS)
        at, value = weak_quality.hashed(t.encode())
        dense[at] = value
        assert np.allclose(dense, plain_features(t)), t


def test_scorer_is_logistic_regression():
    """Steps with momentum over whole vectors give the same weights, and the fit tells the classes apart."""
    rng = np.random.default_rng(3)
    x = (rng.random((40, 30)) < 0.3) * rng.random((40, 30))
    soft = np.clip((x[:, :5].sum(axis=1) > x[:, 5:10].sum(axis=1)) * 0.9 + 0.05, 0, 1)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    got, bias = weak_quality.fit_scorer(rows, soft, rounds=60)
    share = min(max(soft.mean(), 0.02), 0.98)
    w, b, speed = np.zeros(30), 0.0, np.zeros(30)
    for _ in range(60):
        slope, lean = np.zeros(30), 0.0
        for r, s in zip(x, soft, strict=True):
            p = 1 / (1 + math.exp(-(float(r @ w) + b)))
            d = (s / (2 * share) + (1 - s) / (2 * (1 - share))) * (p - s) / len(x)
            slope += d * r
            lean += d
        speed = 0.9 * speed - (slope + 1e-4 * w)
        w, b = w + speed, b - lean
    assert np.allclose(got[:30], w) and not got[30:].any() and abs(bias - b) < 1e-9
    longer, bias = weak_quality.fit_scorer(rows, soft)
    assert (((x @ longer[:30] + bias) > 0) == (soft > 0.5)).mean() > 0.9


def test_toxicity_weights():
    """The fit by scalar steps: drawn to the weights of before, direct offences never below 0."""
    rng = np.random.default_rng(5)
    start = toxicity_grammar.DEFAULT
    counts = rng.integers(0, 4, (30, len(start.weights)))
    marks = (counts[:, 0] + rng.integers(0, 2, 30) > 2).astype(float)
    got, bias = toxicity_grammar.fit(counts, marks, rounds=50)
    w, b = list(start.weights), start.bias
    x = [[math.log1p(c) for c in row] for row in counts.tolist()]
    for _ in range(50):
        p = [1 / (1 + math.exp(-min(30, max(-30, sum(a * v for a, v in zip(row, w, strict=True)) + b)))) for row in x]
        slope = [sum(row[k] * (q - m) for row, q, m in zip(x, p, marks, strict=True)) / 30 + 0.02 * (w[k] - start.weights[k]) / math.sqrt(30) for k in range(len(w))]
        w = [v - 0.5 * g for v, g in zip(w, slope, strict=True)]
        w = [max(v, 0) if k < toxicity_grammar.DIRECT else v for k, v in enumerate(w)]
        b -= 0.5 * sum(q - m for q, m in zip(p, marks, strict=True)) / 30
    assert np.allclose(got, w) and abs(bias - b) < 1e-9 and min(got[: toxicity_grammar.DIRECT]) >= 0


def test_learned_words(spark):
    """A word is learned where it stands in several toxic documents and is at least twelve times as frequent there; at sixty times it is an insult."""
    least = toxicity_grammar.MIN_DOCS
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)][:1200]
    toxic, clean = ids[:200], ids[200:]
    held = {"qqalways": (200, 0), "qqoften": (40, 12), "qqrare": (least - 1, 0), "qqjust": (least, 0), "qqboth": (100, 500)}
    texts = {i: ["filler"] for i in ids}
    for word, (a, b) in held.items():
        for i in toxic[:a] + clean[:b]:
            texts[i].append(word)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in set(toxic))) for i in ids], "doc_id long, toxic int")
    grammar = toxicity_grammar.learn(docs, labels)
    ratio = lambda a, b: ((a + 0.2) / (len(toxic) + 1)) / ((b + 0.2) / (len(clean) + 1))
    for word, (a, b) in held.items():
        want = None if a < least or ratio(a, b) < 12 else toxicity_grammar.INSULT if ratio(a, b) >= 60 else toxicity_grammar.WEAK
        assert grammar.words.get(word) == want, (word, ratio(a, b))
