"""Licences, spelling variants and clusters against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import centroid_search, license_index, queries, spelling_variants

SCHEMA = "doc_id long, text string, lang string, source string, places string, n_words int, block long, letters string"
EXTRA = ("en", "s", "clash", 5, 7, "clash")


def table(spark, texts):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in texts], SCHEMA).repartition(3)


# ---- licences ----

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
LICENSE_TEXTS = [None, "", " \x00\x85", "CC BY", "cc-by cc_by ccby cc\n\nBY", "All rights reserved. ALL RIGHTS RESERVED all rights", "gnu general public license, general public license", "cc éby cc by",
                 MIT, MIT.replace("free of charge", "free of cost"), "intro " * 50 + MIT.replace("copy", "copy or two of the copies") + " outro" * 9, "Licensed under the Apache License, Version 2.0.", "the apache helicopter version 2 0", "permission to charge any person free",
                 "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "x " * 5000 + "all rights reserved " * 40 + "y" * 9000, "rights all reserved all rights"]


def base_row(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    at = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(at), min([i for i, _ in at], default=None), max([i for i, _ in at], default=None), ",".join(sorted({label for _, label in at}))


@pytest.fixture()
def small_pieces(monkeypatch):
    monkeypatch.setattr(license_index, "PIECE", 64)


def test_licenses(spark, tmp_path):
    texts = [(None if k == 3 else k, t) for k, t in enumerate(LICENSE_TEXTS)] + [(5, LICENSE_TEXTS[5])]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_license_index(spark, str(tmp_path)).collect()
    key = lambda rows: sorted(rows, key=repr)
    assert key([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]) == key([(i, *base_row(t)) for i, t in texts])
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert [labels[k][0] for k in (8, 9, 10, 11, 12, 13, 14, 15)] == ["mit", "", "mit", "apache-2.0", "", "", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0"]
    assert labels[5][1] == 1.0 and labels[0] == ("", 0.0) and 0.75 <= labels[10][1] <= 1
    assert queries.op11_license_index.__name__ and license_index.find_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["cc", "by", "all", "rights", "reserved", "general", "public", "license", "CC", "é", "-", "\x00", "9"]), max_size=40))
def test_base_phrases(words):
    """Pieces of any size find what one look finds, each place once."""
    data = " ".join(words).encode()
    index = license_index.Index(license_index.BASE, {}, 9)
    want = base_row(data.decode())
    for piece in (1, 5, 1 << 20):
        license_index.PIECE, before = piece, license_index.PIECE
        try:
            total, found = index.scan(data)
        finally:
            license_index.PIECE = before
        assert (total, len(found)) == want[:2] and sorted(a for _, a, _, _ in found)[:1] == ([want[2]] if want[1] else [])


def test_templates_across_pieces(spark, small_pieces):
    rows = license_index.find_licenses(table(spark, [(1, "word " * 30 + MIT + " word" * 30), (2, ("all rights reserved " * 50))])).collect()
    places = {r.doc_id: r.places for r in rows}
    assert {p.label for p in places[1]} == {"mit"} and [p["first"] for p in places[2]] == list(range(0, 150, 3))


# ---- spelling ----

SPELL_TEXTS = [None, "", "short words only", *["standard " * 30 + "standart standerd standardd standar " * 2] * 3, "élémentaire " * 25, "élémentair élémentaira ÉLÉMENTAIRE " * 3, "abcdefg abcdefgh abcdefghi bcdefghi " * 4, "a" * 300 + " " + "a" * 301, "a" * 301 + " " + "a" * 299 + "b",
               "tasteful tsateful tastefull tasteful1tasteful " * 6, "×÷×÷×÷×÷ ×÷×÷×÷×× " * 3]


def spelled(texts, shortest=7, least=2, ratio=10, every=31):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= least}

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in n if x != w and edit(w, x)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def test_spelling(spark):
    texts = [(None if k == 7 else k, t) for k, t in enumerate(SPELL_TEXTS)] + [(4, SPELL_TEXTS[4])]
    for options in ({}, {"every": 2, "ratio": 2}, {"tile": 2, "ratio": 3, "least": 1}):
        tile = {k: v for k, v in options.items() if k != "tile"}
        got = sorted(tuple(r) for r in spelling_variants.variants(table(spark, texts), **options).collect())
        assert got == spelled(texts, **tile) and any(r[1] for r in got)
    assert spelling_variants.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling_variants.variants(table(spark, [(1, "no such")])).count() == 0


def test_spelling_dense(spark):
    """Many words of few letters share their blocks; tiles meet in pairs."""
    rng = random.Random(4)
    words = ["".join(rng.choices("ab", k=rng.randrange(7, 11))) for _ in range(260)]
    texts = [(k, " ".join(rng.choices(words, k=90))) for k in range(30)]
    want = spelled(texts, ratio=2)
    for tile in (7, 10_000):
        assert sorted(tuple(r) for r in spelling_variants.variants(table(spark, texts), ratio=2, tile=tile).collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=60), st.text("abé", min_size=1, max_size=60))
def test_edits(x, y):
    a, b = sorted((x.encode("latin-1"), y.encode("latin-1")), key=len)
    want = len(a) == len(b) and sum(p != q for p, q in zip(a, b, strict=True)) == 1 or len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))
    assert spelling_variants.one_edit(a, b) == want
    assert spelling_variants.edits(spelling_variants.Letters([a, b]), np.array([0]), np.array([1]))[0] == want


# ---- clusters ----


def lloyd(vectors, k, rounds, scale, seed):
    """Whole numbers all the way, every vector against every centroid."""
    rows = [(i, tuple(int(np.floor(x * float(scale))) for x in map(float, v))) for i, v in vectors]
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in rows:
            groups[near(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)) if groups[n] else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in rows]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x < 2**63 else None
    return sorted([(i, c, fits(d), fits(inertia[c]), fits(sum(inertia.values())), name[c]) for i, c, d in found], key=repr)


def vectors_table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "clash", 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, block int").repartition(3)


def test_clusters(spark):
    rng = np.random.default_rng(6)
    cloud = lambda n, m, d=3: [(int(i), (rng.normal(size=d) + 4 * rng.integers(0, m, d)).astype(np.float32).tolist()) for i in range(n)]
    odd = [(901, None), (902, []), (903, [1.0, 2.0]), (904, [1.0, None, 2.0]), (905, [1.0, float("nan"), 2.0]), (906, [float("inf"), 1.0, 1.0]), (907, [1.0] * 4)]
    spread = cloud(300, 3)
    cases = {
        "spread": (spread + odd, 8, 10), "few": (spread[:5], 8, 3), "one": (spread[:9], 1, 2), "equal": ([(k, [0.5, -0.5, 0.25]) for k in range(20)], 4, 3), "ties": ([(k, [float(k % 3), float(k % 2), 0.0]) for k in range(40)], 5, 4),
        "null ids": ([(None, v) for _, v in spread[:30]] + [(7, v) for _, v in spread[30:60]], 6, 3), "many": (cloud(400, 5), 40, 6), "none": (odd, 8, 3), "start": (spread, 6, 0),
    }
    for rows, k, rounds in cases.values():
        good = [(i, v) for i, v in rows if v and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v)]
        got = centroid_search.clusters(vectors_table(spark, rows), k=k, rounds=rounds, dims=3, scale=64, seed="s")
        assert sorted(map(tuple, got.collect()), key=repr) == lloyd(good, k, rounds, 64, "s")


def test_large_numbers(spark, monkeypatch):
    """Integers beyond 64 bits stay exact; what a long can't hold is null."""
    monkeypatch.setattr(centroid_search, "BLOCK", 4)
    rows = [(k, [(-1.0) ** k * 10.0 ** (k % 14), float(k), 3.0]) for k in range(40)]
    got = centroid_search.clusters(vectors_table(spark, rows, "double"), k=3, rounds=4, dims=3, scale=1024)
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows, 3, 4, 1024, "3")


def test_search_is_exact():
    """Bounds moved over many rounds never change a vector's centroid."""
    rng = np.random.default_rng(8)
    v = rng.integers(-40, 40, (500, 4))
    centroids = v[:12].copy()
    a, s, u, low = centroid_search.unseen(len(v), 12)
    moved = np.zeros(12)
    for _ in range(15):
        centroid_search.step(v, a, s, u, low, centroid_search.Geometry(centroids, moved))
        d = ((v[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (a == d.argmin(axis=1)).all()
        assert (low <= np.sqrt(np.where(np.arange(12) == a[:, None], 1 << 40, d).min(axis=1)) + 1e-6).all()
        new = centroids + rng.integers(-3, 4, centroids.shape)
        moved, centroids = np.sqrt(((new - centroids) ** 2).sum(axis=1)), new
