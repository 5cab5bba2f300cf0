"""License notices by a positional index of rare licence words.

Templates are short licence texts with a label and the phrases without which a text is not that licence. Their words are
indexed with their positions. How rare a licence word is follows from all documents: the share of documents that hold it.
Of each file the licence words that it holds are looked up, rarest first: each template is entered by its own rarest
words (its anchors), whose postings give the place at which the template would have to begin. Where enough anchors name the
same place, give or take the template's slack, the template stands there if its mandatory phrases do, each as consecutive
words inside that stretch, and if the words found there weigh enough (by inverse document frequency) of the template's.
A template without slack has one anchor and is its own mandatory phrase, so each place where it stands is found.

Texts are scanned in pieces with the end of the piece before in front, so memory does not follow the length of a text.

Defined cases: null and empty texts have no words and no labels, and score 0; a file's words are those of its whole text;
repeated rows are rows of their own; a null doc_id stays null. An empty table gives an empty result. Further columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bytes_of, map_slices, slices

#: Bytes of text whose words are held at once.
PIECE = 1 << 20
#: Bytes that are no word (below x80 all but digits and letters) become spaces, A-Z become a-z; higher bytes belong to words.
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() and b > 47 and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Anchors of a template with slack, the share of them that must agree, and the share of the weight that must be found.
ANCHORS, AGREE, COVER = 6, 0.5, 0.75


def words_of(data: bytes) -> list[bytes]:
    return data.translate(TABLE).split()


@dataclass(frozen=True)
class Template:
    """A licence text: its words, the phrases that must stand in it, and how many words may be missing or added before any place."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    slack: int = 0
    base: bool = False
    words: tuple[bytes, ...] = field(init=False)
    keys: tuple[tuple[bytes, ...], ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "words", tuple(words_of(self.text.encode())))
        object.__setattr__(self, "keys", tuple(tuple(words_of(p.encode())) for p in (self.phrases or (self.text,))))


# The phrases that every scan looks for, with their labels.
BASE = (Template("cc-by", "cc by", base=True), Template("gpl", "general public license", base=True), Template("reserved", "all rights reserved", base=True))

# The opening or notice of well-known licences, and the words that tell each from the others.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",), 3),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("www apache org licenses license 2 0",), 8),
    Template("mit", "released under the mit license", ("mit license",), 2),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction"), 8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met"), 8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",), 6),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3"), 4),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2"), 4),
    Template("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("under the terms of the gnu general public license",), 8),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",), 1),
    Template("agpl", "gnu affero general public license", ("affero general public license",), 1),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 6),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",), 6),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",), 3),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",), 2),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",), 2),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",), 2),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",), 2),
    Template("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",), 3),
)


class Index:
    """Anchors' postings and the words' weights; small, as templates are few and short."""

    def __init__(self, templates: tuple[Template, ...], counts: dict[bytes, int], total: int):
        self.templates = templates
        vocabulary = {w for t in templates for w in t.words}
        self.weight = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for k, t in enumerate(templates):
            anchors = sorted(set(t.words), key=lambda w: (-self.weight[w], w))[: ANCHORS if t.slack else 1]
            # one posting of an exact template suffices, of a loose one all places of each anchor count
            for place, w in enumerate(t.words):
                if w in anchors and (t.slack or w not in t.words[:place]):
                    self.postings[w].append((k, place))
            self.needed.append(max(1, math.ceil(AGREE * len(anchors))))
        self.span = max((len(t.words) + 2 * t.slack for t in templates), default=0)

    def places(self, words: list[bytes], fresh: int) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, end, score) of templates in a list of words; those that end within the first ``fresh`` words are left out."""
        met: dict[bytes, list[int]] = defaultdict(list)
        for at, w in enumerate(words):
            if w in self.postings:
                met[w].append(at)
        begins: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for w in sorted(met, key=lambda w: (-self.weight[w], w)):  # the file's rarest licence words first
            for k, place in self.postings[w]:
                begins[k] += [(at - place, w) for at in met[w]]
        for k, found in begins.items():
            t = self.templates[k]
            if not t.slack:
                for begin, _ in found:
                    if 0 <= begin and begin + len(t.words) > fresh and tuple(words[begin : begin + len(t.words)]) == t.words:
                        yield k, begin, begin + len(t.words), 1.0
                continue
            found.sort()
            last, lo = -1, 0
            count: Counter = Counter()
            for begin, w in found:  # anchors that name one place, within the slack
                count[w] += 1
                while found[lo][0] < begin - t.slack:
                    count[found[lo][1]] -= 1
                    if not count[found[lo][1]]:
                        del count[found[lo][1]]
                    lo += 1
                if len(count) < self.needed[k] or found[lo][0] < last:
                    continue
                a, b = max(0, found[lo][0] - t.slack), min(len(words), begin + len(t.words) + t.slack)
                if b <= fresh:
                    continue
                got = self.verified(t, words[a:b])
                if got is not None:
                    first, end, score = got
                    last = a + end
                    yield k, a + first, a + end, score

    def verified(self, t: Template, stretch: list[bytes]) -> tuple[int, int, float] | None:
        """First word, end and score of a template in a stretch, if its phrases stand there and enough of its weight does."""
        spots = []
        for key in t.keys:
            at = next((i for i in range(len(stretch) - len(key) + 1) if tuple(stretch[i : i + len(key)]) == key), None)
            if at is None:
                return None
            spots.append((at, at + len(key)))
        want, have = Counter(t.words), Counter(stretch)
        score = sum(self.weight[w] * min(n, have[w]) for w, n in want.items()) / sum(self.weight[w] * n for w, n in want.items())
        return None if score < COVER else (min(s for s, _ in spots), max(e for _, e in spots), min(1.0, score))

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int, int, float]]]:
        """Number of words of a text, and its templates' places."""
        clean = data.translate(TABLE)
        out, carried, total, at = [], [], 0, 0
        while at < len(clean):
            end = clean.find(b" ", at + PIECE)
            end = len(clean) if end < 0 else end
            words = clean[at:end].split()
            begin = total - len(carried)
            out += [(k, begin + a, begin + b, s) for k, a, b, s in self.places(carried + words, len(carried))]
            total += len(words)
            carried = (carried + words)[-self.span :] if self.span else []
            at = end
        return total, out


def word_counts(docs: DataFrame, text_col: str, templates: tuple[Template, ...]) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands, and how many documents there are."""
    vocabulary = {w for t in templates for w in t.words}
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches, 0):
            for data in bytes_of(part, 0):
                counts.update(words_in(data, vocabulary))
                counts[b""] += 1  # documents
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    found = docs.select(docs[text_col].alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # no more rows than template words
    counts = {bytes(r["word"]): r["n"] for r in found}
    return counts, counts.pop(b"", 0)


def words_in(data: bytes, vocabulary: set[bytes]) -> set[bytes]:
    clean, out, at = data.translate(TABLE), set(), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        out |= vocabulary.intersection(clean[at:end].split())
        at = end
    return out


PLACES = "array<struct<label: string, base: boolean, first: bigint, end: bigint, score: double>>"


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words and ``places``, each with label, base, first word, end and score, in order of place."""
    index = Index(templates, *word_counts(docs, text_col, templates))
    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place))])

    def run(part: pa.RecordBatch) -> dict[str, list]:
        scanned = [index.scan(data) for data in bytes_of(part, 1)]
        named = [[{"label": templates[k].label, "base": templates[k].base, "first": a, "end": b, "score": s} for k, a, b, s in sorted(found, key=lambda f: (f[1], f[2], f[0]))] for _, found in scanned]
        return {"doc_id": part.column(0), "n_words": [n for n, _ in scanned], "places": named}

    return map_slices(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, f"doc_id long, n_words long, places {PLACES}", arrow, 1)

