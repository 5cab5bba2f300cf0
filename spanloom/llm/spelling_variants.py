"""Spelling variants: words one edit apart, and the far commoner word that each is a variant of, by blocked Gram matrices.

Words are letter runs of whole texts; each slice of texts counts its own before they are added up. Two words one edit apart
have letter counts at a squared distance of 2 (a letter replaced) or 1 (one more or less), so they differ in two letters at
most. The letters are dealt to five groups, and such words have equal counts in at least three of them: a block is the
words of equal counts in three named groups, ten blocks a word, and every near pair shares a block. Inside a block the
Gram matrix of the letter counts of the two other groups gives all squared distances at once, between words of one length
and of the next; pairs at most two apart have their letters compared. A pair that shares several blocks counts in the first.

Blocks are dealt to buckets whose number follows the rows. A block with more than ``TILE`` words is cut into tiles by
the words' hashes, which meet in pairs. A meeting returns for each word how many near ones it met and the best of them, so
pairs are not listed.

Defined cases: null and empty texts have no words; a null doc_id hashes as the empty text; repeated rows count again. Words
are runs of A-Z, a-z and U+00C0 to U+00FF of any length, only A-Z lower-cased. An empty table gives an empty result.
Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .batches import slices

#: Words that a task counts before it passes them on.
COUNTED = 400_000
#: Most words of a block that are compared in one go, words of small blocks that share a matrix, and rows of a bucket.
TILE, PACK, BUCKET_ROWS = 2048, 192, 6000
#: Groups of letters, of which a near pair differs in two at most.
GROUPS = 5
CHOICES = list(combinations(range(GROUPS), GROUPS - 2))
#: By the set of groups with equal counts (as bits), the first choice of groups that it holds; -1 for none.
FIRST = np.array([next((k for k, c in enumerate(CHOICES) if all(bits >> g & 1 for g in c)), -1) for bits in range(1 << GROUPS)])
#: Pairs whose letters are compared at once.
CHECKED = 1 << 16
#: Letters up to which words are compared as rows of a matrix.
SHORT = 48


def count_words(docs: DataFrame, id_col: str, text_col: str, shortest: int, every: int) -> DataFrame:
    """(word, n) of each slice of documents: letter runs, one letter less where ``every`` divides the crc32 of ``<doc_id>:<run>``."""
    # a run that is too short gives no word, with or without a letter less
    run_of = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches, 1):
            for doc, text in zip(part.column(0), part.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
                for word, n in Counter(run_of.findall(text.as_py().lower().decode())).items():  # bytes lower-case A-Z alone
                    h = zlib.crc32(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] += n
                if len(counts) > COUNTED:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "word string, n long")


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each letter (by code), the commonest ones dealt out in turn."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter != ''").groupBy("letter").count()
    ranked = sorted(letters.collect(), key=lambda r: (-r["count"], r["letter"]))  # 90 letters at most
    group = np.zeros(256, np.int64)
    for k, r in enumerate(ranked):
        turn = k % (2 * GROUPS)
        group[ord(r["letter"])] = min(turn, 2 * GROUPS - 1 - turn)
    return group


def group_hashes(joined: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each word a hash of its letter counts in each group: the sum of fixed random numbers of its letters."""
    numbers = np.random.default_rng(17).integers(0, 1 << 63, 256, np.int64).view(np.uint64)
    return np.stack([np.add.reduceat(np.where(group == g, numbers, np.uint64(0))[joined], starts) for g in range(GROUPS)], axis=1)


def with_blocks(words: DataFrame, group: np.ndarray) -> DataFrame:
    """Ten rows a word: choice of groups, block, the word's letters as single bytes, and n."""
    schema = pa.schema([("choice", pa.int32()), ("block", pa.int64()), ("letters", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            h = group_hashes(np.frombuffer(b"".join(letters), np.uint8), np.cumsum([0, *map(len, letters[:-1])]), group)
            column = pa.array(letters, pa.binary())
            for k, chosen in enumerate(CHOICES):
                block = h[:, list(chosen)].sum(axis=1, dtype=np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
                yield pa.record_batch([pa.array(np.full(len(letters), k, np.int32)), pa.array(block.view(np.int64)), column, batch.column(1)], schema=schema)

    return words.mapInArrow(run, "choice int, block long, letters binary, n long")


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes a into b; b is no shorter than a."""
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Letters:
    """The letters of many words in one array, with where each word begins."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words])
        self.starts = np.cumsum(self.size) - self.size
        self.joined = np.frombuffer(b"".join(words), np.uint8)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Words of up to ``SHORT`` letters as rows, zeros behind them."""
        place = np.arange(SHORT + 1)
        inside = place < self.size[at][:, None]
        return np.where(inside, self.joined[np.where(inside, self.starts[at][:, None] + place, 0)], 0)

    def counts(self, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Counts of the given letters in the words, in a type in which Gram matrices are exact."""
        place = np.full(256, -1)
        place[letters] = np.arange(len(letters))
        size = self.size[at]
        of = np.repeat(np.arange(len(at)), size)
        letter = place[self.joined[np.repeat(self.starts[at] - (np.cumsum(size) - size), size) + np.arange(len(of))]]
        used = letter >= 0
        counts = np.bincount(of[used] * len(letters) + letter[used], minlength=len(at) * len(letters)).reshape(len(at), len(letters))
        return counts.astype(np.float32 if size.max() < 1 << 11 else np.float64)


def edits(words: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (words i no longer than words j) are one edit apart."""
    size = words.size
    good = np.zeros(len(i), bool)
    long = size[j] > SHORT
    for k in np.flatnonzero(long):
        good[k] = one_edit(words.words[i[k]], words.words[j[k]])
    k = np.flatnonzero(~long)
    a, b = words.rows(i[k]), words.rows(j[k])
    differ = a != b
    # one letter more: after the first difference the shorter word goes on where the longer one does a letter later
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), SHORT)
    later = (a[:, :-1] != b[:, 1:]) & (np.arange(SHORT) >= first[:, None])
    good[k] = np.where(size[i[k]] == size[j[k]], differ.sum(axis=1) == 1, (size[j[k]] - size[i[k]] == 1) & ~later.any(axis=1))
    return good


def near_in_tile(counts: np.ndarray, size: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs between two sides (within one if ``right`` is None), both ordered by length: one block, counts at most two apart and not equal. The first is no longer than the second."""
    same = right is None
    right = left if same else right
    if not len(left) or not len(right):  # all words of a meeting may be of one tile
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    norm = (counts * counts).sum(axis=1)
    out_i, out_j = [], []
    # adjacent length blocks: words of a length meet those one shorter to one longer; few words meet in one product
    cuts = np.flatnonzero(np.diff(size[left])) + 1 if len(left) > PACK else np.zeros(0, np.int64)
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(left)], strict=True):
        lo, hi = np.searchsorted(size[right], [size[left[s]] - 1, size[left[e - 1]] + 2])
        a, b = left[s:e], right[lo:hi]
        d = norm[a][:, None] + norm[b][None, :] - 2 * (counts[a] @ counts[b].T)
        u, v = np.nonzero((d <= 2) & (d > 0) & (block[a][:, None] == block[b][None, :]))
        if same:
            u, v = u[u + s < v + lo], v[u + s < v + lo]
        out_i.append(a[u])
        out_j.append(b[v])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    swap = size[i] > size[j]
    return np.where(swap, j, i), np.where(swap, i, j)


def compared(table: pa.Table, group: np.ndarray, sides: bool) -> pa.Table:
    """Of each word of one bucket (or of two tiles of one block) the number of near words, and n and letters of the best one."""
    choice, block, n = (table.column(c).to_numpy() for c in ("choice", "block", "n"))
    words = Letters(table.column("letters").to_pylist())
    h = group_hashes(words.joined, words.starts, group)
    second = table.column("right").to_numpy(zero_copy_only=False).astype(bool) if sides else None
    order = np.lexsort((words.size, block, choice))
    cuts = np.flatnonzero(np.concatenate([[True], (block[order][1:] != block[order][:-1]) | (choice[order][1:] != choice[order][:-1])]))
    ends = np.append(cuts[1:], len(order))
    pairs: list = []

    def meet(k: int, packs: list[np.ndarray]) -> None:
        """Small blocks of one choice together, or one alone."""
        at = np.concatenate(packs)
        at = at[np.argsort(words.size[at], kind="stable")]
        side = (lambda x: np.flatnonzero(second[at] == x)) if sides else (lambda x: None if x else np.arange(len(at)))
        i, j = near_in_tile(words.counts(at, np.flatnonzero(~np.isin(group, CHOICES[k]))), words.size[at], block[at], side(False), side(True))
        i, j = at[i], at[j]
        first = FIRST[((h[i] == h[j]) << np.arange(GROUPS)).sum(axis=1)] == k
        pairs.append((i[first], j[first]))

    held: list = []
    filled = 0
    for s, e in zip(cuts.tolist(), ends.tolist(), strict=True):
        if e - s < 2:
            continue  # alone in its block
        if held and (filled + e - s > PACK or choice[order[s]] != choice[held[0][0]]):
            meet(choice[held[0][0]], held)
            held, filled = [], 0
        held.append(order[s:e])
        filled += e - s
    if held:
        meet(choice[held[0][0]], held)
    i = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    j = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    good = np.concatenate([edits(words, i[k : k + CHECKED], j[k : k + CHECKED]) for k in range(0, len(i), CHECKED)]) if len(i) else np.zeros(0, bool)
    i, j = np.concatenate([i[good], j[good]]), np.concatenate([j[good], i[good]])
    used = np.unique(j)
    rank = np.zeros(len(words.words), np.int64)
    rank[sorted(used.tolist(), key=words.words.__getitem__)] = np.arange(len(used))
    best = np.lexsort((rank[j], -n[j], i))
    i, j = i[best], j[best]
    near, head, met = np.unique(i, return_index=True, return_counts=True)
    return pa.table({"letters": pa.array([words.words[r] for r in near], pa.binary()), "near": pa.array(met, pa.int64()), "best_n": pa.array(n[j[head]], pa.int64()), "best": pa.array([words.words[r] for r in j[head]], pa.binary())})


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Of each word (word, n) that has any: letters, number of near words, and n and letters of the commonest of them."""
    group = letter_groups(words)
    rows = materialize(with_blocks(words, group), "blocks")
    total = rows.count()
    sizes = rows.groupBy("choice", "block").agg(F.count("*").alias("size"))
    large = materialize(sizes.where(F.col("size") > tile).select("choice", "block", F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "large")
    schema = "letters binary, near long, best_n long, best binary"
    small = rows.join(large, ["choice", "block"], "left_anti").withColumn("bucket", F.pmod(F.xxhash64("choice", "block"), F.lit(-(-total // BUCKET_ROWS) or 1)))
    met = small.groupBy("bucket").applyInArrow(lambda t: compared(t, group, False), schema)
    # tiles of a large block: each meets itself and all after it
    dealt = rows.join(large, ["choice", "block"]).withColumn("tile", F.pmod(F.xxhash64("letters"), F.col("tiles")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("choice", "block", "letters", "n", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") > F.col("other")).alias("right"))
    many = dealt.groupBy("choice", "block", "a", "b").applyInArrow(lambda t: compared(t, group, t.column("a")[0] != t.column("b")[0]), schema)
    return met.unionByName(many).groupBy("letters").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("best"))).alias("top"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) over (word, form): where the chain of forms ends. Chains are short, as counts rise tenfold a step; pointers double."""
    ends = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ends.join(ahead, "root", "left_semi").isEmpty():
            return ends
        ends = materialize(ends.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, ratio: int = 10, every: int = 31, tile: int = TILE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. A word's form is its commonest near word, if ``ratio`` times as common."""
    counted = count_words(docs, id_col, text_col, shortest, every).groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(counted.where(F.col("n") >= least), "words")
    near = near_words(words, tile).select(F.decode("letters", "ISO-8859-1").alias("word"), "near", (-F.col("top.least")).alias("best_n"), F.decode("top.best", "ISO-8859-1").alias("best"))
    far = F.col("best_n") >= ratio * F.col("n")
    found = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best")).alias("form"), F.when(far, F.col("best_n")).alias("form_n")), "variants")
    roots = last_forms(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
