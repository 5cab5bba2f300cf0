"""Quality rules: word, symbol and repetition counts, and compression bands.

A text is kept when it has enough words, does not consist of repeated three-word runs, and its zstandard
ratios, over the whole text and over fixed chunks of it, lie inside the band of its length: a high ratio means
repetition, a low one means text that no language model of bytes could shorten.

Chunks have one size whatever the text: they follow each other from its start, and where bytes are left over, one more
chunk ends at its end. One chunk of a hundred clean ones or so lies outside its band by chance, so a long text is judged by
the share of its chunks that do.

Defined cases: null and empty texts have no words, fail the base rule and are not kept. A text shorter than a chunk
has none and is judged by its whole ratio; its chunk ratios are 0. Repeated rows are each judged alone; further columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .batches import bytes_of, map_slices, slices

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Least and greatest ratio (bytes by compressed bytes) of texts below each length, the last for all longer ones.

    The limits are the 0.5 % and 99.5 % quantiles of the ratios of texts labelled good that pass the base rule (sf0.1,
    3,243 texts), less and plus 3 %; for chunks, those of the least and greatest chunk of the 560 such texts that have any.
    No text labelled good reaches the last lengths, so their greatest ratios are those of distinct texts labelled good that
    were joined to that length, one language at a time (2.34 to 2.73 at 20,000 to 65,536 bytes, up to 2.70 at 131,072, 2.82 at
    524,288, 2.84 at 1 MB), plus 3 %; the least ratio stays that of the length before. Of their chunks at most one in 30 lay outside.
    A text fails by its chunks if more than one in ``chunk_share`` of them are outside.
    """

    below_bytes: tuple[int, ...] = (512, 1024, 2048, 4096, 8192, 16384, 32768, 262144, 524288)
    least: tuple[float, ...] = (1.37, 1.45, 1.72, 1.89, 2.06, 2.15, 2.26, 2.26, 2.26, 2.26)
    most: tuple[float, ...] = (1.89, 2.0, 2.15, 2.27, 2.4, 2.48, 2.56, 2.81, 2.9, 2.93)
    chunk_bytes: int = 4096
    chunk_least: float = 2.03
    chunk_most: float = 2.30
    chunk_share: int = 16
    level: int = 3


BANDS = Bands()
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that the text has at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = np.fromiter((often[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()  # bytes split exactly at x20 and x09-x0D
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= sum(len(w) - len(w.decode("utf-8", "replace")) for w in words if not w.isascii())
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, sum(text.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeated_words(words)


def ratios(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Whole ratio, and the ratios of the chunks."""
    if not text:
        return 0.0, []
    whole = len(text) / len(compressor.compress(text))
    size = bands.chunk_bytes
    if len(text) < size:
        return whole, []
    starts = [*range(0, len(text) - size + 1, size), *([len(text) - size] if len(text) % size else [])]
    return whole, [size / len(compressor.compress(text[a : a + size])) for a in starts]


def inside(n_bytes: int, whole: float, chunks: list[float], bands: Bands) -> bool:
    """Whether the ratios lie in the band of the length."""
    k = int(np.searchsorted(bands.below_bytes, n_bytes, side="right"))
    if not bands.least[k] <= whole <= bands.most[k]:
        return False
    outside = sum(not bands.chunk_least <= c <= bands.chunk_most for c in chunks)
    return outside * bands.chunk_share <= len(chunks)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("chunk_ratio_min", pa.float64()), ("chunk_ratio_max", pa.float64())])
COLUMNS = ARROW.names[1:]
TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_ratio_min double, chunk_ratio_max double"


def judge(texts: list[bytes], bands: Bands = BANDS) -> dict[str, list]:
    """The measures and verdict of each text."""
    compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
    out: dict[str, list] = {c: [] for c in COLUMNS}
    for text in texts:
        counts = base_counts(text)
        failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
        whole, chunks = ratios(text, bands, compressor)
        kept = not failed and inside(len(text), whole, chunks, bands)
        for c, v in zip(COLUMNS, (*counts, failed, kept, whole, min(chunks, default=0.0), max(chunks, default=0.0)), strict=True):
            out[c].append(v)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = BANDS) -> DataFrame:
    """One row per document: doc_id, the counts, ``base_failed``, ``kept`` and the three ratios."""

    def run(part):
        return judge(bytes_of(part, 1), bands) | {"doc_id": part.column(0)}

    return map_slices(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, f"doc_id long, {TYPES}", ARROW, 1)


def keep_quality(docs: DataFrame, text_col: str = "text", bands: Bands = BANDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept: the filter runs inside the scan's tasks, without a join."""
    at = docs.columns.index(text_col)

    def run(batches):
        for part in slices(batches, at):
            yield part.filter(pa.array(judge(bytes_of(part, at), bands)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
