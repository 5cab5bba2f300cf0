"""Byte-level BPE over a global dictionary of distinct pre-tokens, and decoding by the token-byte table.

Documents are read in chunks of bounded size. A chunk keeps each distinct pre-token once, and its texts as positions:
the pre-tokens' numbers in order. The chunks' dictionaries are dealt by a hash of the word, so that all chunks' copies
of a word meet and the word is encoded once; the ids go back to the chunks, which put them in order of position.
Dictionaries and positions travel packed, since a row for each word or position would outweigh the text.

A word meets its copies from up to ``CHUNKS_TOGETHER`` chunks (some 8 GB of text), which keeps every group bounded, however
common a word is. Where there are more chunks, each such set gives its distinct words, the sets' words meet once more,
and the ids of each distinct word go back to the sets.

Defined cases: null and empty texts have no ids. A text longer than a chunk is a chunk of its own. Repeated rows are
each encoded; null doc_ids are kept. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize_bucketed
from .batches import slices
from .pretokens import split_batch

CHUNK_BYTES = 8 << 20
BUCKETS = 64
CHUNKS_TOGETHER = 1024
#: Texts whose pre-tokens are found at once inside a chunk.
SPLIT_CHARS = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pack(parts: list[bytes]) -> bytes:
    """Byte strings as one: their number, their lengths, their bytes."""
    return np.uint32(len(parts)).tobytes() + np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths and joined bytes of ``pack``."""
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.frombuffer(data, np.uint32, n, 4), data[4 + 4 * n :]


def parts_of(data: bytes) -> list[bytes]:
    lengths, joined = unpack(data)
    ends = np.cumsum(lengths).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def squeeze(numbers: np.ndarray) -> bytes:
    """Small numbers in few bytes: by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
    """Distinct pre-tokens, the number of each pre-token in order, and how many each text has."""
    index: dict[str, int] = defaultdict(count().__next__)
    sequence, per_text, at = [], [], 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to]) <= SPLIT_CHARS):
            chars += len(texts[to])
            to += 1
        words, sizes = split_batch(texts[at:to])
        sequence.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
        per_text += sizes.tolist()
        at = to
    return list(index), (np.concatenate(sequence) if sequence else np.zeros(0, np.uint32)), per_text


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: its dictionary packed by bucket, the documents' ids and sizes, and the positions."""
    arrow = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("positions", pa.binary()), ("words", pa.list_(pa.binary()))])

    def run(batches):
        for k, part in enumerate(slices(batches, 1, CHUNK_BYTES)):
            words, sequence, sizes = numbered([t or "" for t in part.column(1).to_pylist()])
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in raw), np.int64, len(raw))
            # the r-th most frequent word of bucket b has number r x BUCKETS + b, so frequent words have small numbers
            often = np.argsort(-np.bincount(sequence, minlength=len(raw)), kind="stable")
            order = often[np.argsort(bucket[often], kind="stable")]
            cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            rank = np.empty(len(raw), np.uint32)
            rank[order] = (np.arange(len(raw)) - cuts[bucket[order]]) * BUCKETS + bucket[order]
            packed = [pack([raw[i] for i in order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
            row = [[(TaskContext.get().partitionId() << 32) + k], [part.column(0).to_pylist()], [sizes], [squeeze(rank[sequence])], [packed]]
            yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "chunk long, doc_ids array<long>, sizes array<int>, positions binary, words array<binary>")


def shrink(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def grow(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class WordIds(dict):
    """Packed ids of words, each encoded when it is first asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = np.array(self.encode(word), "<u4").tobytes()
        return ids


def encode_words(rows: DataFrame, ranks: dict[bytes, int], pattern: str, sets: int) -> DataFrame:
    """(chunk, bucket, ids): the ids of each word of a packed dictionary, packed in the same order; each distinct word is encoded once.

    ``rows`` has chunk, bucket, packed and ``apart``, the chunk's set (0 to ``sets`` - 1).
    """

    def told(table: pa.Table, known: dict[bytes, bytes]) -> pa.Table:
        out = [shrink(pack([known[w] for w in parts_of(data.as_py())])) for data in table.column("packed")]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "ids": pa.array(out, pa.binary())})

    def distinct(column: pa.ChunkedArray) -> set[bytes]:
        return {w for data in column for w in parts_of(data.as_py())}

    types = "chunk long, bucket int, ids binary"
    if sets == 1:
        return rows.groupBy("bucket").applyInArrow(lambda t: told(t, WordIds(ranks, pattern)), types)

    def gathered(table: pa.Table) -> pa.Table:
        parts: dict[int, list[bytes]] = defaultdict(list)
        for word in sorted(distinct(table.column("packed"))):
            parts[zlib.crc32(word) // BUCKETS % sets].append(word)  # the bucket is the rest by BUCKETS
        one = lambda c: [table.column(c)[0].as_py()] * len(parts)
        return pa.table({"bucket": pa.array(one("bucket"), pa.int32()), "apart": pa.array(one("apart"), pa.int64()), "part": pa.array(list(parts), pa.int32()), "words": pa.array([shrink(pack(w)) for w in parts.values()], pa.binary())})

    def encoded(table: pa.Table) -> pa.Table:
        each = [parts_of(grow(w.as_py())) for w in table.column("words")]
        known = WordIds(ranks, pattern)
        ids = [shrink(pack([known[w] for w in words])) for words in each]
        return pa.table({"bucket": table.column("bucket"), "apart": table.column("apart"), "words": table.column("words"), "ids": pa.array(ids, pa.binary())})

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[bytes, bytes] = {}
        for words, ids in zip(right.column("words"), right.column("ids"), strict=True):
            known.update(zip(parts_of(grow(words.as_py())), parts_of(grow(ids.as_py())), strict=True))
        return told(left, known)

    # sets' distinct words, in as many parts of each bucket as there are sets, so that a part holds about as many words whatever
    # the input; then each word's ids, told to every set that has it
    known = rows.groupBy("bucket", "apart").applyInArrow(gathered, "bucket int, apart long, part int, words binary").groupBy("bucket", "part").applyInArrow(encoded, "bucket int, apart long, words binary, ids binary")
    return rows.groupBy("bucket", "apart").cogroup(known.groupBy("bucket", "apart")).applyInArrow(back, types)


def gather(lengths: np.ndarray, joined: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked items' values one behind the other, and each picked item's length."""
    starts = np.cumsum(lengths) - lengths
    sizes = lengths[picks]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    step = np.ones(total, np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        first = (ends - sizes)[full]
        begin, size = starts[picks[full]], sizes[full]
        step[first[0]] = begin[0]
        step[first[1:]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
    return joined[np.cumsum(step)], sizes


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ``ids`` (array of int), as the ranks and the pattern give them without special tokens."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    chunks = materialize_bucketed(chunked(docs, id_col, text_col), "chunk", int(min(20_000, max(24, total // CHUNK_BYTES))), "chunks")
    sets = max(1, -(-chunks.count() // CHUNKS_TOGETHER))
    words = chunks.select("chunk", F.posexplode("words").alias("bucket", "packed")).withColumn("apart", F.pmod(F.xxhash64("chunk"), F.lit(sets)))
    coded = encode_words(words, ranks, pattern, sets)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        # a chunk has one row on the left; on the right one for each bucket, in order of the words' numbers
        order = np.argsort(right.column("bucket").to_numpy())
        packs = right.column("ids")
        lengths, values = [], []
        for k in order:
            n, joined = unpack(grow(packs[int(k)].as_py()))
            lengths.append(n // 4)
            values.append(np.frombuffer(joined, "<u4"))
        base = np.cumsum([0, *map(len, lengths)])
        lengths = np.concatenate(lengths).astype(np.int64)
        number = unsqueeze(left.column("positions")[0].as_py())
        picks = base[number % BUCKETS] + number // BUCKETS
        ids, sizes = gather(lengths, np.concatenate(values), picks)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(left.column("sizes")[0].values.to_numpy())])]
        return pa.table({"doc_id": left.column("doc_ids")[0].values, "ids": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32)))})

    places = chunks.select("chunk", "doc_ids", "sizes", "positions")
    return places.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(assemble, "doc_id long, ids array<int>")


class TokenBytes:
    """The token-byte table as arrays, to be joined by position: ids are the rows' numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.lengths, self.joined, ids)[0].tobytes()


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows of ``encoded`` with ``decoded`` (binary): the table of token bytes, of fixed size, is joined in every task."""
    table = TokenBytes(ranks)
    at = encoded.columns.index("ids")

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            texts = [table.decode(ids.values.to_numpy()) if ids.is_valid else None for ids in column]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, and the sha256 of the decimal ids joined by commas and of the bytes that the ids decode to."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    table, size = TokenBytes(ranks), max(ranks.values(), default=0) + 1

    def run(batches):
        names = list(map(str, range(size)))
        for batch in batches:
            out = []
            for ids in batch.column(1):
                row = ids.values.to_numpy()
                told = ",".join(map(names.__getitem__, row.tolist())).encode()
                out.append((len(row), hashlib.sha256(told).hexdigest(), hashlib.sha256(table.decode(row)).hexdigest()))
            n, told, text = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(text, pa.string())], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
