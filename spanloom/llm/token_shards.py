"""Token-id files with a minimal perfect hash index.

Documents go, in ascending order of doc_id, into shards: rows of a Parquet table whose ``payload`` is raw ids, one
document behind the other. An index, dealt by a hash of the key, holds for each of its parts a minimal perfect hash of
its keys and, in the slots that it gives, fingerprints and places (shard, offset, length). A lookup goes straight to a
part, a slot and a place; the fingerprint tells a foreign key.

Ids are those of the library's plain call: an added token's string in a text is that token, whole.

Defined cases: null and empty texts have the end id alone. Null doc_ids come first. Rows with the same doc_id stand in
order of their texts' hash; the key of the k-th is (doc_id, k), so a lookup by doc_id gives the first. Rows of one
doc_id are written by one task. An empty table gives no shards and an empty index.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, materialize_bucketed
from .batches import slices
from .byte_bpe import SPLIT_CHARS, gather
from .pretokens import split_batch

SHARD_TOKENS = 4 << 20
KEYS_PER_PART = 1 << 16
#: A Python worker forgets its words when it holds that many, at the next piece of text.
KNOWN_WORDS = 600_000
END_ID = 0
_HELD: dict[str, WordIds] = {}


def mix(key: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bits: a key that is alone in its place of a level stays there, the others go to the next.

    A key's number is the count of set bits before its own, so n distinct keys get 0 to n - 1.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [int(b.sum()) for b in levels]
        self.before = np.cumsum([0, *ones])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = 2 * len(left) + 1
            at = mix(left, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at.astype(np.int64)]]
            if len(levels) > 64:
                raise ValueError("keys repeat")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for one that no level holds. Foreign keys may get a number."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[list[int], list[bytes]]:
        return [len(b) for b in self.levels], [np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def load(cls, sizes: list[int], data: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(d, np.uint8), count=n).astype(bool) for n, d in zip(sizes, data, strict=True)])


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds:
    """Ids of words by the tokenizers library, each word once while it is held.

    A word's number points into arrays of lengths and ids. The first numbers are the end id's and the added tokens'.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only plain byte-level tokenizers are read")
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take their surroundings are not read")
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # the leftmost added token wins, of those the longest
        names = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.added = names
        self.cut_at = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        ids = {t.content: i for i, t in added.items()}
        self.first_ids = np.array([END_ID, *(ids[n] for n in names)], np.uint32)
        self.number_of_added = {n: k + 1 for k, n in enumerate(names)}
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        n = len(self.first_ids)
        self.index: dict[str, int] = defaultdict(count(n).__next__)
        self.lengths, self.ids = [np.ones(n, np.int64)], [self.first_ids]

    def cut(self, text: str) -> list[str]:
        """Ordinary text and added tokens in turn."""
        return self.cut_at.split(text) if any(n in text for n in self.added) else [text]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; words not met before are encoded by the library's model, as the library does after splitting."""
        before = len(self.index)
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := list(islice(reversed(self.index), len(self.index) - before)):
            tokens = self.tokenizer.model.tokenize
            coded = [[t.id for t in tokens(w.encode().decode("latin-1").translate(self.letters))] for w in reversed(new)]
            self.lengths.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            self.ids.append(np.fromiter(chain.from_iterable(coded), np.uint32))
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths by number, and all ids."""
        self.lengths, self.ids = [np.concatenate(self.lengths)], [np.concatenate(self.ids)]
        return self.lengths[0], self.ids[0]


def held_words(path: str) -> WordIds:
    """The worker's words of a tokenizer, emptied once they are many."""
    held = _HELD.get(path) or _HELD.setdefault(path, WordIds(path))
    if len(held.index) > KNOWN_WORDS:
        held.clear()
    return held


def encode_texts(texts: list[str], held: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one behind the other, each with the end id, and how many each has."""
    pieces, marks, last = [], [], []
    for text in texts:
        for k, piece in enumerate(held.cut(text)):
            pieces.append("" if k % 2 else piece)
            marks.append(held.number_of_added[piece] if k % 2 else -1)
        marks[-1] = 0  # the end id's number; the last piece is ordinary text
        last.append(len(pieces) - 1)
    sequence, per_piece, at = [], [], 0
    while at < len(pieces):
        to, chars = at, 0
        while to < len(pieces) and (to == at or chars + len(pieces[to]) <= SPLIT_CHARS):
            chars += len(pieces[to])
            to += 1
        words, sizes = split_batch(pieces[at:to])
        sequence.append(held.numbers(words))
        per_piece.append(sizes)
        at = to
    if not pieces:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    marks = np.array(marks)
    per_piece = np.concatenate(per_piece)
    marked = marks >= 0
    picks = np.insert(np.concatenate(sequence), np.cumsum(per_piece)[marked], marks[marked])
    ids, sizes = gather(*held.arrays(), picks)
    upto = np.cumsum(sizes)[np.cumsum(per_piece + marked)[last] - 1]
    return ids, np.diff(upto, prepend=0)


SHARD_TYPES = "shard_key long, part long, shard long, n_tokens long, width int, doc_ids array<long>, ordinals array<long>, places array<long>, sizes array<long>, payload binary"
LONGS = pa.list_(pa.int64())
SHARD_ARROW = pa.schema([("shard_key", pa.int64()), ("part", pa.int64()), ("shard", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("doc_ids", LONGS), ("ordinals", LONGS), ("places", LONGS), ("sizes", LONGS), ("payload", pa.binary())])


def write_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Write the shards to the shared folder and return their table; ids take ``width`` bytes, which must hold the whole vocabulary."""
    if WordIds(tokenizer_path).size > 1 << (8 * width):
        raise ValueError(f"ids of this tokenizer need more than {width} bytes")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        part, number = TaskContext.get().partitionId(), count()
        doc_ids, ordinals, sizes, payload, tokens, last, nth = [], [], [], [], 0, object(), 0

        def flush():
            shard, n = next(number), np.concatenate(sizes)
            row = [[(part << 32) + shard], [part], [shard], [tokens], [width], [doc_ids], [ordinals], [np.cumsum(n) - n], [n], [b"".join(payload)]]
            return pa.record_batch([pa.array(v, type=f.type) for v, f in zip(row, SHARD_ARROW, strict=True)], schema=SHARD_ARROW)

        for piece in slices(batches, 1, 4 << 20):
            ids, n = encode_texts([t or "" for t in piece.column(1).to_pylist()], held_words(tokenizer_path))
            for doc_id in piece.column(0).to_pylist():
                nth = nth + 1 if doc_id == last else 0
                last = doc_id
                doc_ids.append(doc_id)
                ordinals.append(nth)
            sizes.append(n)
            payload.append(ids.astype(f"<u{width}").tobytes())
            tokens += len(ids)
            if tokens >= SHARD_TOKENS:
                yield flush()
                doc_ids, ordinals, sizes, payload, tokens = [], [], [], [], 0
        if doc_ids:
            yield flush()

    # bucketed, so that those who ask for places meet the payloads where they are
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return materialize_bucketed(ordered.mapInArrow(run, SHARD_TYPES), "shard_key", int(min(20_000, max(24, total // (4 * SHARD_TOKENS)))), "shards")


def key_hash(doc_id, ordinal):
    """The 64-bit key of the k-th row of a doc_id. The hash of one number is a bijection, so first rows of different ids never share a key."""
    return F.when(doc_id.isNotNull() & (ordinal == 0), F.xxhash64(doc_id)).otherwise(F.xxhash64(F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), ordinal))


def entries(shards: DataFrame) -> DataFrame:
    """doc_id, ordinal, shard_key, place (offset in the shard) and n of every document of the shards."""
    return shards.select("shard_key", F.explode(F.arrays_zip("doc_ids", "ordinals", "places", "sizes")).alias("z")).select(F.col("z.doc_ids").alias("doc_id"), F.col("z.ordinals").alias("ordinal"), "shard_key", F.col("z.places").alias("place"), F.col("z.sizes").alias("n"))


INDEX_TYPES = "bin long, level_sizes array<long>, levels array<binary>, fingerprints binary, shard_keys binary, places binary, sizes binary, clashes array<struct<doc_id: long, ordinal: long, shard_key: long, place: long, n: long>>"
ENTRY = ("doc_id", "ordinal", "shard_key", "place", "n")
CLASHES = pa.list_(pa.struct([(c, pa.int64()) for c in ENTRY]))


def write_index(shards: DataFrame) -> DataFrame:
    """Write the index of the shards' documents to the shared folder and return its table. Documents that share a key, of which there are few if any, are listed by name beside it."""
    bins = max(1, -(-shards.agg(F.coalesce(F.sum(F.size("doc_ids").cast("long")), F.lit(0))).first()[0] // KEYS_PER_PART))
    keyed = entries(shards).withColumn("key", key_hash(F.col("doc_id"), F.col("ordinal"))).withColumn("bin", F.pmod("key", F.lit(bins)))

    def build(table: pa.Table) -> pa.Table:
        number = table.column("bin")[0].as_py()
        keys = table.column("key").to_numpy().view(np.uint64)
        _, at, many = np.unique(keys, return_inverse=True, return_counts=True)
        shared = many[at] > 1
        clashes = table.select(ENTRY).filter(pa.array(shared)).to_pylist() if shared.any() else []
        table, keys = table.filter(pa.array(~shared)) if clashes else table, keys[~shared]
        perfect = PerfectHash.build(keys)
        order = np.argsort(perfect.slots(keys))
        sizes, levels = perfect.dump()
        column = lambda name: pa.array([table.column(name).to_numpy()[order].astype("<i8").tobytes()], pa.binary())
        prints = (mix(keys[order], 99) >> np.uint64(32)).astype("<u4").tobytes()
        return pa.table({"bin": pa.array([number], pa.int64()), "level_sizes": pa.array([sizes], pa.list_(pa.int64())), "levels": pa.array([levels], pa.list_(pa.binary())), "fingerprints": pa.array([prints], pa.binary()), "shard_keys": column("shard_key"), "places": column("place"), "sizes": column("n"), "clashes": pa.array([clashes], CLASHES)})

    return materialize(keyed.select("bin", "key", *ENTRY).groupBy("bin").applyInArrow(build, INDEX_TYPES), "index").withColumn("bins", F.lit(bins))


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, ordinal) with their shard_key, place and n; keys that the index doesn't hold are left out, but for one in some 4 billion."""
    first = index.select("bins").first()
    bins = first["bins"] if first else 1
    keyed = keys.select("doc_id", "ordinal", key_hash(F.col("doc_id"), F.col("ordinal")).alias("key")).withColumn("bin", F.pmod("key", F.lit(bins)))
    out = pa.schema([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("shard_key", pa.int64()), ("place", pa.int64()), ("n", pa.int64())])

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        row = right.slice(0, 1).to_pylist()[0]
        perfect = PerfectHash.load(row["level_sizes"], row["levels"])
        asked = left.column("key").to_numpy().view(np.uint64)
        slot = perfect.slots(asked)
        prints = np.frombuffer(row["fingerprints"], "<u4")
        good = slot >= 0
        good[good] = prints[slot[good]] == (mix(asked[good], 99) >> np.uint64(32)).astype(np.uint32)
        slot = slot[good]
        found = {c: np.frombuffer(row[name], "<i8")[slot] for c, name in (("shard_key", "shard_keys"), ("place", "places"), ("n", "sizes"))}
        kept = left.filter(pa.array(good))
        table = pa.table({"doc_id": kept.column("doc_id"), "ordinal": kept.column("ordinal"), **found}, schema=out)
        if not row["clashes"]:
            return table
        named = {(e["doc_id"], e["ordinal"]): e for e in row["clashes"]}
        rest = [named[k] for k in zip(left.column("doc_id").to_pylist(), left.column("ordinal").to_pylist(), strict=True) if k in named]
        return pa.concat_tables([table, pa.Table.from_pylist(rest, out)])

    return keyed.groupBy("bin").cogroup(index.drop("bins").groupBy("bin")).applyInArrow(find, "doc_id long, ordinal long, shard_key long, place long, n long")


def read_places(shards: DataFrame, found: DataFrame, value, types: str, arrow: pa.Schema) -> DataFrame:
    """``found`` (doc_id, ordinal, shard_key, place, n) with ``value`` of the ids at each place: each shard is met by all who ask for it."""
    schema = pa.schema([*(pa.field(c, pa.int64()) for c in ("doc_id", "ordinal", "shard_key", "place", "n")), *arrow])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids = np.frombuffer(right.column("payload")[0].as_buffer(), f"<u{right.column('width')[0].as_py()}")
        place, n = left.column("place").to_numpy(), left.column("n").to_numpy()
        got = pa.array([value(ids[a : a + k]) for a, k in zip(place.tolist(), n.tolist(), strict=True)], arrow[0].type)
        return pa.table([*left.select(schema.names[:-1]).columns, got], schema=schema)

    payloads = shards.select("shard_key", "width", "payload")
    return found.groupBy("shard_key").cogroup(payloads.groupBy("shard_key")).applyInArrow(cut, f"doc_id long, ordinal long, shard_key long, place long, n long, {types}")


def fetch(shards: DataFrame, index: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, ordinal and ``ids`` (with the end id) of the documents asked for by ``keys`` (doc_id, ordinal), read at their places."""
    found = lookup(index, keys)
    # shards that no key asks for are not read
    wanted = shards.join(found.select("shard_key").distinct(), "shard_key", "left_semi")
    return read_places(wanted, found, lambda ids: ids.astype(np.int64), "ids array<long>", pa.schema([("ids", LONGS)])).select("doc_id", "ordinal", "ids")


def shard_starts(shards: DataFrame) -> DataFrame:
    """shard_key, and the number of ids in all shards before it: sums of parts first, then inside each part."""
    each = shards.select("shard_key", "part", "shard", F.col("n_tokens").alias("n"))
    parts = each.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each task that wrote shards
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")
    return each.withColumn("inside", inside).join(before, "part").select("shard_key", (F.col("before") + F.col("inside")).alias("shard_start"))


def store(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write shards and index; return both tables."""
    shards = write_shards(docs, tokenizer_path, id_col, text_col)
    return shards, write_index(shards)


def read_all(shards: DataFrame, index: DataFrame) -> DataFrame:
    """Every document by a lookup of its key and a read at its place: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit little-endian ids)."""
    found = lookup(index, entries(shards).select("doc_id", "ordinal"))
    read = read_places(shards, found, lambda ids: zlib.crc32(ids.astype("<u4")), "ids_crc32 long", pa.schema([("ids_crc32", pa.int64())]))
    return read.join(shard_starts(shards), "shard_key").select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
