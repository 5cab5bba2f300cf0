"""Removal of long repeated byte strings by prefix-free parsing.

Texts are parsed at triggers: in every window of ``length`` bytes the smallest rolling hash of eight bytes (the last
of equal ones) is the window's trigger, so equal windows have their trigger at the same place and no window is without
one. All windows of one trigger make a phrase with its surroundings; cut once more by the trigger's distance, each
such unit is a run of window starts together with the bytes that they cover.

The units settle most of the corpus: a unit that occurs twice repeats in all its windows, and a unit whose core (the
bytes that all its windows share) occurs nowhere else repeats in none. Only units that share a core but not all bytes,
at the edges of repeats, stay open. Open units are dealt by core, and each bucket of them is put in corpus order
(``corpus_order``): the suffix array of its dictionary of phrases and that of its parse give the order of all windows,
in which neighbours whose first ``length`` bytes are equal, byte by byte, repeat.

Each slice of documents first settles what repeats inside it and sends one posting for each core, so a passage that a
third of all documents share sends no more than one posting for each slice. Postings are dealt by digest into buckets
whose number follows the input. Edges of such a passage differ from document to document though they share its core, so
a bucket may get many open units: one of more than ``OPEN_BYTES`` is dealt again window by window, by the windows' leading
bytes, to as many parts as its windows need, and windows of a part whose bytes are all equal repeat.

Defined cases: null counts as empty; texts shorter than ``length`` lose nothing. Matches never cross documents. Repeated
rows repeat each other. Further columns are not read. Cores and units are compared by 64 bits each, a unit's 64 only
among units with equal cores; windows of open units by their bytes, in buckets of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .batches import bytes_of, map_slices, slices
from .corpus_order import GRAM, repeated_windows, rolling

#: Bytes of text behind each bucket of postings.
BUCKET_BYTES = 32 << 20
#: Bytes of open units that are put in order at once.
OPEN_BYTES = 8 << 20
#: Buckets of open units for each bucket of postings, and the most partitions that they are dealt to.
FINER, MOST_PARTITIONS = 4, 20_000


def triggers(data: np.ndarray, length: int) -> np.ndarray:
    """The trigger of the window that starts at each place: the last smallest hash inside it."""
    width = length - GRAM + 1
    low = rolling(data)
    low |= np.uint64(0xFFFFFFFF) - np.arange(len(low), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(data) - length + 1
    low = np.minimum(low[:n], low[width - size : width - size + n])
    return (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)


def units(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window, number of further windows, digest of the core and of the whole, of every unit."""
    half = (length - GRAM + 2) // 2  # distances 0 to half - 1 and half to length - GRAM
    out: tuple[list, ...] = ([], [], [], [], [])
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < 1 << 20):
            size += len(texts[to])
            to += 1
        joined = b"".join(texts[at:to])
        if len(joined) >= length:
            data = np.frombuffer(joined, np.uint8)
            ends = np.cumsum([len(t) for t in texts[at:to]])
            doc = np.searchsorted(ends, np.arange(len(data) - length + 1), side="right")
            start = np.flatnonzero(np.arange(len(doc)) + length <= ends[doc])
            place = triggers(data, length)[start]
            far = place - start >= half
            doc = doc[start]
            cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (far[1:] != far[:-1]) | (doc[1:] != doc[:-1])])) if len(start) else np.zeros(0, np.int64)
            last = np.concatenate([cut[1:], [len(start)]]) - 1 if len(cut) else cut
            first, final = start[cut], start[last]
            t = place[cut]
            core_a = np.where(far[cut], t - half, t)
            core_b = np.where(far[cut], t + GRAM, t - half + 1 + length)
            core = xxhash.xxh3_64_intdigest
            out[3].append(np.fromiter((core(joined[a:b], f) for a, b, f in zip(core_a.tolist(), core_b.tolist(), far[cut].tolist(), strict=True)), np.uint64, len(cut)))
            out[4].append(np.fromiter((core(joined[a : b + length], 7) for a, b in zip(first.tolist(), final.tolist(), strict=True)), np.uint64, len(cut)))
            begins = ends - [len(t) for t in texts[at:to]]
            out[0].append(doc[cut] + at)
            out[1].append(first - begins[doc[cut]])
            out[2].append(final - first)
        at = to
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64 if k > 2 else np.int64) for k, x in enumerate(out))


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, and where in it another value of all keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def settle(core: np.ndarray, whole: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices of units that repeat as a whole, of those to be ordered by windows, of one unit for each core, and whether that core is mixed.

    A core is mixed if units with different bytes have it, here or, by the flag given, elsewhere.
    """
    order, new = runs(core, whole)
    new_core = np.zeros(len(order), bool)
    new_core[:1] = True
    new_core[1:] = core[order][1:] != core[order][:-1]
    run = np.cumsum(new) - 1
    group = np.cumsum(new_core) - 1
    size = np.bincount(run)
    kinds = np.bincount(group[new]) if len(order) else np.zeros(0, np.int64)
    is_mixed = (kinds > 1) | (np.bincount(group, weights=mixed[order]) > 0 if len(order) else False)
    return order[size[run] > 1], order[new & is_mixed[group]] if len(order) else order, order[new_core], is_mixed


POST = "bucket int, posted binary, told binary"
POST_ARROW = pa.schema([("bucket", pa.int32()), ("posted", pa.binary()), ("told", pa.binary())])
UNIT = np.dtype([("core", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("size", "<u4"), ("first", "<u4"), ("more", "<u2"), ("mixed", "u1")])
#: What is known of a unit: its document (text hash and size), its windows, and whether it repeats as a whole or is to be ordered.
TOLD = np.dtype([("doc", "<i8"), ("size", "<u4"), ("first", "<u4"), ("more", "<u4"), ("repeats", "u1")])
#: A range of windows as it is written; its eight bytes as one number sort by ``first``.
RANGE = np.dtype([("more", "<u4"), ("first", "<u4")])
#: Bytes of windows dealt one by one that meet in a part, bytes of units whose windows are cut at once, and leading bytes that deal them.
PART_BYTES, CUT_BYTES, LEAD = 32 << 20, 1 << 18, 16


def tell(rows: np.ndarray, repeats: bool) -> np.ndarray:
    out = np.empty(len(rows), TOLD)
    for name in ("doc", "size", "first"):
        out[name] = rows[name]
    out["more"] = rows["more"] if "more" in rows.dtype.names else 0
    out["repeats"] = repeats
    return out


def by_bucket(posted: np.ndarray, key: str, told: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket that gets postings; what is told already goes along with some bucket."""
    to = (posted[key] >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    used, starts = np.unique(to[order], return_index=True)
    cuts = [*starts.tolist(), len(order)]
    share = np.array_split(told, max(1, len(used)))
    if not len(used):
        used, cuts = np.zeros(1, np.uint64), [0, 0]
    posted = posted[order]
    return pa.record_batch([pa.array(used.astype(np.int32)), pa.array([posted[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), pa.array([s.tobytes() for s in share], pa.binary())], schema=POST_ARROW)


TOLD_TYPES = "doc long, size int, repeats boolean, ranges binary"


def as_table(told: np.ndarray) -> pa.Table:
    """One row for each text and verdict with its ranges packed, each range once."""
    order, new = runs(told["doc"], told["size"], told["repeats"], told["first"], told["more"])
    told = told[order[new]]
    packed = np.empty(len(told), RANGE)
    packed["more"], packed["first"] = told["more"], told["first"]
    change = np.ones(len(told), bool)
    change[1:] = (told["doc"][1:] != told["doc"][:-1]) | (told["size"][1:] != told["size"][:-1]) | (told["repeats"][1:] != told["repeats"][:-1])
    at = np.flatnonzero(change)
    ranges = pa.array([packed[a:b].tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(told)], strict=False)], pa.binary())
    return pa.table({"doc": told["doc"][at], "size": told["size"][at].astype(np.int32), "repeats": told["repeats"][at].astype(bool), "ranges": ranges})


def ranges_of(parts: list[bytes] | None) -> np.ndarray:
    """Packed ranges in order, each once."""
    return np.unique(np.frombuffer(b"".join(parts or ()), "<u8")).view(RANGE)


def joined(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def unit_verdicts(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Which units repeat as a whole and which are to be ordered by windows; ``texts`` has text, doc (its hash) and size."""

    def post(batches):
        for part in slices(batches, 0, 8 << 20):
            docs, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
            doc, first, more, core, whole = units(bytes_of(part, 0), length)
            rows = np.zeros(len(doc), UNIT)
            rows["core"], rows["whole"], rows["doc"], rows["size"], rows["first"], rows["more"] = core, whole, docs[doc], sizes[doc], first, more
            repeats, open_units, one, is_mixed = settle(core, whole, rows["mixed"])
            sent = rows[one]
            sent["mixed"] = is_mixed
            yield by_bucket(sent, "core", np.concatenate([tell(rows[repeats], True), tell(rows[open_units], False)]), buckets)

    def meet(table: pa.Table) -> pa.Table:
        rows = joined(table.column("posted"), UNIT)
        repeats, open_units, _, _ = settle(rows["core"], rows["whole"], rows["mixed"])
        return as_table(np.concatenate([tell(rows[repeats], True), tell(rows[open_units], False), joined(table.column("told"), TOLD)]))

    return texts.select("text", "doc", "size").mapInArrow(post, POST).groupBy("bucket").applyInArrow(meet, TOLD_TYPES)


def spans_of(doc: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Single windows, in order of document and place, as told ranges of adjoining ones."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (size[1:] != size[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    out = np.zeros(len(at), TOLD)
    out["doc"], out["size"], out["first"], out["repeats"] = doc[at], size[at], first[at], 1
    out["more"] = np.diff([*at, len(doc)]) - 1
    return out


def window_row(docs: np.ndarray, sizes: np.ndarray, of: np.ndarray, first: np.ndarray, windows: list[bytes], zipper: zstandard.ZstdCompressor) -> bytes:
    """The windows of a slice that go to one part, by columns, with the documents that they are of and their bytes."""
    used, of = np.unique(of, return_inverse=True)
    head = np.array([len(used), len(of)], "<u4").tobytes()
    return head + docs[used].astype("<i8").tobytes() + sizes[used].astype("<u4").tobytes() + np.diff(of, prepend=0).astype("<i4").tobytes() + np.diff(first, prepend=0).astype("<i4").tobytes() + zipper.compress(b"".join(windows))


def window_columns(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """doc, size, first and bytes of every window of a row."""
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    of = np.cumsum(np.frombuffer(data, "<i4", m, 8 + 12 * n))
    first = np.cumsum(np.frombuffer(data, "<i4", m, 8 + 12 * n + 4 * m))
    joined = unzipped(data[8 + 12 * n + 8 * m :])
    return np.frombuffer(data, "<i8", n, 8)[of], np.frombuffer(data, "<u4", n, 8 + 8 * n)[of], first, [joined[k : k + length] for k in range(0, len(joined), length)]


OPEN = np.dtype([("doc", "<i8"), ("size", "<u4"), ("first", "<u4"), ("more", "<u4")])
OPEN_POST = "bucket int, bytes long, head binary, units binary, told binary"
OPEN_ARROW = pa.schema([("bucket", pa.int32()), ("bytes", pa.int64()), ("head", pa.binary()), ("units", pa.binary()), ("told", pa.binary())])


def core_digests(strings: list[bytes], length: int) -> np.ndarray:
    """The digest of each unit's core, found from the unit's bytes: its first window has the trigger of all."""
    heads = np.frombuffer(b"".join(s[:length] for s in strings) + bytes(GRAM - 1), np.uint8)
    hashes = rolling(heads).reshape(-1, length)[:, : length - GRAM + 1]
    trigger = (length - GRAM) - np.argmin(hashes[:, ::-1], axis=1)
    half = (length - GRAM + 2) // 2
    core = xxhash.xxh3_64_intdigest
    return np.fromiter((core(s[t - half : t + GRAM] if t >= half else s[t : t - half + 1 + length], t >= half) for s, t in zip(strings, trigger.tolist(), strict=True)), np.uint64, len(strings))


def told_by_unit(rows: np.ndarray, again: np.ndarray) -> np.ndarray:
    """The flagged windows of the units, which follow each other, as told ranges."""
    count = rows["more"].astype(np.int64) + 1
    of = np.repeat(np.arange(len(rows)), count)[again]
    first = (np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count))[again] + rows["first"][of]
    return spans_of(rows["doc"][of], rows["size"][of], first)


def told_once(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which strings are the first of their bytes, and which have bytes that another has too."""
    place: dict[bytes, int] = {}
    of = np.fromiter((place.setdefault(s, k) for k, s in enumerate(strings)), np.int64, len(strings))
    return of == np.arange(len(of)), np.bincount(of, minlength=len(of))[of] > 1


def window_verdicts(texts: DataFrame, open_units: DataFrame, length: int, buckets: int, open_bytes: int) -> DataFrame:
    """The windows of open units that occur twice among them."""
    # written, so that the join has a plain shuffle on both sides, whose large groups of equal texts Spark can split
    wanted = materialize(open_units.groupBy("doc", "size").agg(F.collect_set("ranges").alias("units")), "wanted")

    def post(batches):
        zipper = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, 0, 4 << 20):
            docs, sizes = part.column(1).to_pylist(), part.column(2).to_pylist()
            strings, rows = [], []
            for data, doc, size, found in zip(part.column(0).to_pylist(), docs, sizes, part.column(3).to_pylist(), strict=True):
                text = unzipped(data)
                for more, first in ranges_of(found).tolist():
                    strings.append(text[first : first + more + length])
                    rows.append((doc, size, first, more))
            rows = np.array(rows, OPEN)
            # equal units repeat; one of them is sent
            one, again = told_once(strings)
            told = tell(rows[again], True)
            rows, strings = rows[one], [s for s, x in zip(strings, one.tolist(), strict=True) if x]
            to = (core_digests(strings, length) >> np.uint64(20)) % np.uint64(FINER * buckets)
            order = np.argsort(to, kind="stable")
            used, starts = np.unique(to[order], return_index=True)
            groups = np.split(order, starts[1:]) if len(used) else [order]
            share = np.array_split(told, len(groups))
            joined_units = [b"".join([strings[i] for i in g.tolist()]) for g in groups]
            columns = [used.astype(np.int32) if len(used) else np.zeros(1, np.int32), [len(u) for u in joined_units], [rows[g].tobytes() for g in groups], [zipper.compress(u) if u else b"" for u in joined_units], [x.tobytes() for x in share]]
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, OPEN_ARROW, strict=True)], schema=OPEN_ARROW)

    def units_of(heads, packed) -> tuple[np.ndarray, list[bytes]]:
        rows = np.frombuffer(b"".join(h.as_py() for h in heads), OPEN)
        whole = b"".join(unzipped(p.as_py()) for p in packed)
        ends = np.cumsum(rows["more"].astype(np.int64) + length)
        return rows, [whole[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def put_in_order(table: pa.Table) -> pa.Table:
        rows, strings = units_of(table.column("head"), table.column("units"))
        one, again = told_once(strings)
        told = tell(rows[again], True)
        rows, strings = rows[one], [s for s, x in zip(strings, one.tolist(), strict=True) if x]
        found = repeated_windows(strings, rows["more"].astype(np.int64), length) if len(rows) > 1 else np.zeros(0, bool)
        spans = told_by_unit(rows, found) if len(found) else told[:0]
        return as_table(np.concatenate([told, spans, joined(table.column("told"), TOLD)]))

    def deal_windows(batches):
        zipper = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                rows, strings = units_of(part.column(2), part.column(3))
                told, at = joined(part.column(4), TOLD), 0
                while at < len(rows):
                    to = at + max(1, int(np.searchsorted(np.cumsum([len(s) for s in strings[at:]]), CUT_BYTES)))
                    windows = [s[i : i + length] for s in strings[at:to] for i in range(len(s) - length + 1)]
                    count = rows["more"][at:to].astype(np.int64) + 1
                    of = np.repeat(np.arange(at, min(to, len(rows))), count)
                    first = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + rows["first"][of]
                    # what repeats in this cut is known; one window of equal bytes is sent
                    one, again = told_once(windows)
                    told = np.concatenate([told, spans_of(rows["doc"][of[again]], rows["size"][of[again]], first[again])])
                    sent = np.flatnonzero(one)
                    dealt_to = np.fromiter((xxhash.xxh3_64_intdigest(windows[i][:LEAD]) % parts for i in sent.tolist()), np.int64, len(sent))
                    order = np.argsort(dealt_to, kind="stable")
                    used, starts = np.unique(dealt_to[order], return_index=True)
                    packed = [window_row(rows["doc"], rows["size"], of[i], first[i], [windows[w] for w in i.tolist()], zipper) for i in np.split(sent[order], starts[1:])]
                    share = np.array_split(told, len(packed))
                    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(packed, pa.binary()), pa.array([x.tobytes() for x in share], pa.binary())], schema=POST_ARROW)
                    told, at = told[:0], to

    def meet(table: pa.Table) -> pa.Table:
        doc, size, first, windows = zip(*(window_columns(x.as_py(), length) for x in table.column("posted")), strict=True)
        doc, size, first = map(np.concatenate, (doc, size, first))
        _, again = told_once([w for some in windows for w in some])
        return as_table(np.concatenate([spans_of(doc[again], size[again], first[again]), joined(table.column("told"), TOLD)]))

    found = texts.join(wanted, ["doc", "size"]).select("zipped", "doc", "size", "units")
    posts = materialize(found.mapInArrow(post, OPEN_POST), "open_units")
    # at most one row for each OPEN_BYTES of open units
    large = posts.groupBy("bucket").agg(F.sum("bytes").alias("all_bytes")).where(F.col("all_bytes") > open_bytes)
    # as many parts as the windows' bytes need
    parts = max(buckets, -(-int(large.agg(F.sum("all_bytes")).first()[0] or 0) * length // PART_BYTES))
    large = F.broadcast(large.select("bucket"))
    # a stated number of partitions, as adaptive coalescing goes by packed bytes and not by the work behind them
    ordered = posts.join(large, "bucket", "left_anti").repartition(min(FINER * buckets, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(put_in_order, TOLD_TYPES)
    dealt = posts.join(large, "bucket", "left_semi").select("bucket", "bytes", "head", "units", "told").mapInArrow(deal_windows, POST)
    return ordered.unionByName(dealt.groupBy("bucket").applyInArrow(meet, TOLD_TYPES))


def unzipped(data: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def with_zipped(texts: DataFrame) -> DataFrame:
    """The text column compressed, as it is to be dealt twice."""

    def run(batches):
        zipper = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, 0):
            zipped = pa.array([zipper.compress(t) if t else b"" for t in bytes_of(part, 0)], pa.binary())
            yield pa.record_batch([zipped, *part.columns[1:]], names=["zipped", *part.schema.names[1:]])

    return texts.select("text", "doc_id", "doc", "size").mapInArrow(run, "zipped binary, doc_id long, doc long, size int")


def cover(n: int, starts: list[bytes] | None, length: int) -> np.ndarray:
    """Which of n bytes lie in a window that starts in one of the packed ranges."""
    change = np.zeros(n + 1, np.int32)
    ranges = ranges_of(starts)
    np.add.at(change, ranges["first"], 1)
    np.subtract.at(change, ranges["first"] + ranges["more"] + length, 1)
    return np.cumsum(change[:n]) > 0


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, ``spans`` (byte ranges removed) and ``kept``, the remaining bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("doc"), F.octet_length(text).alias("size"))
    total = texts.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    buckets = max(24, int(total // BUCKET_BYTES))
    told = materialize(unit_verdicts(texts, length, buckets), "units")
    zipped = with_zipped(texts)
    more = materialize(window_verdicts(zipped, told.where("not repeats"), length, buckets, open_bytes), "windows")
    # the windows that repeat, as ranges of their starts; a text's hash and size stand for the text, whichever rows have it
    ranges = materialize(told.where("repeats").unionByName(more).groupBy("doc", "size").agg(F.collect_set("ranges").alias("starts")), "ranges")
    both = zipped.join(ranges, ["doc", "size"], "left").select("zipped", "doc_id", "starts")

    def run(part):
        out = {c: [] for c in REMOVED.names}
        for data, starts in zip(map(unzipped, part.column(0).to_pylist()), part.column(2).to_pylist(), strict=True):
            gone = cover(len(data), starts, length)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append([{"start": a, "end": b} for a, b in edge.tolist()])
            out["kept"].append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        return out | {"doc_id": part.column(1)}

    return map_slices(both, run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary", REMOVED, 0, 1 << 20)


