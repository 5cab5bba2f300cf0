"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Equal fingerprints are merged first, so a group of copies is one fingerprint. The distinct ones are cut into tiles of
bounded size, each of fingerprints with the same number of set bits. Two fingerprints within the radius differ in that
number by no more than the radius, so only tiles with near counts meet; inside a meeting the same bound over the
counts of the eight bytes skips pairs of sub-tiles. What is left is compared with exclusive-or and bit counts.

A meeting returns for each fingerprint the smallest one that it is linked to through pairs of that meeting: links
between all of a group's members are never listed, yet the components stay the same.

Work grows with the square of the number of distinct fingerprints, lessened by the bounds.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; texts
with fewer words than a shingle have one shingle of all words. Repeated rows share a component. A null doc_id stays in
its component, whose id is the smallest doc_id that isn't null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import materialize
from .batches import bytes_of, map_slices, slices

#: Shingles whose bits are counted at once, to bound memory on long texts.
CHUNK = 1 << 16
#: Most fingerprints of a tile, and of a sub-tile inside a meeting.
TILE, SUBTILE = 16384, 256
#: Most partitions that meetings of tiles are dealt to; few bytes make much work, so their number does not follow the bytes.
MEETING_PARTITIONS = 2000


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()  # bytes: only A-Z change; splits at x20 and x09-x0D
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    return [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in zip(*(words[k:] for k in range(size)), strict=False)]


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is set if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(texts: list[bytes], size: int = 4) -> list[int]:
    """SimHash of each text: a bit is set if it is set in over half of the shingles' hashes."""
    return [majority(np.array(shingle_hashes(text, size), np.uint64)) for text in texts]


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """doc_id and its fingerprint, a long that holds the 64 bits."""
    arrow = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(part):
        return {"doc_id": part.column(0), "fp": np.array(fingerprints(bytes_of(part, 1), size), np.uint64).view(np.int64)}

    return map_slices(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, "doc_id long, fp long", arrow, 1)


def byte_counts(fp: np.ndarray) -> np.ndarray:
    """Set bits of each of the eight bytes."""
    return np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int16)


def linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) of links; with b None each pair within a once.

    Both sides are ordered by the counts of their bytes, cut into sub-tiles and compared only where the least
    distance between the sub-tiles' ranges of counts lies within the radius.
    """
    same = b is None
    b = a if same else b
    sides = []
    for x in (a, b):
        counts = byte_counts(x)
        order = np.lexsort(counts.T[::-1])
        cuts = np.arange(0, len(x), SUBTILE)
        low = np.minimum.reduceat(counts[order], cuts, axis=0)
        high = np.maximum.reduceat(counts[order], cuts, axis=0)
        sides.append((x[order], order, low, high))
    (xa, oa, la, ha), (xb, ob, lb, hb) = sides
    left, right = [], []
    for i in range(len(la)):
        gap = np.maximum(0, np.maximum(la[i] - hb, lb - ha[i])).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            p, q = xa[i * SUBTILE : (i + 1) * SUBTILE], xb[j * SUBTILE : (j + 1) * SUBTILE]
            u, v = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= radius)
            if same and i == j:
                u, v = u[u < v], v[u < v]
            left.append(oa[u + i * SUBTILE])
            right.append(ob[v + j * SUBTILE])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def least_linked(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index in its component."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def star(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest fingerprint of its component) of one meeting of tiles."""
    both = np.sort(a) if b is None else np.sort(np.concatenate([a, b]))
    u, v = linked(a, b, radius)
    x, y = np.searchsorted(both, a[u]), np.searchsorted(both, (a if b is None else b)[v])
    label = least_linked(len(both), x, y)
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints that give the components of all pairs within the radius."""
    spark = fps.sparkSession
    counts = F.bit_count("fp")
    # 65 rows at most: how many tiles each number of set bits needs
    sizes = {r["ones"]: -(-r["n"] // tile) for r in fps.groupBy(counts.alias("ones")).agg(F.count("*").alias("n")).collect()}
    tiles = [(ones, k) for ones, n in sorted(sizes.items()) for k in range(n)]
    number = {t: k for k, t in enumerate(tiles)}
    if not tiles:
        return spark.createDataFrame([], "src long, dst long")
    first = F.create_map(*[F.lit(x) for ones in sorted(sizes) for x in (ones, number[ones, 0])])
    some = F.create_map(*[F.lit(x) for ones, n in sorted(sizes.items()) for x in (ones, n)])
    at = fps.select("fp", counts.alias("ones")).select("fp", "ones", (F.element_at(first, F.col("ones")) + F.pmod(F.xxhash64("fp"), F.element_at(some, F.col("ones")))).cast("int").alias("tile"))
    # the tiles that a tile meets are a range: those whose number of set bits is at most the radius away
    reach = {}
    for ones in sizes:
        near = [number[o, k] for o, n in sizes.items() if abs(o - ones) <= radius for k in range(n)]
        reach[ones] = (min(near), max(near))
    low = F.create_map(*[F.lit(x) for ones in sorted(sizes) for x in (ones, reach[ones][0])])
    high = F.create_map(*[F.lit(x) for ones in sorted(sizes) for x in (ones, reach[ones][1])])
    held = at.groupBy("tile", "ones").agg(F.collect_list("fp").alias("fps"))  # about ``tile`` fingerprints, as the numbers of tiles follow the counts
    met = held.select("tile", "fps", F.explode(F.sequence(F.element_at(low, F.col("ones")), F.element_at(high, F.col("ones")))).alias("other"))
    met = met.select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") <= F.col("other")).alias("of_a"), "fps")

    def compare(table: pa.Table) -> pa.Table:
        sides = {own: fps.values.to_numpy().view(np.uint64) for own, fps in zip(table.column("of_a").to_pylist(), table.column("fps"), strict=True)}
        src, dst = star(sides[True], sides.get(False), radius)
        return pa.table({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    meetings = sum(sizes[o] * (reach[o][1] - reach[o][0] + 1) for o in sizes) // 2 + 1
    return met.repartition(min(MEETING_PARTITIONS, meetings), "a", "b").groupBy("a", "b").applyInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, size: int = 4, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, ``fp`` (long) and ``component_id``, the smallest doc_id reachable through links."""
    rows = materialize(with_fingerprints(docs, id_col, text_col, size), "fingerprints")
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = materialize(links(least.select("fp"), radius, tile), "links")
    parts = connected_components(edges.select("src", "dst"))  # node, component: a fingerprint
    known = least.join(parts, least["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(known.join(roots, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, size: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each near-duplicate group: the row with the smallest id stays.

    Rows that share that id are one document and stay together; a group without any id stays whole.
    """
    rows = near_duplicates(docs, id_col, text_col, radius, size)
    keep = rows.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["__keep"]), "left_semi")
