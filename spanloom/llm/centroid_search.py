"""Centroid clustering of integer vectors, exact at every round, by Shallot search.

Components become integers, and whatever is compared in the end is compared in integers; floating-point bounds, widened by
more than their rounding can err, only decide what need not be looked at. Each vector remembers its centroid, the
second-nearest one, an upper bound of the distance to the first and a lower bound of the distance to all others. After
a round the bounds are moved by as much as the centroids moved. A vector whose upper bound is below the lower one, or
below half the way from its centroid to the next, keeps its centroid unseen. Any other starts from the closer of its two
remembered centroids and walks that one's neighbours in ascending order of their distance from it, only while they lie in
the ball of (own distance + distance of the second-nearest so far), which shrinks as nearer ones are found.

Vectors are written once, packed in blocks and bucketed by block; a round's state (four numbers a vector, and each
block's sums) is a small table of its own, so a round moves no vectors. Sums of a round are added up by Spark; the driver
holds centroids alone, whose number is a parameter.

Defined cases: a vector is kept if it has exactly ``dims`` components, none null, NaN or infinite (also not when multiplied
by the scale). Repeated rows are vectors of their own. Rows with one vec_id start in the order of their vectors; a null
vec_id hashes as the empty text. With fewer kept vectors than ``k`` there are as many centroids as vectors; an empty table
gives an empty result. Integers of any size below 2^500 are exact; distances and inertias of 2^63 and more are null.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, materialize_bucketed

#: Vectors of a block, and blocks of a bucket of the table.
BLOCK, BUCKET_BLOCKS = 1024, 48
#: Integers up to this size are compared as 64-bit integers, larger ones as Python's.
NARROW = 1 << 26
#: Factors that outweigh any rounding of a bound.
UP, DOWN = 1 + 1e-9, 1 - 1e-9
#: Bits of the limbs in which sums travel.
LIMB = 40
SUM = "array<struct<place: int, limb: int, value: bigint>>"
STATE = f"block bigint, cluster binary, second binary, upper binary, lower binary, sums {SUM}"
STATE_ARROW = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("cluster", "second", "upper", "lower")], ("sums", pa.list_(pa.struct([("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])))])


def kept(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors that count, v as doubles."""
    v = F.transform(vectors[vec_col], lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    return rows.where(F.coalesce((F.size("v") == dims) & finite, F.lit(False)))


def narrow(v: np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit integers, or as Python's where they are large."""
    if not v.size or np.abs(v).max() <= NARROW:
        return v.astype(np.int64)
    return np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)


def packed(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """Blocks of vectors: block, ids and the integers' bytes, in the narrowest of three types."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), counter()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False) * float(scale))
                most = np.abs(v).max()
                kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
                yield pa.record_batch([pa.array([(task << 32) + next(number)]), pa.array([part.column(0).to_pylist()], schema.field(1).type), pa.array([v.astype(kind).tobytes()]), pa.array([kind])], schema=schema)

    return rows.mapInArrow(run, "block bigint, ids array<bigint>, vectors binary, kind string")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = a - b
    return (d * d).sum(axis=-1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Geometry:
    """The centroids of a round, each one's neighbours by distance, and lower bounds of those distances."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray):
        k = len(centroids)
        self.centroids = centroids
        gaps = np.array([root(squared(centroids, c)) for c in centroids]) * DOWN
        np.fill_diagonal(gaps, -1.0)  # a centroid is its own first neighbour
        self.order = np.argsort(gaps, axis=1, kind="stable").astype(np.int32)
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.half = self.gaps[:, 1] / 2 if k > 1 else np.array([np.inf])
        self.moved = moved
        # how far the others moved at most, for each centroid
        far = np.argsort(moved)[::-1]
        self.others = np.full(k, moved[far[0]])
        self.others[far[0]] = moved[far[1]] if k > 1 else 0.0


def search(v: np.ndarray, a: np.ndarray, s: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second-nearest centroid of vectors, from those remembered: cluster, second and both squared distances."""
    k = len(g.centroids)
    da, ds = squared(v, g.centroids[a]), squared(v, g.centroids[s])
    swap = (ds < da) | ((ds == da) & (s < a))
    start, other = np.where(swap, s, a), np.where(swap, a, s)
    d1, d2 = np.where(swap, ds, da), np.where(swap, da, ds)
    own, best, second = root(d1) * UP, start.copy(), other.copy()
    live = np.arange(len(v))
    for rank in range(1, k):
        live = live[g.gaps[start[live], rank] <= own[live] + root(d2[live]) * UP]
        if not len(live):
            break
        c = g.order[start[live], rank]
        new = c != other[live]
        at, c = live[new], c[new]
        d = squared(v[at], g.centroids[c])
        first = (d < d1[at]) | ((d == d1[at]) & (c < best[at]))
        x = at[first]
        d2[x], second[x] = d1[x], best[x]
        d1[x], best[x] = d[first], c[first]
        y = ~first & ((d < d2[at]) | ((d == d2[at]) & (c < second[at])))
        x = at[y]
        d2[x], second[x] = d[y], c[y]
    return best, second, d1, d2


def step(v: np.ndarray, a: np.ndarray, s: np.ndarray, u: np.ndarray, low: np.ndarray, g: Geometry) -> None:
    """One assignment of a block; the state changes in place."""
    if len(g.centroids) == 1:
        return
    u += g.moved[a]
    u *= UP
    low -= g.others[a]
    low *= DOWN
    np.maximum(low, 0.0, out=low)
    safe = np.maximum(low, g.half[a])
    look = np.flatnonzero(~(u < safe))
    if len(look):
        u[look] = root(squared(v[look], g.centroids[a[look]])) * UP
        look = look[~(u[look] < safe[look])]
    if len(look):
        a[look], s[look], d1, d2 = search(v[look], a[look], s[look], g)
        u[look], low[look] = root(d1) * UP, root(d2) * DOWN


def limbs(totals: np.ndarray) -> list[dict]:
    """Non-zero sums by place, in limbs that a long holds however many are added up."""
    out = []
    for place, value in enumerate(totals.ravel().tolist()):
        sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
        while value:
            if value & ((1 << LIMB) - 1):
                out.append({"place": place, "limb": k, "value": sign * (value & ((1 << LIMB) - 1))})
            value >>= LIMB
            k += 1
    return out


def block_sums(v: np.ndarray, a: np.ndarray, d: np.ndarray | None, k: int) -> list[dict]:
    """Of each cluster the sums of all components, the number of vectors and the sum of distances."""
    totals = np.zeros((k, v.shape[1] + 2), object)
    for c in np.unique(a):
        mine = a == c
        totals[c] = [*v[mine].sum(axis=0).tolist(), int(mine.sum()), 0 if d is None else sum(d[mine].tolist())]
    return limbs(totals)


def added_up(state: DataFrame, k: int, width: int) -> list[list[int]]:
    """The blocks' sums in all: k rows of ``width`` numbers."""
    parts = state.select(F.explode("sums").alias("s")).groupBy("s.place", "s.limb").agg(F.sum(F.col("s.value").cast("decimal(38,0)")).alias("value"))
    out = [[0] * width for _ in range(k)]
    for r in parts.collect():  # k * width places, some limbs each
        out[r["place"] // width][r["place"] % width] += int(r["value"]) << (LIMB * r["limb"])
    return out


def unpack(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    """Of each block its number, ids if read, vectors and state (None in the first round)."""
    for r in batch.to_pylist():
        v = narrow(np.frombuffer(r["vectors"], r["kind"]).reshape(-1, dims))
        state = None if r.get("cluster") is None else tuple(np.frombuffer(r[c], t).copy() for c, t in (("cluster", "<i4"), ("second", "<i4"), ("upper", "<f8"), ("lower", "<f8")))
        yield r["block"], r.get("ids"), v, state


def unseen(n: int, k: int) -> tuple:
    """The state of vectors that no round has looked at."""
    return np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n)


def assigned(blocks: DataFrame, state: DataFrame | None, g: Geometry, dims: int) -> DataFrame:
    """The state after one assignment to the centroids, with each block's sums."""
    rows = blocks.drop("ids") if state is None else blocks.drop("ids").join(state.drop("sums"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, v, now in unpack(batch, dims):
                k = len(g.centroids)
                a, s, u, low = now or unseen(len(v), k)
                step(v, a, s, u, low, g)
                yield pa.RecordBatch.from_pylist([{"block": block, "cluster": a.tobytes(), "second": s.tobytes(), "upper": u.tobytes(), "lower": low.tobytes(), "sums": block_sums(v, a, None, k)}], STATE_ARROW)

    return rows.mapInArrow(run, STATE)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024, seed: str = "3") -> tuple[DataFrame, list[dict]]:
    """The vectors' clusters (vec_id, cluster, distance as a string of digits) and the final centroids.

    A centroid has ``cluster``, ``components``, ``size`` and ``inertia``. All integers are exact.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, id_col, vec_col, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance string"), []
    centroids = narrow(np.floor(np.array([r["v"] for r in first], np.float64) * float(scale)))
    k, n = len(first), rows.count()
    buckets = max(8, -(-n // (BLOCK * BUCKET_BLOCKS)))
    blocks = materialize_bucketed(packed(rows, dims, scale).repartition(buckets, "block"), "block", buckets, "vectors")
    state, moved = None, np.zeros(k)
    for _ in range(rounds):
        state = materialize(assigned(blocks, state, Geometry(centroids, moved), dims), "state")
        sums = added_up(state, k, dims + 2)
        new = np.array([[x // t[dims] for x in t[:dims]] if t[dims] else c.tolist() for t, c in zip(sums, centroids, strict=True)], object)
        small = max(abs(x) for x in new.ravel()) <= NARROW
        new = new.astype(np.int64) if small else new
        moved = root(squared(new, centroids)) * UP
        centroids = new
        if not moved.any():  # the rounds left would find the same
            break
    g = Geometry(centroids, moved)
    arrow = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.string())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, v, now in unpack(batch, dims):
                a, s, u, low = now or unseen(len(v), k)
                step(v, a, s, u, low, g)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(a), pa.array([str(d) for d in squared(v, g.centroids[a]).tolist()])], schema=arrow)

    last = blocks if state is None else blocks.join(state.drop("sums"), "block")
    found = materialize(last.mapInArrow(measure, "vec_id long, cluster int, distance string"), "clusters")
    # digits are added up as limbs of 18, so that no sum overflows
    tail, head = F.substring("distance", -18, 18).cast("decimal(38,0)"), F.expr("cast(nullif(substr(distance, 1, length(distance) - 18), '') as decimal(38,0))")
    sizes = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(tail).alias("tail"), F.sum(F.when(F.length("distance") > 18, head)).alias("head")).collect()}
    inertia = lambda c: int(sizes[c]["tail"]) + 10**18 * int(sizes[c]["head"] or 0) if c in sizes else 0
    return found, [{"cluster": c, "components": row, "size": sizes[c]["n"] if c in sizes else 0, "inertia": inertia(c)} for c, row in enumerate(centroids.tolist())]


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    found, centroids = cluster(vectors, **options)
    fits = lambda x: x if x < 1 << 63 else None
    total = sum(c["inertia"] for c in centroids)
    about = [(c["cluster"], fits(c["inertia"]), fits(total), hashlib.sha256(",".join(map(str, c["components"])).encode()).hexdigest()) for c in centroids]
    table = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select("vec_id", "cluster", F.expr("try_cast(distance as bigint)").alias("distance")).join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
