"""Near copies: SimHash candidates whose word shingles overlap enough, checked exactly.

Texts are compared as sets of five-word shingles. Texts of equal sets are merged first; each distinct set, a node, has
a fingerprint. A Jaccard similarity of at least p bounds the ratio of two sets' sizes by p, so sets are dealt into tiles
by the logarithm of their size to the base 1 / p: a tile meets its own and the next range only. Pairs within the radius
are candidates if their sketches (the ``SKETCH`` least hashes of each set, the whole set if it is no larger) share
``SKETCH_PERCENT`` of their union's least hashes. A meeting of tiles returns its candidates' components as stars, not the
pairs, so a group of copies costs its size. The components over all meetings are families.

Then the sets of nodes in families, and of no others, are dealt by family. In a family of more than ``FAMILY`` nodes all are held
against one of them first, the pivot: those that it links are one group already and don't meet each other; only the rest is
cut into parts that meet in pairs, and those of it that are near enough meet what the pivot linked. Inside a meeting each candidate pair whose ends aren't linked yet is checked on its sets,
nearest first, and only pairs that pass link them. The components of these links are the groups.

Fingerprints and sketches are approximate: a pair beyond the radius isn't checked; a pair of similarity 0.8 shares too
little of its sketches with a chance below 1 in 100,000 (35 or fewer of 64 draws). Sets are held equal by 64 bits of
digest, shingles by 64 bits of hash. Candidates of one family below the similarity are checked pair by pair.

Defined cases: null and empty texts and texts without words have the empty set, whose similarity to itself is 1; texts with
fewer words than a shingle have one shingle of all words. Repeated rows are one node. A group without any id stays whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import materialize
from .batches import bytes_of, map_slices
from .simhash_tiles import MEETING_PARTITIONS, SUBTILE, TILE, least_linked, majority, shingle_hashes

#: Bits by which the fingerprints of a pair may differ; recall by radius is in the README.
RADIUS = 16
#: Least Jaccard similarity of a link, in hundredths, so that the comparison is exact.
PERCENT = 80
#: Hashes of a set's sketch, and hundredths of the union's sketch that candidates share at least.
SKETCH, SKETCH_PERCENT = 64, 55
#: Fingerprints compared with a sub-tile at once, and pairs whose sketches are compared at once.
BLOCK = 4096
#: Most nodes of a family that meet at once; nodes behind each bucket of small families; families that are broadcast at most.
FAMILY, BUCKET_NODES, BROADCAST_ROWS = 2048, 2048, 2_000_000
#: Kinds of meetings: of small families, of parts of a large family's rest, and of its border with what is linked to its pivot.
SMALL, REST, CROSS = 0, 1, 2


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def sketch_of(hashes: np.ndarray) -> bytes:
    """The least hashes' high halves, ascending, filled up with the greatest number."""
    out = np.full(SKETCH, 0xFFFFFFFF, "<u4")
    least = (hashes[:SKETCH] >> np.uint64(32)).astype("<u4")
    out[: len(least)] = least
    return out.tobytes()


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of sketches share enough of their union's least hashes."""
    both = np.concatenate([x, y], axis=1)
    both.sort(axis=1)
    real = both != 0xFFFFFFFF
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)  # of the union's hashes
    size = np.minimum(rank[:, -1], SKETCH)
    common = (again & (rank <= SKETCH)).sum(axis=1)
    return 100 * common >= SKETCH_PERCENT * size


def with_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, text, node (digest of the set), fp, n (its size) and sketch (its least hashes' high halves)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def run(part):
        sets = [shingle_set(t, size) for t in bytes_of(part, 1)]
        digests = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        return {"doc_id": part.column(0), "text": part.column(1), "node": digests, "fp": np.array([majority(s) for s in sets], np.uint64).view(np.int64), "n": [len(s) for s in sets], "sketch": [sketch_of(s) for s in sets]}

    return map_slices(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, "doc_id long, text string, node long, fp long, n long, sketch binary", arrow, 1)


def linked_labels(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, radius: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a meeting and the least node of each one's component over the meeting's candidate pairs; both sides are ordered by n."""
    same = b is None
    both = a if same else {k: np.concatenate([a[k], b[k]]) for k in a}
    shift = 0 if same else len(a["n"])
    b = a if same else b
    label = np.arange(len(both["n"]))
    for i in range(0, len(a["n"]), SUBTILE):
        at = np.arange(i, min(len(a["n"]), i + SUBTILE))
        low = np.searchsorted(b["n"], -(-a["n"][at[0]] * percent // 100), side="left")
        high = np.searchsorted(b["n"], a["n"][at[-1]] * 100 // percent, side="right")
        for j in range(max(low, i) if same else low, high, BLOCK):
            to = min(high, j + BLOCK)
            u, v = np.nonzero(np.bitwise_count(a["fp"][at][:, None] ^ b["fp"][None, j:to]) <= radius)
            u, v = at[u], v + j + shift
            x, y = both["n"][u], both["n"][v]
            good = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & ((u < v) if same else True)
            u, v = u[good], v[good]
            while len(u):
                # what is linked by now needs no look at sketches
                open_pairs = label[u] != label[v]
                u, v = u[open_pairs], v[open_pairs]
                like = alike(both["sketch"][u[:BLOCK]], both["sketch"][v[:BLOCK]])
                label = least_linked(len(label), label[u[:BLOCK][like]], label[v[:BLOCK][like]])[label]
                u, v = u[BLOCK:], v[BLOCK:]
    return both["node"], both["node"][label]


def stars(node: np.ndarray, root: np.ndarray, types: list[str]) -> pa.Table:
    moved = np.flatnonzero(node != root)
    return pa.table({types[0]: pa.array(node[moved], pa.int64()), types[1]: pa.array(root[moved], pa.int64())})


def candidates(nodes: DataFrame, radius: int, percent: int, tile: int) -> DataFrame:
    """Edges (src, dst) that give the components of all candidate pairs of nodes (node, fp, n, sketch)."""
    spark = nodes.sparkSession
    # the factor keeps sizes of the exact ratio, and rounding, within neighbouring ranges
    span = F.when(F.col("n") == 0, -9).otherwise(F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) * (1 - 1e-9)).cast("int"))
    # some dozens of rows: how many tiles each range needs
    counts = {r["span"]: -(-r["n"] // tile) for r in nodes.groupBy(span.alias("span")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "src long, dst long")
    number, tiles = {}, 0
    for s, k in sorted(counts.items()):
        number[s] = tiles
        tiles += k
    table = lambda of: F.create_map(*[F.lit(x) for s in sorted(counts) for x in (s, of(s))])[F.col("span")]
    last = lambda s: number[s] + counts[s] - 1
    at = nodes.withColumn("span", span).withColumn("tile", (table(lambda s: number[s]) + F.pmod(F.xxhash64("node"), table(lambda s: counts[s]))).cast("int"))
    met = at.select("tile", "node", "fp", "n", "sketch", F.explode(F.sequence(table(lambda s: number.get(s - 1, number[s])), table(lambda s: last(s + 1) if s + 1 in counts else last(s)))).alias("other"))
    met = met.select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") <= F.col("other")).alias("of_a"), "node", "fp", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        own = table.column("of_a").to_numpy()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u4").reshape(-1, SKETCH)
        fields = {"node": table.column("node").to_numpy(), "fp": table.column("fp").to_numpy().view(np.uint64), "n": table.column("n").to_numpy(), "sketch": sketches}
        sides = []
        for part in (own, ~own):
            rows = np.flatnonzero(part)
            rows = rows[np.argsort(fields["n"][rows], kind="stable")]
            sides.append({k: x[rows] for k, x in fields.items()})
        if table.column("a")[0].as_py() != table.column("b")[0].as_py() and not (len(sides[0]["n"]) and len(sides[1]["n"])):
            return stars(np.zeros(0, np.int64), np.zeros(0, np.int64), ["src", "dst"])
        return stars(*linked_labels(sides[0], sides[1] if len(sides[1]["n"]) else None, radius, percent), ["src", "dst"])

    return met.repartition(min(MEETING_PARTITIONS, 4 * tiles), "a", "b").groupBy("a", "b").applyInArrow(compare, "src long, dst long")


def checked_labels(node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], split: int, radius: int, percent: int) -> np.ndarray:
    """The label of each node: equal for nodes that checked pairs link. With ``split`` above 0 only pairs across it are looked at."""
    n = np.array([len(s) for s in sets])
    sketch = np.frombuffer(b"".join(map(sketch_of, sets)), "<u4").reshape(-1, SKETCH)
    label = np.arange(len(node))
    for u in range(split or len(node)):
        v = np.arange(split or u + 1, len(node))
        v = v[label[v] != label[u]]
        if not len(v):
            continue
        distance = np.bitwise_count(fp[v] ^ fp[u])
        near = (distance <= radius) & (100 * np.minimum(n[v], n[u]) >= percent * np.maximum(n[v], n[u]))
        v, distance = v[near], distance[near]
        v = v[np.argsort(distance, kind="stable")]
        v = v[alike(np.broadcast_to(sketch[u], (len(v), SKETCH)), sketch[v])]
        for w in v.tolist():
            if label[w] == label[u]:
                continue
            common = len(np.intersect1d(sets[u], sets[w], assume_unique=True))
            if 100 * common >= percent * (n[u] + n[w] - common):
                label[label == label[w]] = label[u]
    return label


def by_pivot(members: DataFrame, sets_of, radius: int, percent: int, most: int) -> DataFrame:
    """The sets of large families with their ``role`` to the family's least node, the pivot: 0 linked to it, 1 near enough for a link to such a set, 2 further.

    One less the similarity is a distance, so a set that is further than twice a link's length from the pivot has no link to one
    that is linked to it.
    """
    pivots = members.groupBy("family").agg(F.min("node").alias("node"), F.first("members").alias("members"))
    pivot_sets = sets_of(pivots.select("node", "family", "members")).select("family", "node", "fp", "shingles", F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / most).cast("int") - 1)).alias("part"))
    schema = pa.schema([("family", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("shingles", pa.binary()), ("role", pa.int32()), ("pivot", pa.int64())])

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        centre = np.frombuffer(right.column("shingles")[0].as_py(), "<u8")
        centre_fp, least = np.uint64(right.column("fp").to_numpy().view(np.uint64)[0]), sketch_of(centre)
        close = np.bitwise_count(left.column("fp").to_numpy().view(np.uint64) ^ centre_fp) <= radius
        role = []
        for near, data in zip(close.tolist(), left.column("shingles"), strict=True):
            own = np.frombuffer(data.as_buffer(), "<u8")
            common = len(np.intersect1d(own, centre, assume_unique=True))
            union = len(own) + len(centre) - common
            link = 100 * common >= percent * union and near and bool(alike(*(np.frombuffer(x, "<u4").reshape(1, SKETCH) for x in (sketch_of(own), least)))[0])
            role.append(0 if link else 1 if 100 * common >= (2 * percent - 100) * union else 2)
        pivot = right.column("node")[0].as_py()
        return pa.table({"family": left.column("family"), "node": left.column("node"), "fp": left.column("fp"), "shingles": left.column("shingles"), "role": pa.array(role, pa.int32()), "pivot": pa.array([pivot] * left.num_rows, pa.int64())}, schema=schema)

    sets = sets_of(members.select("node", "family", "members")).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / most)).cast("int"))
    return sets.groupBy("family", "part").cogroup(pivot_sets.groupBy("family", "part")).applyInArrow(measure, "family long, node long, fp long, shingles binary, role int, pivot long")


def checked(families: DataFrame, rows: DataFrame, size: int, radius: int, percent: int, most: int) -> DataFrame:
    """Edges (src, dst) that give the components of all candidate pairs whose sets' similarity is at least ``percent`` hundredths."""
    sizes = families.groupBy("family").agg(F.count("*").alias("members"))
    members = materialize(families.join(sizes, "family"), "families")
    total = members.count()
    if not total:
        return families.sparkSession.createDataFrame([], "src long, dst long")
    # families are few beside the texts, which then stay where they are
    arrow = pa.schema([("node", pa.int64()), ("fp", pa.int64()), ("family", pa.int64()), ("members", pa.int64()), ("shingles", pa.binary())])

    def cast(part):
        return {"node": part.column(1), "fp": part.column(2), "family": part.column(3), "members": part.column(4), "shingles": [shingle_set(t, size).tobytes() for t in bytes_of(part, 0)]}

    def sets_of(some: DataFrame) -> DataFrame:
        picked = rows.select("text", "node", "fp").join(F.broadcast(some) if total <= BROADCAST_ROWS else some, "node").select("text", "node", "fp", "family", "members")
        return map_slices(picked, cast, "node long, fp long, family long, members long, shingles binary", arrow, 0).groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "family", "members", "shingles")])

    buckets = max(1, total // BUCKET_NODES)
    columns = ["key", "kind", "a", "b", "family", "node", "fp", "shingles", "of_a"]
    small = sets_of(members.where(F.col("members") <= most))
    met = small.select(F.pmod(F.xxhash64("family"), F.lit(buckets)).alias("key"), F.lit(SMALL).alias("kind"), F.lit(0).alias("a"), F.lit(0).alias("b"), "family", "node", "fp", "shingles", F.lit(True).alias("of_a"))
    told = None
    if not members.where(F.col("members") > most).isEmpty():
        measured = materialize(by_pivot(members.where(F.col("members") > most), sets_of, radius, percent, most), "measured")
        told = measured.where("role = 0 and node != pivot").select(F.col("node").alias("src"), F.col("pivot").alias("dst"))
        n = measured.groupBy("family").agg(*[F.ceil(F.count_if(c) / most).cast("int").alias(name) for name, c in (("rest_parts", F.col("role") > 0), ("border_parts", F.col("role") == 1), ("ball_parts", F.col("role") == 0))])
        sized = measured.join(n, "family").withColumnRenamed("family", "key").withColumn("family", F.col("key"))
        own = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
        spread = lambda df, parts: df.withColumn("other", F.explode(F.when(F.col(parts) > 0, F.sequence(F.lit(0), F.col(parts) - 1)).otherwise(F.array().cast("array<int>"))))
        rest = spread(sized.where("role > 0").withColumn("own", own("rest_parts")), "rest_parts").select("*", F.lit(REST).alias("kind"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("of_a"))
        border = spread(sized.where("role = 1").withColumn("own", own("border_parts")), "ball_parts").select("*", F.lit(CROSS).alias("kind"), F.col("own").alias("a"), F.col("other").alias("b"), F.lit(True).alias("of_a"))
        ball = spread(sized.where("role = 0").withColumn("own", own("ball_parts")), "border_parts").select("*", F.lit(CROSS).alias("kind"), F.col("other").alias("a"), F.col("own").alias("b"), F.lit(False).alias("of_a"))
        for more in (rest, border, ball):
            met = met.select(*columns).unionByName(more.select(*columns))

    def compare(table: pa.Table) -> pa.Table:
        family, of_a = table.column("family").to_numpy(), table.column("of_a").to_numpy()
        node, fp = table.column("node").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((node, ~of_a, family))
        cuts = [*np.flatnonzero(np.r_[True, family[order][1:] != family[order][:-1]]).tolist(), len(order)]
        shingles = table.column("shingles").combine_chunks()
        across = table.column("kind")[0].as_py() == CROSS or table.column("a")[0].as_py() != table.column("b")[0].as_py()
        out = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            at = order[i:j]
            split = int(of_a[at].sum()) if across else 0
            if across and split in (0, len(at)):
                continue
            sets = [np.frombuffer(shingles[int(k)].as_buffer(), "<u8") for k in at]
            out.append(stars(node[at], node[at][checked_labels(node[at], fp[at], sets, split, radius, percent)], ["src", "dst"]))
        return pa.concat_tables(out) if out else stars(np.zeros(0, np.int64), np.zeros(0, np.int64), ["src", "dst"])

    found = met.repartition(min(MEETING_PARTITIONS, 24 + total // BUCKET_NODES), "key", "kind", "a", "b").groupBy("key", "kind", "a", "b").applyInArrow(compare, "src long, dst long")
    return found if told is None else found.unionByName(told)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = 5, percent: int = PERCENT, tile: int = TILE, family: int = FAMILY) -> DataFrame:
    """One row per document: doc_id and ``component_id``, the smallest doc_id reachable through checked links."""
    rows = materialize(with_sets(docs, id_col, text_col, size), "sets")
    least = materialize(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least")), "distinct")
    near = materialize(candidates(least.select("node", "fp", "n", "sketch"), radius, percent, tile), "candidates")
    families = connected_components(near).withColumnRenamed("component", "family")
    links = materialize(checked(families, rows, size, radius, percent, family), "links")
    parts = connected_components(links)
    known = least.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "least")
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(known.join(roots, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each group of near copies: the row with the smallest id stays.

    Rows that share that id are one document and stay together; a group without any id stays whole.
    """
    rows = groups(docs, id_col, text_col, radius, size, percent)
    keep = rows.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["__keep"]), "left_semi")
