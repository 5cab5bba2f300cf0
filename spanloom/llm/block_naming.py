"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered; then adjacent pairs
of numbers are numbered in the same way, again and again, until each text has one number. Equal numbers at one level
mean equal bytes, so the identity (number of blocks, last number) cannot collide: no hash decides anything.

Numbers come from a dense rank inside buckets (bucket + rank x buckets), so no step sorts all blocks in one task; the
number of buckets follows the rows. Keys of more than ``HOT_ROWS`` rows, or of more than ``1 / HOT_SHARE`` of a small
table, are found first by counting hashes. Their distinct keys are numbered apart, once each, and joined back.

Defined cases: null counts as the empty text, which is one empty block. Repeated rows are members of their group like
any other; one row of a group is kept even if several have its largest doc_id. A group whose doc_ids are all null keeps
one row and has a null keep_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .batches import free_name

BLOCK_BYTES = 4096
#: A key is hot from this share of the rows, or from this number of rows on.
HOT_SHARE, HOT_ROWS = 512, 1 << 16
#: Rows behind each bucket, and bytes of hot keys that are broadcast at most; more are joined by Spark's choice.
BUCKET_ROWS, BROADCAST_BYTES = 4096, 8 << 20


def named(rows: DataFrame, keys: list[str], total: int, key_bytes: int, name: str = "name") -> DataFrame:
    """``rows`` with a column ``name``: equal for equal keys, different for different ones, numbers from 0 on or, of hot keys, below 0."""
    buckets = max(4096, total // BUCKET_ROWS)
    least = max(64, min(total // HOT_SHARE, HOT_ROWS))
    hashed = rows.withColumn("__h", F.xxhash64(*keys))
    hot_hashes = hashed.groupBy("__h").agg(F.count("*").alias("__n")).where(F.col("__n") > least).select("__h", F.lit(True).alias("__hot"))
    # at most total / least hashes, and as many keys but for what collides in 64 bits
    few = lambda df, size: F.broadcast(df) if total // least * size <= BROADCAST_BYTES else df
    both = hashed.join(few(hot_hashes, 16), "__h", "left")
    rank = lambda: F.dense_rank().over(Window.partitionBy("__bucket").orderBy(*keys)).cast("long")
    spread = lambda df: df.withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    cold = spread(both.where("__hot is null")).withColumn(name, F.col("__bucket") + (rank() - 1) * buckets).select(*rows.columns, name)
    hot = both.where("__hot is not null")
    numbers = spread(hot.select("__h", *keys).distinct()).withColumn(name, -1 - F.col("__bucket") - (rank() - 1) * buckets)
    numbers = numbers.select(*[F.col(k).alias(f"__{k}") for k in keys], name)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return cold.unionByName(hot.join(few(numbers, key_bytes), same).select(*rows.columns, name))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: a row number ``uid``, doc_id, text_sha256, ``blocks`` and ``name``; (blocks, name) is the identity."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), data.alias("data"))
    base = base.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block_bytes)).cast("int"))
    cut = base.select("uid", "doc_id", F.sha2("data", 256).alias("sha"), "blocks", "data", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("pos"))
    # only the first block of a text carries what is kept for the document
    cut = cut.select("uid", F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("pos") == 0, F.unhex("sha")).alias("sha"), "blocks", "pos", F.expr(f"substring(data, pos * {block_bytes} + 1, {block_bytes})").alias("block"))
    size = docs.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) / block_bytes))), F.lit(0)).alias("n")).first()["n"]
    level = materialize(named(cut, ["block"], int(size), block_bytes).drop("block"), "blocks")
    heads = level.where("pos = 0").select("uid", "doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "blocks", "name")
    open_rows = level.where("blocks > 1").select("uid", "blocks", "pos", "name")
    done: list[DataFrame] = [heads.where("blocks = 1").select("uid", "name")]
    counts = open_rows.agg(F.max("blocks").alias("most"), F.count("*").alias("n")).first()
    width, n = int(counts["most"] or 1), int(counts["n"])
    while width > 1:
        # a pair is the even position with the one behind it; the last of an odd number stands with null beside it
        pairs = open_rows.groupBy("uid", "blocks", F.expr("pos div 2").cast("int").alias("half")).agg(F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("left_name"), F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))).alias("right_name"))
        next_level = named(pairs, ["left_name", "right_name"], n, 16).select("uid", "blocks", F.col("half").alias("pos"), "name")
        width = -(-width // 2)
        now = materialize(next_level, "pairs")
        finished = F.lit(1 << len(done)) >= F.col("blocks")
        done.append(now.where(finished).select("uid", "name"))
        open_rows = now.where(~finished)
        n = max(1, n // 2)
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    return heads.drop("name").join(names, "uid")


def resolve(ids: DataFrame) -> DataFrame:
    """Identities with ``keep_id``, ``group_size`` and ``kept``."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "uid")).alias("best")
    # written, so that the join below has a plain shuffle on both sides, whose large groups Spark can split
    groups = materialize(ids.groupBy("blocks", "name").agg(best, F.count("*").alias("group_size")), "groups")
    return ids.join(groups, ["blocks", "name"]).select("uid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return resolve(materialize(identities(docs, id_col, text_col, block_bytes), "identities")).drop("uid")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each group of equal texts: the row with the largest id stays."""
    uid = free_name("uid", docs.columns)
    named_rows = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    ids = identities(named_rows, uid, text_col, block_bytes)
    # inside, the row number stands for the id; the id itself decides which row stays
    keys = named_rows.select(F.col(uid).alias("uid"), F.col(id_col).cast("long").alias("id"))
    rows = materialize(ids.select(F.col("doc_id").alias("uid"), "blocks", "name"), "identities").join(keys, "uid")
    stay = rows.groupBy("blocks", "name").agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "uid")).alias("best")).select(F.col("best.uid").alias(uid))
    return named_rows.join(stay, uid, "left_semi").select(docs.columns)
