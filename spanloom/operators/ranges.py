"""Running values over ordered groups of any size, and joins of intervals by levels of their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: Rows of a group that one task sorts; a table with a larger group is cut into pieces of the order.
GROUP_ROWS = 250_000
#: Rows of a piece, and the most pieces.
PIECE_ROWS, MOST_PIECES = 250_000, 20_000


def fits(df: DataFrame, keys: list[str]) -> bool:
    """Whether no key has more rows than one task sorts."""
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return largest <= GROUP_ROWS


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, small: bool | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with running sums, maxima and last non-null values of each key's rows up to and with each row, in the given order.

    Where every key has few rows, this is a window. Else rows are cut into ranges of (keys, order), each range sums for
    itself, and what comes before a range is carried from the totals of the ranges of its key: there are few such totals,
    and a key of any size is sorted by many tasks. Rows equal in keys and order must not differ in what is carried.

    ``small`` is what ``fits`` says, where it is known, as for further keys beside those that were looked at.
    """
    sums, lasts, maxes = sums or {}, lasts or {}, maxes or {}
    local = {n: F.sum(c) for n, c in sums.items()} | {n: F.max(c) for n, c in maxes.items()} | {n: F.last(c, ignorenulls=True) for n, c in lasts.items()}
    upto = (Window.unboundedPreceding, Window.currentRow)
    if fits(df, keys) if small is None else small:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return df.withColumns({n: c.over(w) for n, c in local.items()})
    pieces = min(MOST_PIECES, -(-df.count() // PIECE_ROWS))
    # a written table, so that a row's piece never changes
    cut = materialize(df.repartitionByRange(pieces, *keys, *order).withColumn("__piece", F.spark_partition_id()), "pieces")
    at = F.struct(*order)
    totals = cut.groupBy(*keys, "__piece").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxes.items()], *[F.max_by(c, F.when(c.isNotNull(), at)).alias(n) for n, c in lasts.items()])
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__piece"])], F.count("*").over(before).alias("__earlier"), *[c.over(before).alias(f"__{n}") for n, c in ({n: F.sum(n) for n in sums} | {n: F.max(n) for n in maxes} | {n: F.last(n, ignorenulls=True) for n in lasts}).items()]).where("__earlier > 0").drop("__earlier")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__piece"])]
    joined = cut.join(F.broadcast(carried), same, "left")  # keys that run on from piece to piece: two rows a piece at most
    w = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(*upto)
    both = {n: F.when(F.col(f"__{n}").isNull(), c.over(w)).otherwise(F.coalesce(c.over(w), F.lit(0)) + F.col(f"__{n}")) for n, c in local.items() if n in sums} | {n: F.greatest(c.over(w), F.col(f"__{n}")) for n, c in local.items() if n in maxes} | {n: F.coalesce(c.over(w), F.col(f"__{n}")) for n, c in local.items() if n in lasts}
    return joined.withColumns(both).select(*df.columns, *sums, *maxes, *lasts)


def level_of(length: Column, bucket: int) -> Column:
    """The least k for which a bucket of 2^k times the size is no shorter than the length; the interval touches two such buckets at most."""
    return F.ceil(F.log2(F.greatest(length.cast("double") / bucket, F.lit(1.0)))).cast("int")


def levels_in(df: DataFrame, level: str) -> Column:
    """The levels of a table as an array; lengths have some dozens of powers of two."""
    return F.array(*[F.lit(r[0]) for r in sorted(df.select(level).distinct().collect())]).cast("array<int>")


def cells(start: Column, end: Column, level: str, bucket: int) -> Column:
    """The buckets of a level that [start, end] touches."""
    size = F.expr(f"shiftleft(bigint({bucket}), {level})")
    return F.sequence(F.floor(start / size), F.floor(end / size))


def containing(inner: DataFrame, outer: DataFrame, key: list[str], bucket: int, inner_span: tuple[str, str], outer_span: tuple[str, str]) -> DataFrame:
    """Rows of ``inner`` with each row of ``outer`` of the same key whose closed interval holds theirs; other columns of both.

    An outer interval stands in the buckets that it touches at the level of its length. An inner one looks into the bucket of
    its start at each level that is not below its own length's, since nothing shorter can hold it.
    """
    (a, b), (lo, hi) = inner_span, outer_span
    held = outer.withColumn("__level", level_of(F.col(hi) - F.col(lo), bucket))
    levels = levels_in(held, "__level")
    held = held.withColumn("__cell", F.explode(cells(F.col(lo), F.col(hi), "__level", bucket)))
    asked = inner.withColumn("__own", level_of(F.col(b) - F.col(a), bucket)).withColumn("__level", F.explode(F.filter(levels, lambda k: k >= F.col("__own"))))
    asked = asked.withColumn("__cell", F.floor(F.col(a) / F.expr(f"shiftleft(bigint({bucket}), __level)")))
    inside = (F.col(lo) <= F.col(a)) & (F.col(b) <= F.col(hi))
    return asked.join(held, [*key, "__level", "__cell"]).where(inside).drop("__level", "__cell", "__own")


def overlaps(left: DataFrame, right: DataFrame, key: list[str], bucket: int, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Rows of both tables with equal keys whose half-open spans share a place; names other than the keys must differ.

    Two spans meet at the level of the longer one, in the bucket where the later of them starts. Neither side is broadcast.
    """
    size = f"shiftleft(bigint({bucket}), __level)"
    a, b = (df.withColumn(own, level_of(F.col(hi) - F.col(lo), bucket)).where(F.col(lo) < F.col(hi)) for df, own, (lo, hi) in ((left, "__left", left_span), (right, "__right", right_span)))
    levels = F.array_distinct(F.concat(levels_in(a, "__left"), levels_in(b, "__right")))
    placed = lambda df, own, span, which: df.withColumn("__level", F.explode(F.filter(levels, lambda k: which(k, F.col(own))))).withColumn("__cell", F.explode(F.sequence(F.expr(f"floor({span[0]} / {size})"), F.expr(f"floor(({span[1]} - 1) / {size})"))))
    native, any_level, above = (lambda k, own: k == own), (lambda k, own: k >= own), (lambda k, own: k > own)
    hit = F.expr(f"greatest({left_span[0]}, {right_span[0]}) < least({left_span[1]}, {right_span[1]}) and floor(greatest({left_span[0]}, {right_span[0]}) / {size}) = __cell")
    on = [*key, "__level", "__cell"]
    first = placed(a, "__left", left_span, native).join(placed(b, "__right", right_span, any_level).hint("merge"), on).where(hit)
    second = placed(a, "__left", left_span, above).join(placed(b, "__right", right_span, native).hint("merge"), on).where(hit)
    return first.unionByName(second).drop("__level", "__cell", "__left", "__right")
