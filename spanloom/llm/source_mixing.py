"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a rate: its target share of the output by its number of rows. Each row inverts the Poisson
distribution of its source's rate at a point that a hash of the seed and the row's id fixes, and is repeated that
often; a further hash of seed, id and copy orders all copies at random.

Defined cases: a null source is a source of its own; null or repeated ids share their point, and null and empty texts
are rows like any other. An empty table gives an empty result. Columns of ``docs`` stay as they are; a column added has
an underscore behind its name if ``docs`` has one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import free_name

#: Hexadecimal digits of a hash that make a number; 12 are 48 bits, exact in a double.
DIGITS = 12


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def poisson_steps(table: DataFrame) -> DataFrame:
    """(source, rate) with ``steps``: the distribution function at 0, 1, 2, ... up to where it is 1 in a double, as an array."""
    most = F.ceil(F.col("rate") + F.lit(12.0) * F.sqrt("rate") + 24).cast("int")
    each = table.withColumn("k", F.explode(F.sequence(F.lit(0), most)))
    # a source's terms in order: their number follows its rate, not its rows
    upto = Window.partitionBy("source").orderBy("k")
    # by exp(k ln(rate) - rate - ln k!), so that large rates don't underflow
    each = each.withColumn("log_factorial", F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(upto))
    each = each.withColumn("upto", F.sum(F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial"))).over(upto))
    return each.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "upto"))), lambda x: x["upto"]).alias("steps"))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, other: float = 0.0) -> DataFrame:
    """(source, n, rate). Without ``weights`` a source's target share goes with its size to the power ``temperature``.

    With ``weights`` a source's share is its weight by the sum over the sources there are; those it doesn't name have weight ``other``.
    The expected number of rows of the result is ``epochs`` times that of ``docs``.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(table, F.col("source")).cast("double"), F.lit(float(other)))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    all_n, all_weight = float(total["n"] or 0), float(total["weight"] or 0)
    if not all_weight:
        return sizes.select("source", "n", F.lit(0.0).alias("rate"))
    return sizes.select("source", "n", (F.lit(float(epochs)) * all_n * F.col("weight") / all_weight / F.col("n")).alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 1, other: float = 0.0) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, in random order, with ``copies`` (how often), ``copy`` (from 0 on) and ``order_key``."""
    copies, copy, order_key, of, steps = (free_name(c, docs.columns) for c in ("copies", "copy", "order_key", "__source", "__steps"))
    table = poisson_steps(rates(docs, source_col, weights, temperature, epochs, other).where("rate > 0")).toDF(of, steps)
    point = uniform(F.lit(seed), F.col(id_col))
    # a row for each source; a source has a name at least, so the table is far smaller than the documents, and Spark broadcasts it by its size
    drawn = docs.join(table, docs[source_col].eqNullSafe(table[of])).withColumn(copies, F.size(F.filter(steps, lambda c: c < point)))
    rows = drawn.where(F.col(copies) > 0).drop(of, steps).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    rows = rows.withColumn(order_key, F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy))))
    # keys are even in their range, so the bounds of the partitions are known: nothing is sampled, and no row is drawn twice
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring(order_key, 1, DIGITS), 16, 10).cast("double") * (n / 16**DIGITS)).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions(order_key)
