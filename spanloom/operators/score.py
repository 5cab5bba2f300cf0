"""Scoring of answers against truth: sets, three-valued answers, comparisons of methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_score(expected: DataFrame, actual: DataFrame, query: list[str], item: list[str]) -> DataFrame:
    """Per query: tp, fp, fn and exact. Queries on one side alone count; repeated items count once; null items name an empty set."""
    left = expected.select(*query, *item).distinct().withColumn("in_expected", F.lit(True))
    right = actual.select(*query, *item).distinct().withColumn("in_actual", F.lit(True))
    both = left.join(right, [*query, *item], "full_outer")
    real = reduce(lambda a, b: a & b, [F.col(i).isNotNull() for i in item])
    e, a = F.coalesce("in_expected", F.lit(False)), F.coalesce("in_actual", F.lit(False))
    counts = both.groupBy(*query).agg(F.count_if(real & e & a).alias("tp"), F.count_if(real & ~e & a).alias("fp"), F.count_if(real & e & ~a).alias("fn"))
    return counts.withColumn("exact", (F.col("fp") == 0) & (F.col("fn") == 0))


def prf(counts: DataFrame) -> DataFrame:
    """Precision and recall, null where undefined, and f1, null where all counts are 0."""
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def micro_summary(per_query: DataFrame, by: list[str]) -> DataFrame:
    """Counts summed over queries, then ``prf``; queries, exact answers and, where a ``known`` column says so, unknown ones."""
    unknown = F.count_if(~F.col("known")) if "known" in per_query.columns else F.lit(0).cast("long")
    sums = per_query.groupBy(*by).agg(F.count("*").alias("queries"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count_if("exact").alias("exact"), unknown.alias("unknown"))
    return prf(sums)


def membership_score(reference: DataFrame, prediction: DataFrame, query: str, parent: str, child: str, root: str) -> DataFrame:
    """``set_score`` on the nodes of each query's edges, less its root."""
    nodes = lambda edges: edges.select(query, root, F.explode(F.array(parent, child)).alias("node")).where(F.col("node") != F.col(root)).select(query, "node")
    return set_score(nodes(reference), nodes(prediction), [query], ["node"])


def unknown_policy(answers: DataFrame, expected: str = "expected", predicted: str = "predicted", empty_is_unknown: bool = False) -> DataFrame:
    """``known``, tp, fp, fn, exact for arrays of items: an unknown answer misses all that is expected and is not exact."""
    known = F.col(predicted).isNotNull()
    if empty_is_unknown:
        known = known & (F.size(predicted) > 0)
    e = F.array_distinct(expected)
    p = F.when(known, F.array_distinct(predicted)).otherwise(F.array_except(e, e))
    tp = F.size(F.array_intersect(e, p))
    out = answers.withColumns({"known": known, "tp": tp.cast("long"), "fp": (F.size(p) - tp).cast("long"), "fn": (F.size(e) - tp).cast("long")})
    return out.withColumn("exact", F.col("known") & (F.col("fp") == 0) & (F.col("fn") == 0))


def binary_confusion(predictions: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """tp, fp, tn, fn over answered rows, unknown rows, positives missed (unknown ones too) and coverage; ``predicted`` null is unknown."""
    t, p = F.col(truth), F.col(predicted)
    counts = predictions.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"), F.count_if(p.isNull()).alias("unknown"), F.count_if(t & (p.isNull() | ~p)).alias("missed"), F.count("*").alias("n"))
    return counts.withColumn("coverage", (F.col("n") - F.col("unknown")).cast("double") / F.col("n")).drop("n")


def site_prediction(reads: DataFrame, pairs: DataFrame, source: str, sink: str, origin: str, known: str) -> DataFrame:
    """Per (source, sink) pair: true if any known read at the sink has that origin; else null if the sink was never read or any read is unknown; else false."""
    at_sink = reads.groupBy(sink).agg(F.count("*").alias("n"), F.count_if(~F.col(known)).alias("unknown"))
    hit = reads.where(F.col(known)).select(F.col(origin).alias(source), F.col(sink)).distinct().withColumn("hit", F.lit(True))
    joined = pairs.join(hit, [source, sink], "left").join(at_sink, sink, "left")
    return joined.select(source, sink, F.when(F.col("hit"), F.lit(True)).when(F.col("n").isNull() | (F.col("unknown") > 0), F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("predicted"))


def answer_state(status: Column, expected: Column, actual: Column) -> Column:
    """known_correct, known_wrong, unknown, or the status that says why there is no answer."""
    special = ("evidence_invalid", "planning_refused", "oracle_unavailable")
    return F.when(status.isin(*special), status).when(actual.isNull(), F.lit("unknown")).when(F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(actual)), F.lit("known_correct")).otherwise(F.lit("known_wrong"))


def state_rollup(state: Column) -> Column:
    """Fine states as correct, wrong, unknown, rejected or other."""
    return F.when(state == "known_correct", "correct").when(state == "known_wrong", "wrong").when(state == "unknown", "unknown").when(state.isin("evidence_invalid", "planning_refused"), "rejected").otherwise("other")


def paired_states(a: DataFrame, b: DataFrame, key: list[str], state: str = "state") -> DataFrame:
    """How many targets each pair of states has."""
    joined = a.select(*key, F.col(state).alias("state_a")).join(b.select(*key, F.col(state).alias("state_b")), key)
    return joined.groupBy("state_a", "state_b").agg(F.count("*").alias("n"))


def retention(pairs: DataFrame, correct: str = "correct") -> DataFrame:
    """Targets that both have right, by those that the second (the baseline) has right; null if it has none."""
    both = F.sum(F.when((F.col("state_a") == correct) & (F.col("state_b") == correct), F.col("n")))
    base = F.sum(F.when(F.col("state_b") == correct, F.col("n")))
    return pairs.agg(F.try_divide(F.coalesce(both, F.lit(0)).cast("double"), base.cast("double")).alias("retention"))


def capability_gaps(a: DataFrame, b: DataFrame, key: list[str], state: str = "state", correct: str = "correct") -> DataFrame:
    """Targets that the second tool (the baseline) has right and the first has not, with the first's state; a target that it lacks has null."""
    base = b.where(F.col(state) == correct).select(*key)
    return base.join(a.select(*key, F.col(state).alias("state_a")), key, "left").where(~F.col("state_a").eqNullSafe(F.lit(correct)))


def family_counts(records: DataFrame, family: str, state: str, states: list[str], applicable: Column | None = None) -> DataFrame:
    """Rows of each state by family, one column a state, and all rows; with ``applicable`` rows that aren't are counted as ``not_applicable`` alone."""
    yes = F.lit(True) if applicable is None else F.coalesce(applicable, F.lit(False))
    extra = [] if applicable is None else [F.count_if(~yes).alias("not_applicable")]
    return records.groupBy(family).agg(F.count_if(yes).alias("targets"), *extra, *[F.count_if(yes & (F.col(state) == s)).alias(s) for s in states])


def occurrence_names(events: DataFrame, root: list[str], kind: str, callee: str, order: list[str]) -> DataFrame:
    """``events`` with ``occurrence``: how many of the same kind and callee stand before it in its root.

    Objects' ids differ between runs; (kind, callee, occurrence) in a root names the same thing in each.
    """
    return events.withColumn("occurrence", F.row_number().over(Window.partitionBy(*root, kind, callee).orderBy(*order)) - 1)


def answers_equal(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose answers differ between two runs, or that one run lacks."""
    joined = a.select(*keys, F.col(value).alias("value_a"), F.lit(True).alias("in_a")).join(b.select(*keys, F.col(value).alias("value_b"), F.lit(True).alias("in_b")), keys, "full_outer")
    return joined.where(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("value_a").eqNullSafe(F.col("value_b"))).select(*keys, "value_a", "value_b")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], volatile: list[str] = ()) -> DataFrame:
    """Keys that were added, removed or changed in a column that isn't volatile."""
    columns = [c for c in before.columns if c not in (*keys, *volatile)]
    pack = lambda df, name: df.select(*keys, F.struct(*columns).alias(name))
    joined = pack(before, "old").join(pack(after, "new"), keys, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return joined.select(*keys, change.alias("change")).where("change is not null")
