"""Evidence gates: each returns rows that say which group breaks a rule; no rows means passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import fits, running


def _violations(df: DataFrame, group: list[str], rule: str, detail: Column) -> DataFrame:
    return df.select(*group, F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def sequence_gate(df: DataFrame, group: list[str], seq: str, start: int = 0) -> DataFrame:
    """Groups whose seq isn't exactly start, start + 1, ...; nulls are gaps."""
    stats = df.groupBy(*group).agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"), F.count("*").alias("n"), F.count_distinct(seq).alias("d"))
    bad = stats.where((F.col("lo") != start) | F.col("lo").isNull() | (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("d") != F.col("n")))
    return _violations(bad, group, "sequence", F.concat_ws("/", "lo", "hi", "n", "d"))


def duplicate_identity_gate(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur with different payloads."""
    rest = [c for c in df.columns if c not in key]
    kinds = df.select(*key, F.struct(*rest).alias("payload")).distinct().groupBy(*key).agg(F.count("*").alias("kinds"))
    return _violations(kinds.where("kinds > 1"), key, "conflicting_duplicate", F.col("kinds"))


def transport_gate(events: DataFrame, stats: DataFrame, capture: str, zero: list[str] = ("lost", "errors", "return_code"), identities: dict[str, str] | None = None) -> DataFrame:
    """Captures whose submitted count isn't the received one, without events, or with one of the ``zero`` columns of ``stats`` not 0 (missing counts as not 0).

    ``identities`` are named conditions over the columns of ``stats``, such as allocated = registered + retired; each that
    doesn't hold is a violation of its own name.
    """
    got = events.groupBy(capture).agg(F.count("*").alias("received"))
    joined = stats.join(got, capture, "left").withColumn("received", F.coalesce("received", F.lit(0)))
    bad = joined.where(" or ".join(["received = 0", "submitted is null", "submitted != received", *(f"coalesce({c}, 1) != 0" for c in zero)]))
    out = _violations(bad, [capture], "transport", F.concat_ws("/", "submitted", "received"))
    for name, condition in (identities or {}).items():
        out = out.unionByName(_violations(joined.where(~F.coalesce(F.expr(condition), F.lit(False))), [capture], name, F.lit(condition)))
    return out


def monotonic_gate(df: DataFrame, group: list[str], order: list[str], ts: str, strict: bool = False) -> DataFrame:
    """Groups in which ts goes back (or, if strict, stands) in the given order, with how often."""
    before = F.lag(ts).over(Window.partitionBy(*group).orderBy(*order))
    broken = (F.col(ts) <= F.col("__before")) if strict else (F.col(ts) < F.col("__before"))
    bad = df.withColumn("__before", before).where(broken).groupBy(*group).agg(F.count("*").alias("n"))
    return _violations(bad, group, "monotonic", F.col("n"))


def single_context_gate(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Groups with more than one context, or a null or zero one."""
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "0")
    stats = df.groupBy(*group).agg(F.count_distinct(F.struct(*cols)).alias("kinds"), F.count_if(missing).alias("missing"))
    return _violations(stats.where("kinds != 1 or missing > 0"), group, "context", F.concat_ws("/", "kinds", "missing"))


def pairing_gate(df: DataFrame, key: list[str], kind: str, seq: str, begin: list[str], end: list[str], equal: list[str] = ()) -> DataFrame:
    """Keys without exactly one begin and one later end of equal context."""
    b, e = F.col(kind).isin(*begin), F.col(kind).isin(*end)
    stats = df.where(b | e).groupBy(*key).agg(
        F.count_if(b).alias("begins"), F.count_if(e).alias("ends"), F.max(F.when(b, F.col(seq))).alias("b"), F.min(F.when(e, F.col(seq))).alias("e"),
        *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"__{c}") for c in equal],
    )
    bad = (F.col("begins") != 1) | (F.col("ends") != 1) | (F.col("e") <= F.col("b"))
    for c in equal:
        bad = bad | (F.col(f"__{c}") != 1)
    return _violations(stats.where(bad), key, "pairing", F.concat_ws("/", "begins", "ends"))


def nesting_frames(df: DataFrame, thread: list[str], seq: str, enter: Column, leave: Column) -> DataFrame:
    """Frames of properly nested calls: enter_seq, exit_seq, depth, parent_seq (the enter of the frame around it).

    The k-th enter at a depth of a thread pairs with the k-th exit to that depth. Depths, counts and the enters around a frame
    are running values, so a thread of any length is cut into ranges of seq that carry on from each other.
    """
    rows = df.withColumn("__step", F.when(enter, 1).when(leave, -1).otherwise(0)).where("__step != 0").select(*thread, seq, "__step")
    small = fits(rows, thread)  # then depths of a thread are smaller still
    rows = running(rows, thread, [seq], sums={"__sum": F.col("__step")}, small=small).withColumn("depth", F.when(F.col("__step") == 1, F.col("__sum")).otherwise(F.col("__sum") + 1))
    rows = running(rows, [*thread, "depth", "__step"], [seq], sums={"__nth": F.lit(1)}, small=small)
    # the enter one level up that came last; one array entry a level would grow with depth, so join by level and count
    opened = rows.where("__step = 1").select(*thread, F.col("depth"), F.col("__nth"), F.col(seq).alias("enter_seq"))
    closed = rows.where("__step = -1").select(*thread, F.col("depth"), F.col("__nth"), F.col(seq).alias("exit_seq"))
    frames = opened.join(closed, [*thread, "depth", "__nth"], "left").drop("__nth")
    levels = frames.select(*thread, F.col("depth").alias("level"), F.col("enter_seq").alias("at"), F.lit(True).alias("parent")).unionByName(frames.select(*thread, (F.col("depth") - 1).alias("level"), F.col("enter_seq").alias("at"), F.lit(False).alias("parent")))
    around = running(levels, [*thread, "level"], ["at", "parent"], lasts={"parent_seq": F.when(F.col("parent"), F.col("at"))}, small=small)
    return frames.join(around.where("not parent").select(*thread, F.col("at").alias("enter_seq"), "parent_seq"), [*thread, "enter_seq"], "left")


def nesting_gate(df: DataFrame, thread: list[str], seq: str, enter: Column, leave: Column) -> DataFrame:
    """Threads whose calls close more than they open at some point, or don't all close."""
    rows = running(df.withColumn("__step", F.when(enter, 1).when(leave, -1).otherwise(0)).select(*thread, seq, "__step"), thread, [seq], sums={"__sum": F.col("__step")})
    stats = rows.groupBy(*thread).agg(F.min("__sum").alias("least"), F.sum("__step").alias("balance"))
    return _violations(stats.where("least < 0 or balance != 0"), thread, "nesting", F.concat_ws("/", "least", "balance"))


def version_gate(df: DataFrame, owner: list[str], seq: str, write: Column, version: str, weak: bool = False) -> DataFrame:
    """Owners with a read or write whose version isn't the number of writes so far; if weak, whose writes' versions don't strictly rise."""
    w = Window.partitionBy(*owner).orderBy(seq)
    if weak:
        rows = df.where(write).withColumn("__want", F.lag(version).over(w)).where(F.col(version) <= F.col("__want"))
    else:
        rows = df.withColumn("__want", F.sum(F.when(write, 1).otherwise(0)).over(w)).where(~F.col(version).eqNullSafe(F.col("__want")))
    return _violations(rows.groupBy(*owner).agg(F.count("*").alias("n")), owner, "version", F.col("n"))


def final_version_gate(log: DataFrame, snapshots: DataFrame, frame: list[str], owner: list[str], seq: str, write: Column, version: str) -> DataFrame:
    """Final snapshots (frame, owner, version) without the version of the frame's last write of that owner; one without any write is a violation too."""
    last = log.where(write).groupBy(*frame, *owner).agg(F.max_by(version, seq).alias("__last"))
    rows = snapshots.join(last, [*frame, *owner], "left").where(~F.col(version).eqNullSafe(F.col("__last")) | F.col("__last").isNull())
    return _violations(rows, [*frame, *owner], "final_version", F.concat_ws("/", F.col(version).cast("string"), F.coalesce(F.col("__last").cast("string"), F.lit("none"))))


def assign_request_scopes(df: DataFrame, context: list[str], seq: str, enter: Column, leave: Column) -> DataFrame:
    """Events with ``generation`` (k-th enter of the context), ``request_sequence`` in it and ``scope_state``: inside, outside or nested.

    A scope that is never closed has state unclosed on its enter.
    """
    upto = Window.partitionBy(*context).orderBy(seq)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({"__enter": F.when(enter, 1).otherwise(0), "__leave": F.when(leave, 1).otherwise(0)})
    rows = rows.withColumn("generation", F.sum("__enter").over(upto)).withColumn("__open", F.sum("__enter").over(upto) - F.coalesce(F.sum("__leave").over(before), F.lit(0)))
    scope = Window.partitionBy(*context, "generation")
    rows = rows.withColumn("request_sequence", F.row_number().over(scope.orderBy(seq)) - 1).withColumn("__leaves", F.sum("__leave").over(scope))
    state = F.when((F.col("__enter") == 1) & (F.col("__open") > 1), "nested").when(F.col("__open") < 1, "outside").when((F.col("__enter") == 1) & (F.col("__leaves") == 0), "unclosed").otherwise("inside")
    return rows.withColumn("scope_state", state).drop("__enter", "__leave", "__open", "__leaves")


def request_ids(scoped: DataFrame, context: list[str], order: str, bucket: int) -> DataFrame:
    """(context, generation, request_id): the global rank, from 1, of the event that opened each generation.

    Ranks are counted inside ranges of ``order`` first, so that no task sorts all of them.
    """
    opened = scoped.where("request_sequence = 0 and generation > 0").select(*context, "generation", order).withColumn("__range", F.expr(f"{order} div {bucket}"))
    sums = opened.groupBy("__range").agg(F.count("*").alias("n"))
    # one row for each range
    before = sums.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order, *context))
    return opened.withColumn("inside", inside).join(before, "__range").select(*context, "generation", (F.col("before") + F.col("inside")).alias("request_id"))


def event_order_gate(df: DataFrame, group: list[str], seq: str, op: str, allowed: list[list[str]]) -> DataFrame:
    """Groups whose list of operations, in order, isn't one of the allowed lists."""
    lists = df.groupBy(*group).agg(F.concat_ws(">", F.transform(F.array_sort(F.collect_list(F.struct(seq, op))), lambda x: x[op])).alias("ops"))
    return _violations(lists.where(~F.col("ops").isin([">".join(a) for a in allowed])), group, "event_order", F.col("ops"))


def capture_closed_gate(df: DataFrame, group: list[str], seq: str, kind: str, count: str, plan: str | None = None, expected_plan: str | None = None) -> DataFrame:
    """Captures without a header first, one footer last that counts the rows before it, or with a problem row; with ``plan``, whose header lacks the expected plan hash."""
    hashed = F.max(F.when(F.col(kind) == "header", F.col(plan))) if plan else F.lit(None).cast("string")
    stats = df.groupBy(*group).agg(F.min_by(kind, seq).alias("first"), F.max_by(kind, seq).alias("last"), F.count_if(F.col(kind) == "footer").alias("footers"), F.count_if(F.col(kind).isin("problem", "abort")).alias("problems"), F.max(F.when(F.col(kind) == "footer", F.col(count))).alias("counted"), F.count("*").alias("n"), hashed.alias("plan"))
    bad = stats.where("first != 'header' or last != 'footer' or footers != 1 or problems > 0 or not (counted <=> n - 1)")
    out = _violations(bad, group, "capture_closed", F.concat_ws("/", "first", "last", "footers", "problems"))
    if plan:
        out = out.unionByName(_violations(stats.where(~F.col("plan").eqNullSafe(F.lit(expected_plan))), group, "plan", F.coalesce("plan", F.lit("none"))))
    return out


def task_lifecycle(df: DataFrame, task: list[str], kind: str, seq: str) -> DataFrame:
    """Status of each asynchronous task from its submit, reject, start, end and throw events; broken orders are ``violation``."""
    n = lambda k: F.count_if(F.col(kind) == k)
    at = lambda k: F.min(F.when(F.col(kind) == k, F.col(seq)))
    s = df.groupBy(*task).agg(*[n(k).alias(k) for k in ("submit", "reject", "start", "end", "throw")], at("submit").alias("t0"), at("start").alias("t1"), F.coalesce(at("end"), at("throw")).alias("t2"))
    good = "submit = 1 and reject + least(start, 1) <= 1 and start <= 1 and `end` + throw <= 1 and `end` + throw <= start and coalesce(t1 > t0, true) and coalesce(t2 > t1, true)"
    status = F.when(~F.expr(good), "violation").when(F.col("reject") == 1, "submission_rejected").when(F.col("end") == 1, "worker_completed").when(F.col("throw") == 1, "worker_exceptional").otherwise("not_started")
    return s.select(*task, status.alias("status"))


def task_gets_gate(df: DataFrame, task: list[str], kind: str, seq: str, result: str) -> DataFrame:
    """Gets of a task that come before its end, or whose result isn't the end's (a throw's cause for a failed task)."""
    done = df.where(F.col(kind).isin("end", "throw")).groupBy(*task).agg(F.min(seq).alias("__at"), F.min_by(result, seq).alias("__result"))
    gets = df.where(F.col(kind) == "get").join(done, task, "left")
    rule = F.when(F.col("__at").isNull() | (F.col("__at") >= F.col(seq)), "get_before_end").when(~F.col(result).eqNullSafe(F.col("__result")), "other_result")
    return gets.withColumn("rule", rule).where("rule is not null").select(*task, "rule", F.col(seq).cast("string").alias("detail"))
