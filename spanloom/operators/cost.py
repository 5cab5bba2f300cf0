"""Cost and concurrency: exact ranks, request metrics, paired ratios, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import fits, running


def nearest_rank(df: DataFrame, group: list[str], col: str, percents: list[int]) -> DataFrame:
    """One row a group: p50, p95, ...: the value of rank ceil(n p / 100), the first at least; nulls are left out. A group of any size is ranked by many tasks."""
    # equal values are counted first, so that hot values don't multiply rows
    rows = df.where(F.col(col).isNotNull())
    values = rows.groupBy(*group, col).agg(F.count("*").alias("__c"))
    # groups of few rows have few values, which is seen without a look at the values
    small = fits(rows, group)
    ranked = running(values, group, [col], sums={"__upto": F.col("__c")}, small=small or None)
    if small:
        ranked = ranked.withColumn("__n", F.sum("__c").over(Window.partitionBy(*group)))
    else:
        totals = values.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.sum("__c").alias("__n"))
        ranked = ranked.join(totals, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] or F.lit(True))
    rank = lambda p: F.greatest(F.expr(f"(__n * {p} + 99) div 100"), F.lit(1))
    return ranked.groupBy(*group).agg(*[F.min(F.when(F.col("__upto") >= rank(p), F.col(col))).alias(f"p{p}") for p in percents])


def request_metrics(requests: DataFrame, by: list[str], window_s: float, percents: list[int] = (50, 95, 99)) -> DataFrame:
    """Requests, error rate, largest dispatch lag, throughputs, and ranks and means of the passed requests' latencies; times in ns.

    ``throughput`` counts passed requests that ended inside the planned window, which begins with the group's first scheduled
    time; ``drained_throughput`` counts all passed ones until the last end. Offered latency begins at the scheduled time.
    """
    ok = F.col("passed")
    begun = F.min("scheduled_ns").over(Window.partitionBy(*by))
    rows = requests.withColumn("__in", F.col("end_ns") <= begun + F.lit(int(window_s * 1e9)))
    rows = rows.withColumns({"latency_ns": F.when(ok, F.col("end_ns") - F.col("start_ns")), "offered_ns": F.when(ok, F.col("end_ns") - F.col("scheduled_ns"))})
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("passed"), F.count_if(ok & F.col("__in")).alias("in_window"), F.max(F.col("start_ns") - F.col("scheduled_ns")).alias("max_lag_ns"),
        F.avg("latency_ns").alias("mean_latency_ns"), F.avg("offered_ns").alias("mean_offered_ns"), F.min("scheduled_ns").alias("t0"), F.max("end_ns").alias("t1"),
    )
    for c in ("latency", "offered"):
        ranks = nearest_rank(rows, by, f"{c}_ns", list(percents))
        sums = sums.join(ranks.withColumnsRenamed({f"p{p}": f"{c}_p{p}" for p in percents}), by, "left")
    rate = F.try_divide(F.col("passed") * F.lit(1e9), (F.col("t1") - F.col("t0")).cast("double"))
    return sums.select(*by, "requests", "max_lag_ns", (1 - F.col("passed").cast("double") / F.col("requests")).alias("error_rate"), "mean_latency_ns", "mean_offered_ns", *[f"{c}_p{p}" for c in ("latency", "offered") for p in percents], (F.col("in_window") / F.lit(float(window_s))).alias("throughput"), rate.alias("drained_throughput"))


def resource_summary(samples: DataFrame, by: list[str], time: str, cpu: str, rss: str, window: tuple | None = None) -> DataFrame:
    """CPU share between first and last sample, mean and peak memory; ``violation`` for fewer than two samples or a counter that falls.

    ``window`` has the first and last time of the samples that count (values or columns).
    """
    if window is not None:
        samples = samples.where(F.col(time).between(*window))
    w = Window.partitionBy(*by).orderBy(time)
    rows = samples.withColumn("__fell", F.col(cpu) < F.lag(cpu).over(w))
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("__fell").alias("falls"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.min_by(cpu, time).alias("c0"), F.max_by(cpu, time).alias("c1"), F.avg(rss).alias("rss_mean"), F.max(rss).alias("rss_peak"))
    bad = (F.col("n") < 2) | (F.col("falls") > 0)
    return s.select(*by, F.when(~bad, F.try_divide(((F.col("c1") - F.col("c0")) * 100).cast("double"), (F.col("t1") - F.col("t0")).cast("double"))).alias("cpu_percent"), "rss_mean", "rss_peak", bad.alias("violation"))


def group_memory(samples: DataFrame, by: list[str], snapshot: str, member: str, rss: str) -> DataFrame:
    """Mean and peak of the group's summed memory over snapshots that hold all its members; fewer than two such are a violation."""
    members = samples.select(*by, member).distinct().groupBy(*by).agg(F.count("*").alias("members"))
    sums = samples.groupBy(*by, snapshot).agg(F.count_distinct(member).alias("seen"), F.sum(rss).alias("sum")).join(members, by).where("seen = members")
    out = sums.groupBy(*by).agg(F.count("*").alias("snapshots"), F.avg("sum").alias("rss_mean"), F.max("sum").alias("rss_peak"))
    return members.select(*by).join(out, by, "left").select(*by, F.coalesce("snapshots", F.lit(0)).alias("snapshots"), "rss_mean", "rss_peak", (F.coalesce("snapshots", F.lit(0)) < 2).alias("violation"))


def complete_blocks(trials: DataFrame, block: list[str], mode: str, modes: list[str], passed: str | None = None) -> DataFrame:
    """The trials of blocks that have each mode exactly once, passed if a column says so; other blocks are rejected."""
    good = F.coalesce(F.col(passed), F.lit(False)) if passed else F.lit(True)
    blocks = trials.where(F.col(mode).isin(modes)).groupBy(*block).agg(F.count_if(good).alias("n"), F.count("*").alias("all"), F.count_distinct(mode).alias("kinds"))
    return trials.join(blocks.where((F.col("kinds") == len(modes)) & (F.col("n") == len(modes)) & (F.col("all") == len(modes))).select(*block), block, "left_semi")


def trial_summary(trials: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Median, least, most and coefficient of variation; all null where a trial lacks the metric."""
    full = F.count(metric) == F.count("*")
    return trials.groupBy(*by).agg(F.when(full, F.median(metric)).alias("median"), F.when(full, F.min(metric)).alias("least"), F.when(full, F.max(metric)).alias("most"), F.when(full, F.try_divide(F.stddev_samp(metric), F.avg(metric))).alias("cv"))


def paired_ratios(trials: DataFrame, block: list[str], mode: str, metric: str, num: str, den: str) -> DataFrame:
    """Ratios inside the same block, then their median, least and most; blocks without both modes are left out and counted."""
    one = trials.groupBy(*block).agg(F.max(F.when(F.col(mode) == num, F.col(metric))).alias("a"), F.max(F.when(F.col(mode) == den, F.col(metric))).alias("b"))
    ratio = F.try_divide(F.col("a"), F.col("b"))
    return one.withColumn("ratio", ratio).agg(F.median("ratio").alias("median"), F.min("ratio").alias("least"), F.max("ratio").alias("most"), F.count("ratio").alias("pairs"), F.count_if(F.col("ratio").isNull()).alias("incomplete"))


def paired_uncertainty(ratios: DataFrame, metric: str, ratio: str) -> DataFrame:
    """Of each metric n, low and high (the 95 % bounds of the median over all n^n resamples), sign_p of a two-sided sign test without ties, and coverage 1 - 2^(1-n).

    No resample is drawn: with n ratios in order, the k-th smallest of a resample is at most the i-th ratio with the
    probability that a binomial count of n and i/n reaches k. For an even n the median is the mean of two neighbours; the
    first is ratio i and the second ratio j > i if k of the resample are up to i, i among them, and all others from j on, j among
    them. So odd counts make n rows a metric, even ones a row for each pair. Null ratios are left out.
    """
    rows = ratios.where(F.col(ratio).isNotNull()).select(metric, F.col(ratio).cast("double").alias("x"))
    rows = rows.withColumns({"i": F.row_number().over(Window.partitionBy(metric).orderBy("x")).cast("double"), "n": F.count("*").over(Window.partitionBy(metric)).cast("double")})
    # logarithms of factorials up to n
    logs = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.array(F.lit(0.0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.log(t.cast("double")))))
    sizes = ratios.groupBy(metric).agg(F.count(ratio).alias("n"), F.count_if(F.col(ratio) > 1).alias("up"), F.count_if(F.col(ratio) < 1).alias("down"))
    facts = sizes.select("*", F.when(F.col("n") > 0, logs).otherwise(F.array(F.lit(0.0))).alias("log"))
    choose = lambda n, k: F.element_at("log", n.cast("int") + 1) - F.element_at("log", k.cast("int") + 1) - F.element_at("log", (n - k).cast("int") + 1)
    k = F.floor((F.col("n") + 1) / 2)
    at_most = lambda i: F.when(i <= 0, 0.0).when(i >= F.col("n"), 1.0).otherwise(F.aggregate(F.sequence(k.cast("int"), F.col("n").cast("int")), F.lit(0.0), lambda acc, t: acc + F.exp(choose(F.col("n"), t) + t * F.log(i / F.col("n")) + (F.col("n") - t) * F.log(1 - i / F.col("n")))))
    ranked = rows.join(facts.select(F.col(metric).alias("__m"), "log"), F.col(metric).eqNullSafe(F.col("__m"))).drop("__m")
    ranked = ranked.select(metric, "x", "i", "n", F.exp(choose(F.col("n"), k)).alias("ways"), (at_most(F.col("i")) - at_most(F.col("i") - 1)).alias("mass"))
    odd, even = ranked.where("n % 2 = 1"), ranked.where("n % 2 = 0")
    up_to = "ways * (power(i / n, n / 2) - power((i - 1) / n, n / 2))"  # k of the resample up to i, i among them, in as many ways
    same = even.select(metric, "x", F.expr(f"mass - {up_to} * power((n - i) / n, n / 2)").alias("mass"))
    other = even.select(F.col(metric).alias("__m"), F.col("x").alias("y"), F.col("i").alias("j"))
    apart = even.join(other, F.col(metric).eqNullSafe(F.col("__m")) & (F.col("i") < F.col("j")))
    apart = apart.select(metric, ((F.col("x") + F.col("y")) / 2).alias("x"), F.expr(f"{up_to} * (power((n - j + 1) / n, n / 2) - power((n - j) / n, n / 2))").alias("mass"))
    medians = odd.select(metric, "x", "mass").unionByName(same).unionByName(apart).groupBy(metric, "x").agg(F.sum("mass").alias("mass"))
    summed = medians.withColumn("upto", F.sum("mass").over(Window.partitionBy(metric).orderBy("x")) + 1e-9)
    bounds = summed.groupBy(F.col(metric).alias("__m")).agg(F.min(F.when(F.col("upto") >= 0.025, F.col("x"))).alias("low"), F.min(F.when(F.col("upto") >= 0.975, F.col("x"))).alias("high"))
    m, least = F.col("up") + F.col("down"), F.least("up", "down")
    tail = F.aggregate(F.sequence(F.lit(0), least.cast("int")), F.lit(0.0), lambda acc, t: acc + F.exp(choose(m, t) - m * F.log(F.lit(2.0))))
    out = facts.join(bounds, F.col(metric).eqNullSafe(F.col("__m")), "left")
    some = F.col("n") > 0
    return out.select(metric, "n", "low", "high", F.when(some, F.least(F.lit(1.0), 2 * tail)).alias("sign_p"), F.when(some, 1 - F.pow(F.lit(2.0), 1 - F.col("n"))).alias("coverage"))


def capture_volume(records: DataFrame, dims: list[str], text: Column) -> DataFrame:
    """Events and UTF-8 bytes by each dimension alone, and the share of all bytes; ``dim`` names the dimension."""
    sized = records.select(*[F.col(d).cast("string").alias(d) for d in dims], F.octet_length(text).cast("long").alias("bytes"))
    each = sized.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])).alias("d"), "bytes")
    sums = each.groupBy("d.dim", "d.value").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"))
    return sums.withColumn("share", F.try_divide(F.col("bytes").cast("double"), F.sum("bytes").over(Window.partitionBy("dim")).cast("double")))


def volume_difference(full: DataFrame, less: DataFrame, key: list[str], requests: str) -> DataFrame:
    """Events and bytes of both captures by key, each request's share of them, and full less selective; a key of one side has 0 on the other.

    Both have key, events, bytes and the number of requests behind them.
    """
    side = lambda df, p: df.select(*key, *[F.col(c).alias(f"{p}_{c}") for c in ("events", "bytes")], F.col(requests).alias(f"{p}_n"))
    both = side(full, "full").join(side(less, "less"), key, "full_outer").na.fill(0, ["full_events", "full_bytes", "less_events", "less_bytes"])
    per = lambda p: F.try_divide(F.col(f"{p}_bytes").cast("double"), F.col(f"{p}_n").cast("double")).alias(f"{p}_bytes_per_request")
    return both.select(*key, "full_events", "less_events", "full_bytes", "less_bytes", (F.col("full_bytes") - F.col("less_bytes")).alias("saved_bytes"), per("full"), per("less"))


def reduction(runs: DataFrame, by: list[str], mode: str, events: str, latency: str, full: str, less: str, pair: list[str] | None = None) -> DataFrame:
    """1 - events of the lesser mode by those of the full one, and the ratio of their median latencies.

    With ``pair`` only runs count whose pair has each mode once; ``unpaired`` counts the others.
    """
    rows = runs.where(F.col(mode).isin(full, less))
    if pair:
        w = Window.partitionBy(*by, *pair)
        rows = rows.withColumn("__ok", (F.count("*").over(w) == 2) & (F.min(mode).over(w) != F.max(mode).over(w)))
    else:
        rows = rows.withColumn("__ok", F.lit(True))
    pick = lambda m, c: F.when(F.col("__ok") & (F.col(mode) == m), F.col(c))
    return rows.groupBy(*by).agg((1 - F.try_divide(F.sum(pick(less, events)).cast("double"), F.sum(pick(full, events)).cast("double"))).alias("events_saved"), F.try_divide(F.median(pick(less, latency)), F.median(pick(full, latency))).alias("latency_ratio"), F.count_if(~F.col("__ok")).alias("unpaired"))


def baseline_delta(trials: DataFrame, block: list[str], mode: str, metric: str, baseline: str) -> DataFrame:
    """Each mode's metric less the baseline's of the same block; negative ones stay."""
    base = trials.where(F.col(mode) == baseline).select(*block, F.col(metric).alias("base"))
    return trials.where(F.col(mode) != baseline).join(base, block).select(*block, mode, (F.col(metric) - F.col("base")).alias("delta"))


def tier_growth(deltas: DataFrame, block: list[str], mode: str, tier: str, low: str, high: str, value: str = "delta") -> DataFrame:
    """How much more the value is in the high tier than in the low one of the same block and mode; null where a tier is missing."""
    at = lambda t: F.max(F.when(F.col(tier) == t, F.col(value)))
    return deltas.groupBy(*block, mode).agg((at(high) - at(low)).alias("growth"))


def grouped_stats(samples: DataFrame, by: list[str], col: str, scale: float = 1.0) -> DataFrame:
    """Mean, median, p95 by rank, least and most, scaled."""
    base = samples.groupBy(*by).agg((F.avg(col) * scale).alias("mean"), (F.median(col) * scale).alias("median"), (F.min(col) * scale).alias("least"), (F.max(col) * scale).alias("most"))
    return base.join(nearest_rank(samples, by, col, [95]).withColumn("p95", F.col("p95") * scale), by)


def peak_concurrency(intervals: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    """The most intervals open at once (``peak``), and the fewest (``least``; below 0 where an end lacks its start); at equal times ends come before starts. Two levels: sums of time buckets, then sweeps inside them."""
    points = intervals.select(F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("p")).select("p.t", "p.d").groupBy("t", "d").agg(F.sum("d").alias("s"))
    cut = points.withColumn("__bucket", F.expr(f"t div {bucket}"))
    sums = cut.groupBy("__bucket").agg(F.sum("s").alias("sum"))
    # one row for each bucket of time
    before = sums.select("__bucket", (F.sum("sum").over(Window.orderBy("__bucket")) - F.col("sum")).alias("before"))
    inside = F.sum("s").over(Window.partitionBy("__bucket").orderBy("t", "d"))
    return cut.withColumn("__inside", inside).join(before, "__bucket").agg(F.max(F.col("before") + F.col("__inside")).alias("peak"), F.min(F.col("before") + F.col("__inside")).alias("least"))


def collisions(records: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one record, with how many."""
    return records.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def context_switches(events: DataFrame, by: list[str], order: list[str], request: str) -> DataFrame:
    """How often one event and the next belong to different requests."""
    before = F.lag(request).over(Window.partitionBy(*by).orderBy(*order))
    return events.withColumn("__before", before).groupBy(*by).agg(F.count_if(F.col("__before").isNotNull() & (F.col("__before") != F.col(request))).alias("switches"))


def thread_hops(events: DataFrame, request: list[str], order: list[str], thread: str) -> DataFrame:
    """Consecutive events of a request on different threads, as (from, to, n)."""
    before = F.lag(thread).over(Window.partitionBy(*request).orderBy(*order))
    return events.withColumn("from_thread", before).where(F.col("from_thread") != F.col(thread)).groupBy("from_thread", F.col(thread).alias("to_thread")).agg(F.count("*").alias("n"))


def thread_migration(events: DataFrame, request: list[str], order: list[str], thread: str) -> DataFrame:
    """Each request's distinct threads, its hops from one event's thread to another, and whether it migrated."""
    before = F.lag(thread).over(Window.partitionBy(*request).orderBy(*order))
    rows = events.withColumn("__hop", F.coalesce(before != F.col(thread), F.lit(False)))
    return rows.groupBy(*request).agg(F.count_distinct(thread).alias("threads"), F.count_if("__hop").alias("hops")).withColumn("migrated", F.col("threads") > 1)


def phase_barriers(requests: DataFrame, batch: list[str], entry: str, leave: str, barriers: list[tuple[str, str]] = ()) -> DataFrame:
    """Batches, with whether every request had begun before the first one ended (``together``).

    ``barriers`` are pairs of columns: in each, the last of the first must lie before the first of the second, as the first
    read's end and the second read's begin; ``ordered`` says whether all do. A missing time breaks its barrier.
    """
    least = [(F.max(a).alias(f"__a{k}"), F.min(b).alias(f"__b{k}"), F.count_if(F.col(a).isNull() | F.col(b).isNull()).alias(f"__n{k}")) for k, (a, b) in enumerate(barriers)]
    s = requests.groupBy(*batch).agg(F.max(entry).alias("last_entry"), F.min(leave).alias("first_exit"), *[c for three in least for c in three])
    ordered = F.lit(True)
    for k in range(len(barriers)):
        ordered = ordered & F.coalesce(F.col(f"__a{k}") < F.col(f"__b{k}"), F.lit(False)) & (F.col(f"__n{k}") == 0)
    out = s.withColumn("together", F.col("last_entry") < F.col("first_exit"))
    return (out.withColumn("ordered", ordered) if barriers else out).select(*batch, "last_entry", "first_exit", "together", *(["ordered"] if barriers else []))


def visit_counts(steps: DataFrame, call: list[str], seq: str, location: str) -> DataFrame:
    """Visits of each location of a call, and how often the next location is not after it."""
    w = Window.partitionBy(*call).orderBy(seq)
    return steps.withColumn("__next", F.lead(location).over(w)).groupBy(*call, location).agg(F.count("*").alias("visits"), F.count_if(F.col("__next") <= F.col(location)).alias("backward"))


def unknown_by_field(nodes: DataFrame, field: str, known: str) -> DataFrame:
    """Unknown nodes of each field that has any."""
    return nodes.where(~F.col(known)).groupBy(field).agg(F.count("*").alias("unknown"))


def answer_delay(requests: DataFrame, ready: DataFrame, key: list[str], by: list[str], percents: list[int]) -> DataFrame:
    """Percentiles of the time from a response to its answer."""
    joined = requests.join(ready, key).withColumn("delay", F.col("ready_ns") - F.col("end_ns"))
    return nearest_rank(joined, by, "delay", percents)


def phase_population(queries: DataFrame, by: list[str]) -> DataFrame:
    """Queries, exact, tp, fp, fn and unknown of each mode and phase."""
    return queries.groupBy(*by).agg(F.count("*").alias("queries"), F.count_if("exact").alias("exact"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count_if(~F.col("known")).alias("unknown"))
