"""Registered queries: each operator over tables that the adapters derive, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import project
from ..operators import components, cost, gates, graph, joins, score, spans
from . import adapters as ad
from . import evidence_queries, further_queries, lineage_queries, more_queries  # noqa: F401  these register their own queries
from .adapters import ELOG, LINES, OBS, SPANS
from .registry import register

SLACK = 60_000_000
R6 = lambda c: F.round(c, 6)

# ---- scoring ----

LABEL_SETS = """e AS (SELECT DISTINCT doc_id % 50 AS query, doc_id AS item FROM labels WHERE quality = 1),
a AS (SELECT DISTINCT doc_id % 50 AS query, doc_id AS item FROM labels WHERE toxic = 0),
j AS (SELECT coalesce(e.query, a.query) AS query, e.item IS NOT NULL AS ie, a.item IS NOT NULL AS ia FROM e FULL JOIN a ON e.query = a.query AND e.item = a.item),
s AS (SELECT query, count(*) FILTER (ie AND ia) AS tp, count(*) FILTER (NOT ie AND ia) AS fp, count(*) FILTER (ie AND NOT ia) AS fn FROM j GROUP BY query)"""


def label_sets(spark, d):
    rows = ad.table(spark, d, "labels").select((F.col("doc_id") % 50).alias("query"), F.col("doc_id").alias("item"), "quality", "toxic")
    return score.set_score(rows.where("quality = 1"), rows.where("toxic = 0"), ["query"], ["item"])


@register("set_score", f"WITH {LABEL_SETS} SELECT *, fp = 0 AND fn = 0 AS exact FROM s")
def set_score(spark, d):
    return label_sets(spark, d)


@register("micro_summary", f"""WITH {LABEL_SETS}, m AS (SELECT query % 4 AS method, count(*) AS queries, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) FILTER (fp = 0 AND fn = 0) AS exact FROM s GROUP BY 1)
SELECT *, 0::BIGINT AS unknown, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM m""")
def micro_summary(spark, d):
    out = score.micro_summary(label_sets(spark, d).withColumn("method", F.col("query") % 4), ["method"])
    return out.withColumns({c: R6(F.col(c)) for c in ("precision", "recall", "f1")})


@register("binary_confusion", """WITH p AS (SELECT o_orderpriority AS grp, o_totalprice > 250000 AS t, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS p FROM orders)
SELECT grp, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (p IS NULL) AS unknown,
count(*) FILTER (t AND (p IS NULL OR NOT p)) AS missed, round(count(p) / count(*), 6) AS coverage FROM p GROUP BY grp""")
def binary_confusion(spark, d):
    o = ad.table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") > 250000).alias("t"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("p"))
    return score.binary_confusion(o, ["grp"], "t", "p").withColumn("coverage", R6(F.col("coverage")))


STATES = """st AS (SELECT o_orderkey AS k, o_orderpriority AS fam, CASE o_orderstatus WHEN 'P' THEN 'unknown' WHEN 'F' THEN 'correct' ELSE 'wrong' END AS a,
CASE WHEN o_totalprice > 300000 THEN 'unknown' WHEN o_custkey % 3 = 0 THEN 'wrong' ELSE 'correct' END AS b FROM orders)"""


def states(spark, d):
    return ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("fam"), F.when(F.col("o_orderstatus") == "P", "unknown").when(F.col("o_orderstatus") == "F", "correct").otherwise("wrong").alias("a"), F.when(F.col("o_totalprice") > 300000, "unknown").when(F.col("o_custkey") % 3 == 0, "wrong").otherwise("correct").alias("b"))


@register("paired_states", f"WITH {STATES} SELECT a AS state_a, b AS state_b, count(*) AS n FROM st GROUP BY 1, 2")
def paired_states(spark, d):
    s = states(spark, d)
    return score.paired_states(s.select("k", F.col("a").alias("state")), s.select("k", F.col("b").alias("state")), ["k"])


@register("family_counts", f"WITH {STATES} SELECT fam, count(*) AS targets, count(*) FILTER (a = 'correct') AS correct, count(*) FILTER (a = 'wrong') AS wrong, count(*) FILTER (a = 'unknown') AS unknown FROM st GROUP BY fam")
def family_counts(spark, d):
    return score.family_counts(states(spark, d), "fam", "a", ["correct", "wrong", "unknown"])


@register("answers_equal", f"WITH {STATES} SELECT k, a AS value_a, b AS value_b FROM st WHERE a IS DISTINCT FROM b")
def answers_equal(spark, d):
    s = states(spark, d)
    return score.answers_equal(s.select("k", F.col("a").alias("v")), s.select("k", F.col("b").alias("v")), ["k"], "v")


@register("snapshot_diff", """SELECT coalesce(x.o_orderkey, y.o_orderkey) AS o_orderkey, CASE WHEN x.o_orderkey IS NULL THEN 'added' WHEN y.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM orders WHERE o_orderkey % 10 <> 1) x FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 2 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 3) y ON x.o_orderkey = y.o_orderkey
WHERE x.o_orderkey IS NULL OR y.o_orderkey IS NULL OR x.o_orderstatus <> y.s""")
def snapshot_diff(spark, d):
    o = ad.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = o.where("o_orderkey % 10 != 3").withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 10 == 2, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.col("o_totalprice") + 1})
    return score.snapshot_diff(o.where("o_orderkey % 10 != 1"), after, ["o_orderkey"], ["o_totalprice"])


@register("unknown_policy", """WITH g AS (SELECT l_orderkey AS q, list(DISTINCT l_suppkey) AS e, list(DISTINCT l_suppkey) FILTER (l_linenumber % 2 = 1) AS p FROM lineitem GROUP BY 1)
SELECT q, p IS NOT NULL AS known, len(list_intersect(e, coalesce(p, [])))::BIGINT AS tp, (len(coalesce(p, [])) - len(list_intersect(e, coalesce(p, []))))::BIGINT AS fp, (len(e) - len(list_intersect(e, coalesce(p, []))))::BIGINT AS fn,
p IS NOT NULL AND len(coalesce(p, [])) = len(e) AND len(list_intersect(e, coalesce(p, []))) = len(e) AS exact FROM g""")
def unknown_policy(spark, d):
    odd = F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey")))
    g = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set("l_suppkey").alias("expected"), F.when(F.size(odd) > 0, odd).alias("predicted"))
    return score.unknown_policy(g).drop("expected", "predicted")


@register("site_prediction", f"""WITH {ELOG}, r AS (SELECT op AS sink, field AS source, kind <> 'barrier' AS known FROM elog WHERE kind <> 'write'), pairs AS (SELECT DISTINCT x.field AS source, y.event_type AS sink FROM elog x, (SELECT DISTINCT event_type FROM events) y),
agg AS (SELECT sink, count(*) FILTER (NOT known) AS u FROM r GROUP BY sink), hit AS (SELECT DISTINCT source, sink FROM r WHERE known)
SELECT p.source, p.sink, CASE WHEN h.source IS NOT NULL THEN true WHEN g.sink IS NULL OR u > 0 THEN NULL ELSE false END AS predicted FROM pairs p LEFT JOIN hit h USING (source, sink) LEFT JOIN agg g ON g.sink = p.sink""")
def site_prediction(spark, d):
    e = ad.event_log(spark, d)
    reads = e.where("kind != 'write'").select(F.col("op").alias("sink"), F.col("field").alias("origin"), (F.col("kind") != "barrier").alias("known"))
    ops = e.select(F.col("op").alias("sink")).distinct()
    pairs = e.select(F.col("field").alias("source")).distinct().join(ops)
    return score.site_prediction(reads, pairs, "source", "sink", "origin", "known")


# ---- cost ----


@register("nearest_rank", f"""WITH {LINES}, r AS (SELECT round, mode, metric, row_number() OVER (PARTITION BY round, mode ORDER BY metric) AS rn, count(*) OVER (PARTITION BY round, mode) AS n FROM lines)
SELECT round, mode, min(metric) FILTER (rn >= greatest((n * 50 + 99) // 100, 1)) AS p50, min(metric) FILTER (rn >= greatest((n * 95 + 99) // 100, 1)) AS p95, min(metric) FILTER (rn >= greatest((n * 99 + 99) // 100, 1)) AS p99 FROM r GROUP BY 1, 2""")
def nearest_rank(spark, d):
    return cost.nearest_rank(ad.lines(spark, d), ["round", "mode"], "metric", [50, 95, 99])


@register("trial_summary", f"WITH {LINES}, t AS (SELECT round, mode, l_linestatus, sum(metric)::BIGINT AS metric FROM lines GROUP BY ALL) SELECT mode, median(metric) AS median, min(metric) AS least, max(metric) AS most, round(stddev_samp(metric) / avg(metric), 6) AS cv FROM t GROUP BY mode")
def trial_summary(spark, d):
    t = ad.lines(spark, d).groupBy("round", "mode", "l_linestatus").agg(F.sum("metric").alias("metric"))
    return cost.trial_summary(t, ["mode"], "metric").withColumn("cv", R6(F.col("cv")))


@register("paired_ratios", f"""WITH {LINES}, t AS (SELECT round, sum(metric) FILTER (mode = 'A')::DOUBLE AS a, sum(metric) FILTER (mode = 'N')::DOUBLE AS b FROM lines GROUP BY round)
SELECT round(median(a / b), 6) AS median, round(min(a / b), 6) AS least, round(max(a / b), 6) AS most, count(a / b) AS pairs, count(*) - count(a / b) AS incomplete FROM t""")
def paired_ratios(spark, d):
    t = ad.lines(spark, d).groupBy("round", "mode").agg(F.sum("metric").cast("double").alias("metric"))
    return cost.paired_ratios(t, ["round"], "mode", "metric", "A", "N").withColumns({c: R6(F.col(c)) for c in ("median", "least", "most")})


@register("baseline_delta", f"WITH {LINES}, t AS (SELECT round, mode, sum(metric)::BIGINT AS metric FROM lines GROUP BY ALL) SELECT t.round, t.mode, t.metric - b.metric AS delta FROM t JOIN t b ON b.round = t.round AND b.mode = 'N' WHERE t.mode <> 'N'")
def baseline_delta(spark, d):
    return cost.baseline_delta(ad.lines(spark, d).groupBy("round", "mode").agg(F.sum("metric").alias("metric")), ["round"], "mode", "metric", "N")


@register("grouped_stats", f"""WITH {LINES}, r AS (SELECT mode, metric, row_number() OVER (PARTITION BY mode ORDER BY metric) AS rn, count(*) OVER (PARTITION BY mode) AS n FROM lines)
SELECT mode, round(avg(metric) / 100, 4) AS mean, round(median(metric) / 100, 4) AS median, round(min(metric) / 100, 4) AS least, round(max(metric) / 100, 4) AS most, round(min(metric) FILTER (rn >= (n * 95 + 99) // 100) / 100, 4) AS p95 FROM r GROUP BY mode""")
def grouped_stats(spark, d):
    out = cost.grouped_stats(ad.lines(spark, d), ["mode"], "metric", 0.01)
    return out.select("mode", *[F.round(c, 4).alias(c) for c in ("mean", "median", "least", "most", "p95")])


REQUESTS = """req AS (SELECT (event_id % 8)::INT AS trial, epoch_us(ts) * 1000 AS scheduled_ns, epoch_us(ts) * 1000 + user_id * 1000 AS start_ns, epoch_us(ts) * 1000 + user_id * 1000 + round(value * 100)::BIGINT * 1000 AS end_ns, event_type <> 'error' AS passed, event_id, user_id FROM events)"""


def requests(spark, d):
    t = ad.micros() * 1000
    start = t + F.col("user_id") * 1000
    return ad.table(spark, d, "events").select(F.expr("cast(event_id % 8 as int)").alias("trial"), t.alias("scheduled_ns"), start.alias("start_ns"), (start + F.round(F.col("value") * 100).cast("long") * 1000).alias("end_ns"), (F.col("event_type") != "error").alias("passed"), "event_id", "user_id")


@register("request_metrics", f"""WITH {REQUESTS}, w AS (SELECT *, min(scheduled_ns) OVER (PARTITION BY trial) AS t0, CASE WHEN passed THEN end_ns - start_ns END AS l, CASE WHEN passed THEN end_ns - scheduled_ns END AS o FROM req),
r AS (SELECT *, row_number() OVER (PARTITION BY trial, passed ORDER BY l) AS rl, row_number() OVER (PARTITION BY trial, passed ORDER BY o) AS ro, count(*) OVER (PARTITION BY trial, passed) AS n FROM w)
SELECT trial, count(*) AS requests, max(start_ns - scheduled_ns) AS max_lag_ns, round(1 - count(*) FILTER (passed) / count(*), 6) AS error_rate, round(avg(l), 3) AS mean_latency_ns, round(avg(o), 3) AS mean_offered_ns,
{", ".join(f"min({c}) FILTER (passed AND r{c} >= (n * {p} + 99) // 100) AS {name}_p{p}" for c, name in (("l", "latency"), ("o", "offered")) for p in (50, 95, 99))},
round(count(*) FILTER (passed AND end_ns <= t0 + 1296000000000000) / 1296000.0::DOUBLE, 6) AS throughput, round(count(*) FILTER (passed) * 1e9 / (max(end_ns) - min(scheduled_ns)), 6) AS drained_throughput FROM r GROUP BY trial""")
def request_metrics(spark, d):
    out = cost.request_metrics(requests(spark, d), ["trial"], 1_296_000)  # half of the table's 30 days
    return out.withColumns({c: R6(F.col(c)) for c in ("error_rate", "throughput", "drained_throughput")} | {c: F.round(c, 3) for c in ("mean_latency_ns", "mean_offered_ns")})


@register("answer_delay", f"""WITH {REQUESTS}, x AS (SELECT trial, (event_id * 7919) % 100000 AS delay FROM req), r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY delay) AS rn, count(*) OVER (PARTITION BY trial) AS n FROM x)
SELECT trial, min(delay) FILTER (rn >= (n * 50 + 99) // 100) AS p50, min(delay) FILTER (rn >= (n * 95 + 99) // 100) AS p95 FROM r GROUP BY trial""")
def answer_delay(spark, d):
    r = requests(spark, d)
    ready = r.select("event_id", (F.col("end_ns") + F.col("event_id") * 7919 % 100000).alias("ready_ns"))
    return cost.answer_delay(r, ready, ["event_id"], ["trial"], [50, 95])


@register("resource_summary", """WITH s AS (SELECT user_id, event_id AS t, event_id * 3 + user_id AS cpu, round(value * 100)::BIGINT AS rss FROM events)
SELECT user_id, CASE WHEN count(*) >= 2 THEN round((max(cpu) - min(cpu)) * 100 / (max(t) - min(t)), 6) END AS cpu_percent, round(avg(rss), 6) AS rss_mean, max(rss) AS rss_peak, count(*) < 2 AS violation FROM s GROUP BY user_id""")
def resource_summary(spark, d):
    s = ad.table(spark, d, "events").select("user_id", F.col("event_id").alias("t"), (F.col("event_id") * 3 + F.col("user_id")).alias("cpu"), F.round(F.col("value") * 100).cast("long").alias("rss"))
    return cost.resource_summary(s, ["user_id"], "t", "cpu", "rss").withColumns({"cpu_percent": R6(F.col("cpu_percent")), "rss_mean": R6(F.col("rss_mean"))})


@register("capture_volume", """WITH x AS (SELECT lang, source, strlen(coalesce(text, '')) AS b FROM documents), u AS (SELECT 'lang' AS dim, lang AS value, count(*) AS events, sum(b)::BIGINT AS bytes FROM x GROUP BY lang UNION ALL SELECT 'source', source, count(*), sum(b)::BIGINT FROM x GROUP BY source)
SELECT *, round(bytes / sum(bytes) OVER (PARTITION BY dim), 6) AS share FROM u""")
def capture_volume(spark, d):
    return cost.capture_volume(ad.table(spark, d, "documents"), ["lang", "source"], F.coalesce("text", F.lit(""))).withColumn("share", R6(F.col("share")))


@register("peak_concurrency", f"""WITH {OBS}, p AS (SELECT start_us AS t, 1 AS d FROM obs UNION ALL SELECT end_us, -1 FROM obs), q AS (SELECT t, d, sum(d) AS s FROM p GROUP BY ALL)
SELECT max(c)::BIGINT AS peak, min(c)::BIGINT AS least FROM (SELECT sum(s) OVER (ORDER BY t, d) AS c FROM q)""")
def peak_concurrency(spark, d):
    return cost.peak_concurrency(ad.observations(spark, d), "start_us", "end_us", 3_600_000_000)


@register("collisions", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def collisions(spark, d):
    return cost.collisions(ad.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("context_switches", "WITH x AS (SELECT event_type, user_id, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) SELECT event_type, count(*) FILTER (b <> user_id) AS switches FROM x GROUP BY 1")
def context_switches(spark, d):
    return cost.context_switches(ad.table(spark, d, "events"), ["event_type"], ["event_id"], "user_id")


@register("thread_hops", "WITH x AS (SELECT event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events) SELECT f AS from_thread, t AS to_thread, count(*) AS n FROM x WHERE f <> t GROUP BY 1, 2")
def thread_hops(spark, d):
    return cost.thread_hops(ad.table(spark, d, "events"), ["user_id"], ["event_id"], "event_type")


@register("phase_barriers", f"WITH {OBS} SELECT event_id // 4 AS batch, max(start_us) AS last_entry, min(end_us) AS first_exit, max(start_us) < min(end_us) AS together FROM obs GROUP BY 1")
def phase_barriers(spark, d):
    return cost.phase_barriers(ad.observations(spark, d).withColumn("batch", F.expr("event_id div 4")), ["batch"], "start_us", "end_us")


@register("visit_counts", f"WITH {ELOG}, x AS (SELECT ctx, field, lead(field) OVER (PARTITION BY ctx ORDER BY seq) AS nx FROM elog) SELECT ctx, field, count(*) AS visits, count(*) FILTER (nx <= field) AS backward FROM x GROUP BY 1, 2")
def visit_counts(spark, d):
    return cost.visit_counts(ad.event_log(spark, d), ["ctx"], "seq", "field")


# ---- gates ----


@register("sequence_gate", """SELECT l_orderkey, 'sequence' AS rule, concat_ws('/', min(l_linenumber), max(l_linenumber), count(*), count(DISTINCT l_linenumber)) AS detail FROM lineitem GROUP BY 1
HAVING min(l_linenumber) <> 1 OR max(l_linenumber) - min(l_linenumber) + 1 <> count(*) OR count(DISTINCT l_linenumber) <> count(*)""")
def sequence_gate(spark, d):
    return gates.sequence_gate(ad.table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", 1)


@register("duplicate_identity_gate", "SELECT l_orderkey, l_linenumber, 'conflicting_duplicate' AS rule, count(*)::VARCHAR AS detail FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_identity_gate(spark, d):
    return gates.duplicate_identity_gate(ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey", "l_linenumber"])


@register("monotonic_gate", "WITH x AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, 'monotonic' AS rule, count(*)::VARCHAR AS detail FROM x WHERE value < b GROUP BY 1")
def monotonic_gate(spark, d):
    return gates.monotonic_gate(ad.table(spark, d, "events"), ["user_id"], ["event_id"], "value")


@register("single_context_gate", "SELECT l_orderkey, 'context' AS rule, count(DISTINCT l_returnflag) || '/' || count(*) FILTER (l_returnflag IS NULL OR l_returnflag = '0') AS detail FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) <> 1")
def single_context_gate(spark, d):
    return gates.single_context_gate(ad.table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag"])


@register("pairing_gate", f"""WITH {ELOG}, x AS (SELECT ctx, field, count(*) FILTER (kind = 'write') AS b, count(*) FILTER (kind = 'read') AS e, max(seq) FILTER (kind = 'write') AS tb, min(seq) FILTER (kind = 'read') AS te FROM elog WHERE kind <> 'barrier' GROUP BY 1, 2)
SELECT ctx, field, 'pairing' AS rule, b || '/' || e AS detail FROM x WHERE b <> 1 OR e <> 1 OR te <= tb""")
def pairing_gate(spark, d):
    return gates.pairing_gate(ad.event_log(spark, d), ["ctx", "field"], "kind", "seq", ["write"], ["read"])


@register("nesting_gate", f"""WITH {ELOG}, x AS (SELECT ctx, seq, CASE WHEN op IN ('view', 'click') THEN 1 WHEN op IN ('signup', 'purchase') THEN -1 ELSE 0 END AS s FROM elog), y AS (SELECT ctx, s, sum(s) OVER (PARTITION BY ctx ORDER BY seq) AS c FROM x)
SELECT ctx, 'nesting' AS rule, min(c) || '/' || sum(s) AS detail FROM y GROUP BY ctx HAVING min(c) < 0 OR sum(s) <> 0""")
def nesting_gate(spark, d):
    return gates.nesting_gate(ad.event_log(spark, d), ["ctx"], "seq", F.col("op").isin("view", "click"), F.col("op").isin("signup", "purchase"))


@register("nesting_frames", f"""WITH {ELOG}, x AS (SELECT ctx, seq, CASE WHEN op IN ('view', 'click') THEN 1 ELSE -1 END AS s FROM elog WHERE op IN ('view', 'click', 'signup', 'purchase')), y AS (SELECT *, sum(s) OVER (PARTITION BY ctx ORDER BY seq) AS c FROM x),
z AS (SELECT ctx, seq, s, (CASE WHEN s = 1 THEN c ELSE c + 1 END)::BIGINT AS depth FROM y), n AS (SELECT *, row_number() OVER (PARTITION BY ctx, depth, s ORDER BY seq) AS nth FROM z)
SELECT a.ctx, a.seq AS enter_seq, a.depth, b.seq AS exit_seq, (SELECT max(p.seq) FROM n p WHERE p.ctx = a.ctx AND p.depth = a.depth - 1 AND p.s = 1 AND p.seq < a.seq) AS parent_seq FROM n a LEFT JOIN n b ON b.ctx = a.ctx AND b.depth = a.depth AND b.nth = a.nth AND b.s = -1 WHERE a.s = 1""")
def nesting_frames(spark, d):
    return gates.nesting_frames(ad.event_log(spark, d), ["ctx"], "seq", F.col("op").isin("view", "click"), F.col("op").isin("signup", "purchase"))


@register("version_gate", f"WITH {ELOG}, x AS (SELECT owner, field, version AS want, CASE WHEN event_id % 97 = 0 THEN version + 1 ELSE version END AS v FROM elog) SELECT owner, field, 'version' AS rule, count(*)::VARCHAR AS detail FROM x WHERE v <> want GROUP BY 1, 2")
def version_gate(spark, d):
    log = ad.event_log(spark, d).withColumn("version", F.when(F.col("event_id") % 97 == 0, F.col("version") + 1).otherwise(F.col("version")))
    return gates.version_gate(log, ["owner", "field"], "seq", F.col("kind") == "write", "version")


@register("request_scopes", f"""WITH {ELOG}, x AS (SELECT ctx, seq, event_id, (op = 'signup')::INT AS en, (op = 'purchase')::INT AS le FROM elog),
y AS (SELECT *, sum(en) OVER w AS generation, sum(en) OVER w - coalesce(sum(le) OVER (PARTITION BY ctx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS op FROM x WINDOW w AS (PARTITION BY ctx ORDER BY seq)),
z AS (SELECT *, row_number() OVER (PARTITION BY ctx, generation ORDER BY seq) - 1 AS request_sequence, sum(le) OVER (PARTITION BY ctx, generation) AS ls FROM y)
SELECT event_id, generation::BIGINT AS generation, request_sequence, CASE WHEN en = 1 AND op > 1 THEN 'nested' WHEN op < 1 THEN 'outside' WHEN en = 1 AND ls = 0 THEN 'unclosed' ELSE 'inside' END AS scope_state FROM z""")
def request_scopes(spark, d):
    out = gates.assign_request_scopes(ad.event_log(spark, d), ["ctx"], "seq", F.col("op") == "signup", F.col("op") == "purchase")
    return out.select("event_id", "generation", F.col("request_sequence").cast("long").alias("request_sequence"), "scope_state")


@register("event_order_gate", "SELECT conv_id, 'event_order' AS rule, string_agg(role, '>' ORDER BY turn) AS detail FROM conversations GROUP BY 1 HAVING string_agg(role, '>' ORDER BY turn) NOT IN ('system>user>assistant', 'user>assistant', 'user>assistant>user>assistant')")
def event_order_gate(spark, d):
    return gates.event_order_gate(ad.table(spark, d, "conversations"), ["conv_id"], "turn", "role", [["system", "user", "assistant"], ["user", "assistant"], ["user", "assistant", "user", "assistant"]])


@register("transport_gate", """WITH g AS (SELECT o_orderkey AS k, (o_orderkey % 5 + 1)::BIGINT AS submitted, (o_orderkey % 11 = 0)::INT AS lost FROM orders), r AS (SELECT l_orderkey AS k, count(*) AS received FROM lineitem GROUP BY 1)
SELECT g.k, 'transport' AS rule, submitted || '/' || coalesce(received, 0) AS detail FROM g LEFT JOIN r USING (k) WHERE received IS NULL OR submitted <> received OR lost <> 0""")
def transport_gate(spark, d):
    stats = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5 + 1).alias("submitted"), (F.col("o_orderkey") % 11 == 0).cast("int").alias("lost"), F.lit(0).alias("errors"), F.lit(0).alias("return_code"))
    return gates.transport_gate(ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), stats, "k")


# ---- spans ----


@register("span_structure", f"""WITH {SPANS}, f AS (SELECT s.trace, count(*) FILTER (s.parent IS NULL) AS roots, count(*) FILTER (s.duration_us < 0) AS bad, count(*) FILTER (s.parent IS NOT NULL AND p.span IS NULL) AS missing FROM (SELECT * FROM spans WHERE NOT (span = 1 AND trace % 3 = 0)) s LEFT JOIN (SELECT * FROM spans WHERE NOT (span = 1 AND trace % 3 = 0)) p ON p.trace = s.trace AND p.span = s.parent GROUP BY 1)
SELECT trace, 'missing_parent' AS rule FROM f WHERE missing > 0 UNION ALL SELECT trace, 'no_root' FROM f WHERE roots = 0 UNION ALL SELECT trace, 'many_roots' FROM f WHERE roots > 1""")
def span_structure(spark, d):
    return spans.span_structure(ad.turn_spans(spark, d).where("not (span = 1 and trace % 3 = 0)"))


@register("unreachable_spans", f"WITH {SPANS} SELECT trace, span FROM spans WHERE trace % 3 = 0 AND span > 1")
def unreachable_spans(spark, d):
    return spans.unreachable_spans(ad.turn_spans(spark, d).where("not (span = 1 and trace % 3 = 0)"))


@register("service_edges", f"WITH {SPANS} SELECT DISTINCT c.trace, p.service AS from_service, c.service AS to_service FROM spans c JOIN spans p ON p.trace = c.trace AND p.span = c.parent WHERE p.service <> c.service")
def service_edges(spark, d):
    return spans.service_edges(ad.turn_spans(spark, d))


@register("producer_consumer_links", f"WITH {SPANS} SELECT c.trace, c.span, EXISTS (SELECT 1 FROM spans p WHERE p.trace = c.trace AND p.span < c.span AND p.kind = 'PRODUCER') AS linked FROM spans c WHERE c.kind = 'CONSUMER'")
def producer_consumer_links(spark, d):
    return spans.producer_consumer_links(ad.turn_spans(spark, d))


@register("runtime_errors", f"WITH {SPANS} SELECT trace, span, concat_ws(',', CASE WHEN error IS NOT NULL THEN 'error_tag' END, CASE WHEN status >= 400 THEN 'http_' || status END) AS reasons FROM spans WHERE error IS NOT NULL OR status >= 400")
def runtime_errors(spark, d):
    return spans.runtime_errors(ad.turn_spans(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


@register("nearest_observed_parent", f"WITH {SPANS}, k AS (SELECT trace, span FROM spans WHERE kind = 'CONSUMER') SELECT c.trace, c.span AS child, max(p.span) AS parent FROM k c JOIN k p ON p.trace = c.trace AND p.span < c.span GROUP BY 1, 2")
def nearest_observed_parent(spark, d):
    s = ad.turn_spans(spark, d)
    return spans.nearest_observed_parent(s, s.where("kind = 'CONSUMER'").select("trace", "span"))


# ---- joins ----


@register("unique_join", """WITH p AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2), o AS (SELECT o_orderkey AS l_orderkey, (o_orderkey % 7 + 1)::INT AS l_linenumber FROM orders)
SELECT o.l_orderkey, o.l_linenumber, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN pk END AS l_partkey FROM o LEFT JOIN p USING (l_orderkey, l_linenumber)""")
def unique_join(spark, d):
    o = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("l_linenumber"))
    return joins.unique_join(o, ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


CANDIDATES = f"""cand AS (SELECT c.event_id AS client, s.event_id AS server, s.service, s.path, abs(s.start_us - c.start_us) + abs(s.end_us - c.end_us) AS cost FROM obs c JOIN obs s ON c.kind = 'CLIENT' AND s.kind = 'SERVER' AND c.peer = s.service AND c.path = s.path AND s.start_us >= c.start_us - {SLACK} AND s.end_us <= c.end_us + {SLACK})"""


@register("transport_candidates", f"WITH {OBS}, {CANDIDATES} SELECT * FROM cand")
def transport_candidates(spark, d):
    return joins.transport_candidates(ad.observations(spark, d), SLACK)


@register("greedy_match")
def greedy_match(spark, d):
    return joins.match_calls(ad.observations(spark, d), SLACK)


@register("local_parents", f"""WITH {OBS}, x AS (SELECT c.event_id AS child, s.event_id AS parent, s.start_us, rank() OVER (PARTITION BY c.event_id ORDER BY s.start_us DESC) AS r FROM obs c JOIN obs s ON c.kind = 'CLIENT' AND s.kind = 'SERVER' AND c.service = s.service AND c.start_us >= s.start_us AND c.end_us <= s.end_us)
SELECT child, min(parent) AS parent FROM x WHERE r = 1 GROUP BY child HAVING count(*) = 1""")
def local_parents(spark, d):
    return joins.local_parents(ad.observations(spark, d))


@register("send_receive_coverage", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS matched, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unmatched_sends, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unmatched_receives")
def send_receive_coverage(spark, d):
    return joins.send_receive_coverage(ad.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ad.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@register("last_write_asof", f"""WITH {ELOG}, x AS (SELECT *, max(seq) FILTER (kind <> 'read') OVER (PARTITION BY owner, field ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls FROM elog)
SELECT x.event_id, CASE WHEN w.kind = 'write' AND w.version = x.version THEN w.event_id END AS source FROM x LEFT JOIN elog w ON w.owner = x.owner AND w.field = x.field AND w.seq = x.ls WHERE x.kind = 'read'""")
def last_write_asof(spark, d):
    return joins.last_write_asof(ad.event_log(spark, d), ["owner", "field"], "seq", "kind", "event_id", "version")


@register("alias_sources", f"""WITH {ELOG}, t AS (SELECT event_id, owner, field, version, seq FROM elog WHERE kind = 'read'), p AS (SELECT event_id AS provider, owner, field, version, seq FROM elog WHERE kind = 'write'),
g AS (SELECT t.event_id, count(p.seq) FILTER (p.seq < t.seq) AS n, min(provider) FILTER (p.seq < t.seq) AS s FROM t LEFT JOIN p USING (owner, field, version) GROUP BY 1)
SELECT event_id, CASE WHEN n = 1 THEN s END AS source, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'unknown' END AS status FROM g""")
def alias_sources(spark, d):
    e = ad.event_log(spark, d)
    return joins.alias_sources(e.where("kind = 'read'").select("event_id", "owner", "field", "version", "seq"), e.where("kind = 'write'").select(F.col("event_id").alias("provider"), "owner", "field", "version", "seq"), ["owner", "field", "version"], "event_id", "provider", "seq")


@register("property_bridge", """WITH w AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_suppkey % 3)::BIGINT AS fs, min(l_quantity) AS sent FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS service, l_quantity AS value FROM lineitem WHERE l_linestatus = 'O')
SELECT r.l_orderkey, r.l_linenumber, r.service, r.value, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN fs = service THEN 'same_service' WHEN sent <> value THEN 'value_differs' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN fs END AS from_service, CASE WHEN n = 1 THEN sent END AS sent FROM r LEFT JOIN w USING (l_orderkey, l_linenumber)""")
def property_bridge(spark, d):
    x = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("service"), F.col("l_quantity").alias("value"), "l_linestatus")
    return joins.property_bridge(x.where("l_linestatus = 'F'").drop("l_linestatus"), x.where("l_linestatus = 'O'").drop("l_linestatus"), ["l_orderkey", "l_linenumber"], "service", "value")


@register("overlapping_pairs", f"WITH {OBS} SELECT a.service, a.path, a.event_id AS a, b.event_id AS b FROM obs a JOIN obs b ON a.service = b.service AND a.path = b.path AND a.event_id < b.event_id AND greatest(a.start_us, b.start_us) < least(a.end_us, b.end_us)")
def overlapping_pairs(spark, d):
    return joins.overlapping_pairs(ad.observations(spark, d), ["service", "path"], "event_id", "start_us", "end_us", 3_600_000_000)


@register("reduction_lineage", """WITH m AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS dn, sum(l_quantity * round(l_discount * 100)) AS t, count(*) FILTER (l_partkey % 50 = 0) AS u FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS e FROM orders)
SELECT r.k, CASE WHEN n IS NULL THEN 'missing' WHEN u > 0 THEN 'unknown' WHEN e = 1 OR dn <> n THEN 'membership' WHEN e = 2 THEN 'total' ELSE 'matched' END AS status FROM r LEFT JOIN m USING (k)""")
def reduction_lineage(spark, d):
    return joins.reduction_lineage(*reduction_tables(spark, d), "k")


def reduction_tables(spark, d):
    """Members of orders, and their declared sizes and totals, some perturbed."""
    m = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("member"), F.col("l_quantity").alias("quantity"), F.round(F.col("l_discount") * 100).alias("unit_price"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey")).alias("source"))
    totals = m.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("quantity") * F.col("unit_price")).alias("t"))
    r = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4).alias("e")).join(totals, "k", "left")
    return m, r.select("k", (F.col("n") + (F.col("e") == 1).cast("int")).alias("declared"), (F.col("t") + F.when(F.col("e") == 2, 5).otherwise(0)).alias("total"))


@register("cell_join", """SELECT c.c_name AS v0, 0 AS f0, c.c_custkey AS r0, coalesce(n.n_name, '-') AS v1, CASE WHEN n.n_nationkey IS NOT NULL THEN 1 END AS f1, n.n_nationkey::BIGINT AS r1 FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n ON c.c_nationkey = n.n_nationkey""")
def cell_join(spark, d):
    c = joins.with_cells(ad.table(spark, d, "customer").select(F.col("c_custkey").alias("rec"), F.col("c_nationkey").cast("string").alias("key"), "c_name"), 0, "rec")
    n = joins.with_cells(ad.table(spark, d, "nation").where("n_nationkey % 5 != 0").select(F.col("n_nationkey").cast("long").alias("rec"), F.col("n_nationkey").cast("string").alias("key"), "n_name"), 1, "rec").drop("rec")
    out = joins.cell_join(c, n, "key", ["c_name", "n_name"], "left", "-")
    return out.select(F.col("c_name.value").alias("v0"), F.col("c_name.file").alias("f0"), F.col("c_name.record").alias("r0"), F.col("n_name.value").alias("v1"), F.col("n_name.file").alias("f1"), F.col("n_name.record").alias("r1"))


# ---- graphs ----


def turn_edges(spark, d):
    return ad.turn_spans(spark, d).select("trace", F.col("span").alias("node"), "parent")


@register("ancestors", f"WITH {SPANS} SELECT c.trace, c.span AS node, p.span AS ancestor, c.span - p.span AS distance FROM spans c JOIN spans p ON p.trace = c.trace AND p.span < c.span")
def ancestors(spark, d):
    return graph.ancestors(turn_edges(spark, d), ["trace"])


@register("backward_slice", f"WITH {SPANS}, m AS (SELECT trace, max(span) AS t FROM spans GROUP BY 1) SELECT s.trace, m.t AS root, s.span AS node FROM spans s JOIN m USING (trace)")
def backward_slice(spark, d):
    e = turn_edges(spark, d).where("parent is not null").select("trace", F.col("parent").alias("source"), F.col("node").alias("target"))
    return graph.backward_slice(e, turn_edges(spark, d).groupBy("trace").agg(F.max("node").alias("node")), ["trace"])


@register("origins", f"""WITH {SPANS}, m AS (SELECT trace, max(span) AS root FROM spans GROUP BY 1), st AS (SELECT s.trace, root, max(span) FILTER (span % 3 = 1) AS stop FROM spans s JOIN m USING (trace) GROUP BY 1, 2)
SELECT trace, root, CASE WHEN stop IS NULL THEN '0' WHEN trace % 4 = 0 THEN '' ELSE stop::VARCHAR END AS sources, NOT (stop IS NOT NULL AND trace % 4 = 0) AS known FROM st""")
def origins(spark, d):
    n = turn_edges(spark, d)
    e = n.where("parent is not null").select("trace", F.col("parent").alias("source"), F.col("node").alias("target"))
    kinds = n.select("trace", "node", F.when(F.col("node") % 3 == 1, F.when(F.col("trace") % 4 == 0, "unknown").otherwise("boundary")).otherwise("other").alias("kind"))
    out = graph.origins(e, kinds, n.groupBy("trace").agg(F.max("node").alias("node")), ["trace"])
    return out.drop("status").withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


@register("byte_ranges", f"""WITH {SPANS}, m AS (SELECT trace, max(span) AS root FROM spans GROUP BY 1), c AS (SELECT *, CASE WHEN trace % 3 = 0 THEN 0 ELSE root END AS cut FROM m)
SELECT trace, root, CASE WHEN cut < 1000 THEN 0::BIGINT END AS source, CASE WHEN cut < 1000 THEN cut END AS "start", CASE WHEN cut < 1000 THEN 1000::BIGINT END AS "end", cut = 0 AS complete FROM c""")
def byte_ranges(spark, d):
    # each turn keeps all bytes but the first of the turn before it, at the same places; every third trace keeps all
    n = turn_edges(spark, d)
    first = F.when(F.col("trace") % 3 == 0, 0).otherwise(F.col("node"))
    maps = n.where("parent is not null").select("trace", F.col("node").alias("child"), "parent", first.alias("out_start"), F.lit(1000).cast("long").alias("out_end"), first.alias("parent_start"))
    return graph.byte_ranges(maps, n.groupBy("trace").agg(F.max("node").alias("node")).withColumn("length", F.lit(1000)), ["trace"])


@register("connected_components", """WITH RECURSIVE e AS (SELECT doc_id AS a, (doc_id - doc_id % 10) AS b FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, doc_id + 10 FROM documents WHERE doc_id % 20 = 0)
SELECT x AS node, (x - x % 20) AS component FROM (SELECT a AS x FROM e UNION SELECT b FROM e)""")
def connected_components(spark, d):
    docs = ad.table(spark, d, "documents")
    near = docs.where("doc_id % 10 != 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") - F.col("doc_id") % 10).alias("dst"))
    far = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 10).alias("dst"))
    return components.connected_components(near.unionByName(far))


@register("cohort_attribution", """SELECT event_id AS record, CASE WHEN (user_id // 2) % 3 <> 0 THEN NULL ELSE (user_id // 2) * 2 END AS request, CASE WHEN (user_id // 2) % 3 = 0 THEN 'request' ELSE 'global' END AS status FROM events""")
def cohort_attribution(spark, d):
    e = ad.table(spark, d, "events")
    links = e.select(F.col("user_id").alias("a"), (F.expr("(user_id div 2) * 2")).alias("b")).distinct()
    req = links.where("(a div 2) % 3 = 0").select(F.col("b").alias("request"), F.col("b").alias("id")).distinct()
    return graph.cohort_attribution(links, e.select(F.col("event_id").alias("record"), F.col("user_id").alias("id")), req)


# ---- projections ----


@register("stratified_sample", """WITH r AS (SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY sha256('s' || c_custkey), c_custkey) AS k FROM customer),
p AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY k, c_nationkey) AS pick FROM r) SELECT c_custkey, c_mktsegment, c_nationkey, pick FROM p WHERE pick <= 40""")
def stratified_sample(spark, d):
    out = project.stratified_sample(ad.table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_custkey", 40, "s")
    return out.select("c_custkey", "c_mktsegment", "c_nationkey", F.col("pick").cast("long").alias("pick"))


@register("assign_opaque_ids", "SELECT event_id, sha256('salt|' || event_id || '|' || user_id) AS opaque_id FROM events")
def assign_opaque_ids(spark, d):
    return project.assign_opaque_ids(ad.table(spark, d, "events"), ["event_id", "user_id"], "salt").select("event_id", "opaque_id")


@register("generalise_path", "SELECT page_id, regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/[0-9]+(/|$)', '/*\\1', 'g') AS path FROM pages")
def generalise_path(spark, d):
    return ad.table(spark, d, "pages").select("page_id", project.generalise_path(project.url_path(F.col("url"))).alias("path"))


@register("classify_exposure", "SELECT CASE WHEN v = '' THEN 'absent_or_empty' WHEN v = o THEN 'full_value_returned' WHEN regexp_full_match(v, '[*]*[0-9]{4}') AND v LIKE '*%' THEN 'last_four_only_or_masked' ELSE 'different_value_needs_review' END AS exposure, count(*) AS n FROM (SELECT c_name AS o, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN '****' || right(c_name, 4) ELSE 'other' END AS v FROM customer) GROUP BY 1")
def classify_exposure(spark, d):
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, "").when(k == 1, F.col("c_name")).when(k == 2, F.concat(F.lit("****"), F.right("c_name", F.lit(4)))).otherwise("other")
    return ad.table(spark, d, "customer").groupBy(project.classify_exposure(v, F.col("c_name")).alias("exposure")).agg(F.count("*").alias("n"))


@register("json_leaves", "SELECT event_id, '/k' AS path, regexp_extract(props, '([0-9]+)', 1) AS value FROM events")
def json_leaves(spark, d):
    return project.json_leaves(ad.table(spark, d, "events"), "props", ["event_id"], "pointer")
