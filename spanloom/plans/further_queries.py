"""Registered queries of violations, reasons and rarer parts of the operators, on tables with branches, cycles and holes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import project
from ..operators import cost, evidence, gates, graph, joins, score, spans
from ..scratch import shared_dir
from ..sources import files
from . import adapters as ad
from .adapters import ELOG, LINES, OBS, SPANS
from .registry import register

#: Trees with branches (parent = half), cycles (of two nodes, below them more) and missing parents, from customers.
TREE = """tree AS (SELECT c_custkey // 64 AS g, c_custkey % 64 AS node, CASE WHEN c_custkey % 64 = 0 THEN NULL WHEN (c_custkey // 64) % 3 = 1 AND c_custkey % 64 = 2 THEN 5 WHEN (c_custkey // 64) % 3 = 2 AND c_custkey % 64 = 3 THEN 99 ELSE (c_custkey % 64) // 2 END AS parent FROM customer)"""


def tree(spark, d):
    key = F.col("c_custkey").cast("long")
    rows = ad.table(spark, d, "customer").select(F.expr("bigint(c_custkey div 64)").alias("g"), (key % 64).alias("node"))
    parent = F.when(F.col("node") == 0, None).when((F.col("g") % 3 == 1) & (F.col("node") == 2), 5).when((F.col("g") % 3 == 2) & (F.col("node") == 3), 99).otherwise(F.expr("node div 2")).cast("long")
    return rows.withColumn("parent", parent)


WALK = f"""{TREE}, walk AS (SELECT g, node, node AS place, parent, 0::BIGINT AS distance FROM tree UNION ALL SELECT w.g, w.node, t.node, t.parent, w.distance + 1 FROM walk w JOIN tree t ON t.g = w.g AND t.node = w.parent WHERE w.distance < 80),
ended AS (SELECT g, node, arg_max(place, distance) AS top, max(distance) AS distance, (arg_max({{'p': parent}}, distance)).p AS beyond FROM walk GROUP BY 1, 2)"""


@register("root_of", f"""WITH RECURSIVE {WALK} SELECT g, node, CASE WHEN distance >= 80 THEN NULL WHEN beyond IS NOT NULL THEN beyond ELSE top END AS root, CASE WHEN distance >= 80 THEN NULL WHEN beyond IS NOT NULL THEN distance + 1 ELSE distance END AS distance,
CASE WHEN distance >= 80 THEN 'cycle' WHEN beyond IS NOT NULL THEN 'missing_parent' ELSE 'root' END AS status FROM ended""")
def root_of(spark, d):
    return graph.root_of(tree(spark, d), ["g"])


@register("ancestors_branching", f"""WITH RECURSIVE {WALK}, a AS (SELECT g, node, parent AS ancestor, distance + 1 AS distance FROM walk WHERE parent IS NOT NULL)
SELECT a.* FROM a JOIN ended o ON o.g = a.g AND o.node = a.node AND o.distance < 80 UNION ALL SELECT g, node, NULL, NULL FROM ended WHERE distance >= 80""")
def ancestors_branching(spark, d):
    return graph.ancestors(tree(spark, d), ["g"])


@register("span_structure_cycles", f"""WITH RECURSIVE {WALK} SELECT DISTINCT g AS trace, CASE WHEN distance >= 80 THEN 'cycle' ELSE 'missing_parent' END AS rule FROM ended WHERE distance >= 80 OR beyond IS NOT NULL UNION SELECT g, 'no_root' FROM tree GROUP BY g HAVING min(node) > 0 UNION SELECT g, 'bad_duration' FROM tree WHERE node = 7 AND g % 5 = 0""")
def span_structure_cycles(spark, d):
    t = tree(spark, d).select(F.col("g").alias("trace"), F.col("node").alias("span"), "parent", F.lit("s").alias("service"), F.when((F.col("node") == 7) & (F.col("g") % 5 == 0), -1).otherwise(1).alias("duration_us"))
    return spans.span_structure(t, "^[0-9]+$")


@register("reach", f"""WITH RECURSIVE {TREE}, r AS (SELECT g, node AS root, node FROM tree WHERE node IN (1, 2) UNION SELECT r.g, r.root, t.node FROM r JOIN tree t ON t.g = r.g AND t.parent = r.node) SELECT r.g, r.root, r.node AS parent, t.node AS child FROM r JOIN tree t ON t.g = r.g AND t.parent = r.node""")
def reach(spark, d):
    t = tree(spark, d)
    edges = t.where("parent is not null").select("g", "parent", F.col("node").alias("child"))
    return graph.used_edges(edges, graph.reach(edges, t.where("node in (1, 2)").select("g", "node"), ["g"]), ["g"])


@register("slice_report", f"""WITH RECURSIVE {TREE}, r AS (SELECT g, node AS root, node FROM tree WHERE node IN (9, 21) UNION SELECT r.g, r.root, t.parent FROM r JOIN tree t ON t.g = r.g AND t.node = r.node AND t.parent IS NOT NULL), s AS (SELECT g, node FROM tree WHERE node < 6)
SELECT q.g, q.root, s.node, r.node IS NOT NULL AS contributes FROM (SELECT DISTINCT g, root FROM r) q JOIN s ON s.g = q.g LEFT JOIN r ON r.g = q.g AND r.root = q.root AND r.node = s.node""")
def slice_report(spark, d):
    t = tree(spark, d)
    edges = t.where("parent is not null").select("g", F.col("parent").alias("source"), F.col("node").alias("target"))
    sliced = graph.backward_slice(edges, t.where("node in (9, 21)").select("g", "node"), ["g"])
    return graph.slice_report(t.select("g", "node", F.when(F.col("node") < 6, "source").otherwise("other").alias("kind")), sliced, ["g"])


@register("closure_violations", """WITH f AS (SELECT DISTINCT user_id AS f FROM events) SELECT f AS fact, 'observed_and_derived' AS rule FROM f WHERE f % 10 = 0 UNION ALL SELECT f + 100000, 'missing' FROM f WHERE f % 10 = 1 UNION ALL SELECT f + k, 'cycle' FROM f, (VALUES (200000), (300000)) v(k) WHERE f % 10 = 2""")
def closure_violations(spark, d):
    f = ad.table(spark, d, "events").select(F.col("user_id").cast("long").alias("f")).distinct()
    rule = lambda k, a, b: f.where(f"f % 10 = {k}").select((F.col("f") + a).alias("fact"), (F.col("f") + b).alias("dependency"))
    rules = rule(0, 0, 500000).unionByName(rule(1, 400000, 100000)).unionByName(rule(2, 200000, 300000)).unionByName(rule(2, 300000, 200000))
    seen = f.where("f % 10 = 0").select("f").unionByName(f.where("f % 10 = 0").select((F.col("f") + 500000).alias("f"))).withColumnRenamed("f", "fact")
    return graph.closure_violations(seen, rules, rules.where("fact != dependency and fact < 500000").select("fact").distinct())


@register("missing_edges", f"""WITH {SPANS}, x AS (SELECT DISTINCT trace, p.service AS f, c.service AS t FROM spans c JOIN spans p USING (trace) WHERE p.span = c.parent AND p.service <> c.service), w AS (SELECT * FROM (VALUES ('system', 'user'), ('user', 'assistant'), ('assistant', 'system')) v(f, t))
SELECT q.trace, w.f AS from_service, w.t AS to_service FROM (SELECT DISTINCT trace FROM spans) q, w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.trace = q.trace AND x.f = w.f AND x.t = w.t)""")
def missing_edges(spark, d):
    t = ad.turn_spans(spark, d)
    expected = spark.createDataFrame([("system", "user"), ("user", "assistant"), ("assistant", "system")], "from_service string, to_service string")
    return spans.missing_edges(spans.service_edges(t), expected, t)


@register("edge_relations", f"""WITH {OBS} SELECT a.event_id // 8 AS trace, b.event_id AS child, a.event_id AS parent, CASE WHEN a.kind = 'SERVER' AND b.kind = 'CLIENT' AND a.service = b.service THEN 'local' WHEN a.kind = 'CLIENT' AND b.kind = 'SERVER' THEN CASE WHEN a.peer = b.service AND a.path = b.path THEN 'transport' ELSE 'endpoints_differ' END ELSE 'unexpected' END AS relation
FROM obs a JOIN obs b ON b.event_id = a.event_id + 1 AND a.event_id // 8 = b.event_id // 8""")
def edge_relations(spark, d):
    o = ad.observations(spark, d).select(F.expr("event_id div 8").alias("trace"), F.col("event_id").alias("span"), "kind", "service", "peer", F.lit("GET").alias("method"), "path")
    links = o.select("trace", (F.col("span") + 1).alias("child"), F.col("span").alias("parent"))
    return spans.edge_relations(links, o)


@register("leak_check_anywhere", "SELECT DISTINCT p.page_id::VARCHAR AS id FROM pages p JOIN pages q ON contains(q.url, p.page_id::VARCHAR)")
def leak_check_anywhere(spark, d):
    p = ad.table(spark, d, "pages")
    return project.leak_check(p, p.select(F.col("page_id").cast("string").alias("id")), "url", "id", substring=True)


@register("observation_violations", "SELECT page_id AS trace, 1::BIGINT AS span, unnest(list_filter([CASE WHEN page_id % 7 = 0 THEN 'bad_timing' END, CASE WHEN page_id % 5 = 0 THEN 'bad_path' END], lambda x: x IS NOT NULL)) AS rule FROM pages")
def observation_violations(spark, d):
    url = F.when(F.col("page_id") % 5 == 0, "https://host").otherwise("https://host/a")
    p = ad.table(spark, d, "pages").select(F.col("page_id").alias("trace"), F.lit(1).cast("long").alias("span"), F.lit("s").alias("service"), F.lit("CLIENT").alias("kind"), F.create_map(F.lit("http.method"), F.lit("get"), F.lit("http.url"), url).alias("tags"), F.lit(0).alias("start_us"), F.when(F.col("page_id") % 7 == 0, -1).otherwise(1).alias("duration_us"))
    return project.observation_violations(p, ["s"])


@register("json_leaves_nested", """WITH x AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer) SELECT k, '$["a/b"]["é~"][0]' AS path, n AS value FROM x UNION ALL SELECT k, '$["a/b"]["é~"][1]["z"]', m FROM x""")
def json_leaves_nested(spark, d):
    nested = F.concat(F.lit('{"a/b": {"é~": ["'), "c_name", F.lit('", {"z": "'), "c_mktsegment", F.lit('", "short": "x", "n": 5}]}}'))
    return project.json_leaves(ad.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), nested.alias("j")), "j", ["k"])


@register("alias_values", f"""WITH {ELOG}, t AS (SELECT event_id, owner, field, version, seq, op FROM elog WHERE kind = 'read'), p AS (SELECT event_id AS provider, owner, field, version, seq, op FROM elog WHERE kind = 'write'),
g AS (SELECT t.event_id, count(p.seq) FILTER (p.seq < t.seq) AS n, min(provider) FILTER (p.seq < t.seq) AS s, count(*) FILTER (p.seq < t.seq AND p.op <> t.op) AS c FROM t LEFT JOIN p USING (owner, field, version) GROUP BY 1)
SELECT event_id, CASE WHEN n = 1 AND c = 0 THEN s END AS source, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 AND c = 0 THEN 'matched' ELSE 'unknown' END AS status FROM g""")
def alias_values(spark, d):
    e = ad.event_log(spark, d)
    return joins.alias_sources(e.where("kind = 'read'").select("event_id", "owner", "field", "version", "seq", "op"), e.where("kind = 'write'").select(F.col("event_id").alias("provider"), "owner", "field", "version", "seq", "op"), ["owner", "field", "version"], "event_id", "provider", "seq", ["op"])


@register("value_edges_in_context", f"""WITH {OBS}, tx AS (SELECT event_id AS tx, (event_id % 4) AS client, service AS server, start_us AS s, end_us AS e FROM obs WHERE event_id % 3 = 0),
n AS (SELECT tx * 4 + k AS node, tx, CASE WHEN k < 2 THEN 'request' ELSE 'response' END AS direction, CASE WHEN k % 2 = 0 THEN 'send' ELSE 'receive' END AS side, CASE WHEN k IN (0, 3) THEN client ELSE server END AS service, 'v' || (tx % 40) AS value, CASE WHEN k < 2 THEN s ELSE e END AS t FROM tx, range(4) r(k)),
x AS (SELECT a.node AS source, b.node AS target, c.tx AS context FROM n a JOIN n b ON a.side = 'receive' AND b.side = 'send' AND a.service = b.service AND a.value = b.value AND a.t <= b.t JOIN tx u ON u.tx = a.tx JOIN tx c ON c.server = a.service
WHERE (b.direction = 'request' AND c.s <= b.t AND b.t <= c.e OR b.direction = 'response' AND c.tx = b.tx) AND (a.direction = 'request' AND c.tx = a.tx OR a.direction = 'response' AND u.client = a.service AND c.s <= u.s AND a.t <= c.e))
SELECT source, target, array_to_string(list_sort(list(DISTINCT context)), ',') AS contexts FROM x GROUP BY 1, 2""")
def value_edges_in_context(spark, d):
    tx = ad.observations(spark, d).where("event_id % 3 = 0").select(F.col("event_id").alias("tx"), (F.col("event_id") % 4).cast("int").alias("client"), F.col("service").alias("server"), F.col("start_us").alias("request_start_us"), F.col("end_us").alias("response_end_us"))
    k = F.col("k")
    at = F.when(k < 2, F.col("request_start_us")).otherwise(F.col("response_end_us"))
    nodes = tx.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select((F.col("tx") * 4 + k).alias("node"), "tx", F.when(k < 2, "request").otherwise("response").alias("direction"), F.when(k % 2 == 0, "send").otherwise("receive").alias("side"), F.when(k.isin(0, 3), F.col("client")).otherwise(F.col("server")).alias("service"), F.concat(F.lit("v"), (F.col("tx") % 40).cast("string")).alias("value"), at.alias("start_us"), at.alias("end_us"))
    return evidence.value_edges_in_context(nodes, tx, separator=",")


@register("reduction_sources", """SELECT DISTINCT l_orderkey AS k, l_partkey AS source FROM lineitem l WHERE l_orderkey % 4 IN (0, 3) AND l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) FILTER (l_partkey % 50 = 0) = 0 AND count(DISTINCT l_linenumber) = count(*))""")
def reduction_sources(spark, d):
    from .queries import reduction_tables

    members, results = reduction_tables(spark, d)
    return joins.reduction_sources(members, joins.reduction_lineage(members, results, "k"), "k")


@register("prf", "WITH c AS (SELECT o_custkey % 20 AS g, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 4 = 0) AS tp, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 7 = 1) AS fp, count(*) FILTER (o_custkey % 5 = 0 AND o_orderkey % 5 = 2) AS fn FROM orders GROUP BY 1) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS \"precision\", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def prf(spark, d):
    c = ad.table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("g")).agg(F.count_if(F.expr("o_orderkey % 3 = 0 and o_orderkey % 4 = 0")).alias("tp"), F.count_if(F.expr("o_orderkey % 3 = 0 and o_orderkey % 7 = 1")).alias("fp"), F.count_if(F.expr("o_custkey % 5 = 0 and o_orderkey % 5 = 2")).alias("fn"))
    return score.prf(c).withColumns({k: F.round(k, 6) for k in ("precision", "recall", "f1")})


@register("retention", """WITH st AS (SELECT o_orderstatus = 'F' AS a, o_custkey % 3 <> 0 AS b FROM orders) SELECT round(count(*) FILTER (a AND b) / count(*) FILTER (b), 6) AS retention FROM st""")
def retention(spark, d):
    s = ad.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "correct").otherwise("wrong").alias("a"), F.when(F.col("o_custkey") % 3 != 0, "correct").otherwise("unknown").alias("b"))
    pairs = score.paired_states(s.select("o_orderkey", F.col("a").alias("state")), s.select("o_orderkey", F.col("b").alias("state")), ["o_orderkey"])
    return score.retention(pairs).withColumn("retention", F.round("retention", 6))


@register("capability_gaps", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN 'wrong' END AS state_a FROM orders WHERE o_custkey % 3 <> 0 AND (o_orderstatus <> 'F' OR o_orderkey % 11 = 0)")
def capability_gaps(spark, d):
    o = ad.table(spark, d, "orders")
    a = o.where("o_orderkey % 11 != 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "correct").otherwise("wrong").alias("state"))
    return score.capability_gaps(a, o.select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, "correct").otherwise("unknown").alias("state")), ["o_orderkey"])


@register("answers_by_occurrence", f"""WITH {ELOG}, x AS (SELECT ctx, kind, op, field, event_id, row_number() OVER (PARTITION BY ctx, kind, op ORDER BY seq) - 1 AS occurrence FROM elog), a AS (SELECT * FROM x), b AS (SELECT * FROM x WHERE event_id % 17 <> 0)
SELECT ctx, kind, op, occurrence, a.field AS value_a, CASE WHEN b.ctx IS NOT NULL THEN b.field + (b.event_id % 19 = 0)::INT END AS value_b FROM a LEFT JOIN b USING (ctx, kind, op, occurrence) WHERE b.ctx IS NULL OR b.event_id % 19 = 0""")
def answers_by_occurrence(spark, d):
    # two runs whose object ids have nothing in common
    e = score.occurrence_names(ad.event_log(spark, d), ["ctx"], "kind", "op", ["seq"])
    run = lambda rows, shift: rows.select("ctx", "kind", "op", "occurrence", (F.col("field") + shift).alias("value"))
    second = run(e.where("event_id % 17 != 0"), (F.col("event_id") % 19 == 0).cast("int"))
    return score.answers_equal(run(e, F.lit(0)), second, ["ctx", "kind", "op", "occurrence"], "value")


@register("reduction", f"""WITH {LINES}, t AS (SELECT mode, l_linestatus AS app, round, count(*) AS ev, median(metric) AS lat FROM lines GROUP BY 1, 2, 3), p AS (SELECT app, round FROM t WHERE mode IN ('A', 'N') GROUP BY 1, 2 HAVING count(*) = 2), u AS (SELECT * FROM t WHERE mode IN ('A', 'N'))
SELECT u.app, round(1 - sum(ev) FILTER (mode = 'N' AND p.app IS NOT NULL) / sum(ev) FILTER (mode = 'A' AND p.app IS NOT NULL), 6) AS events_saved, round(median(lat) FILTER (mode = 'N' AND p.app IS NOT NULL) / median(lat) FILTER (mode = 'A' AND p.app IS NOT NULL), 6) AS latency_ratio, count(*) FILTER (p.app IS NULL) AS unpaired FROM u LEFT JOIN p ON p.app = u.app AND p.round = u.round GROUP BY 1""")
def reduction(spark, d):
    t = ad.lines(spark, d).groupBy("mode", F.col("l_linestatus").alias("app"), "round").agg(F.count("*").alias("ev"), F.median("metric").alias("lat"))
    return cost.reduction(t, ["app"], "mode", "ev", "lat", "A", "N", ["round"]).withColumns({c: F.round(c, 6) for c in ("events_saved", "latency_ratio")})


@register("unknown_by_field", f"WITH {ELOG} SELECT field, count(*) AS unknown FROM elog WHERE kind = 'barrier' GROUP BY 1")
def unknown_by_field(spark, d):
    return cost.unknown_by_field(ad.event_log(spark, d).withColumn("known", F.col("kind") != "barrier"), "field", "known")


@register("phase_population", "WITH q AS (SELECT o_orderpriority AS mode, CASE WHEN o_orderkey % 5 = 0 THEN 'warm-up' ELSE 'steady' END AS phase, o_custkey % 3 AS tp, o_custkey % 2 AS fp, o_orderkey % 2 AS fn, o_orderstatus <> 'P' AS known FROM orders) SELECT mode, phase, count(*) AS queries, count(*) FILTER (fp = 0 AND fn = 0) AS exact, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) FILTER (NOT known) AS unknown FROM q GROUP BY 1, 2")
def phase_population(spark, d):
    q = ad.table(spark, d, "orders").select(F.col("o_orderpriority").alias("mode"), F.expr("if(o_orderkey % 5 = 0, 'warm-up', 'steady')").alias("phase"), (F.col("o_custkey") % 3).alias("tp"), (F.col("o_custkey") % 2).alias("fp"), (F.col("o_orderkey") % 2).alias("fn"), (F.col("o_orderstatus") != "P").alias("known"))
    return cost.phase_population(q.withColumn("exact", F.expr("fp = 0 and fn = 0")), ["mode", "phase"])


@register("group_memory", f"""WITH {ELOG}, s AS (SELECT ctx % 10 AS g, event_id // 40 AS snap, op AS member, max(event_id % 1000) AS rss FROM elog GROUP BY 1, 2, 3), m AS (SELECT g, count(DISTINCT member) AS n FROM s GROUP BY 1), x AS (SELECT s.g, snap, sum(rss) AS r FROM s JOIN m USING (g) GROUP BY 1, 2, n HAVING count(*) = n)
SELECT m.g, count(x.snap) AS snapshots, round(avg(r), 6) AS rss_mean, max(r)::BIGINT AS rss_peak, count(x.snap) < 2 AS violation FROM m LEFT JOIN x USING (g) GROUP BY 1""")
def group_memory(spark, d):
    s = ad.event_log(spark, d).groupBy((F.col("ctx") % 10).alias("g"), F.expr("event_id div 40").alias("snap"), F.col("op").alias("member")).agg(F.max(F.col("event_id") % 1000).alias("rss"))
    return cost.group_memory(s, ["g"], "snap", "member", "rss").withColumn("rss_mean", F.round("rss_mean", 6))


@register("thread_migration", f"WITH {ELOG}, x AS (SELECT ctx, op, lag(op) OVER (PARTITION BY ctx ORDER BY seq) AS b FROM elog) SELECT ctx, count(DISTINCT op) AS threads, count(*) FILTER (b <> op) AS hops, count(DISTINCT op) > 1 AS migrated FROM x GROUP BY 1")
def thread_migration(spark, d):
    return cost.thread_migration(ad.event_log(spark, d), ["ctx"], ["seq"], "op")


@register("request_ids", f"""WITH {ELOG}, x AS (SELECT ctx, seq, event_id, sum((op = 'signup')::INT) OVER (PARTITION BY ctx ORDER BY seq) AS g FROM elog), o AS (SELECT ctx, g, min(event_id) AS e FROM x WHERE g > 0 GROUP BY 1, 2)
SELECT ctx, g::BIGINT AS generation, row_number() OVER (ORDER BY e) AS request_id FROM o""")
def request_ids(spark, d):
    scoped = gates.assign_request_scopes(ad.event_log(spark, d), ["ctx"], "seq", F.col("op") == "signup", F.col("op") == "purchase")
    return gates.request_ids(scoped, ["ctx"], "event_id", 4096)


@register("final_version_gate", f"""WITH {ELOG}, s AS (SELECT owner, field, max(version) AS last, CASE WHEN owner % 6 = 0 THEN max(version) + 1 ELSE max(version) END AS v FROM elog GROUP BY 1, 2), w AS (SELECT owner, field, max(version) AS w FROM elog WHERE kind = 'write' GROUP BY 1, 2)
SELECT owner, field, 'final_version' AS rule, v || '/' || coalesce(w::VARCHAR, 'none') AS detail FROM s LEFT JOIN w USING (owner, field) WHERE w IS NULL OR v <> w""")
def final_version_gate(spark, d):
    log = ad.event_log(spark, d)
    snapshots = log.groupBy("owner", "field").agg((F.max("version") + F.when(F.col("owner") % 6 == 0, 1).otherwise(0)).alias("version"))
    return gates.final_version_gate(log, snapshots, [], ["owner", "field"], "seq", F.col("kind") == "write", "version")


@register("task_gets_gate", f"""WITH {ELOG}, d AS (SELECT owner, field, version, min(seq) AS done, arg_min(event_id % 2, seq) AS r FROM elog WHERE op IN ('view', 'error') GROUP BY 1, 2, 3)
SELECT owner, field, version, CASE WHEN done IS NULL OR done >= seq THEN 'get_before_end' ELSE 'other_result' END AS rule, seq::VARCHAR AS detail FROM elog LEFT JOIN d USING (owner, field, version) WHERE op = 'click' AND (done IS NULL OR done >= seq OR event_id % 2 <> r)""")
def task_gets_gate(spark, d):
    names = F.create_map(*[F.lit(x) for p in {"click": "get", "view": "end", "error": "throw"}.items() for x in p])
    return gates.task_gets_gate(ad.event_log(spark, d).withColumns({"step": names[F.col("op")], "result": F.col("event_id") % 2}), ["owner", "field", "version"], "step", "seq", "result")


@register("transport_identities", """SELECT o_orderkey AS k, 'balance' AS rule, 'allocated = registered + retired' AS detail FROM orders WHERE o_orderkey % 9 = 4""")
def transport_identities(spark, d):
    o = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    stats = o.select("k", F.lit(1).alias("submitted"), F.lit(0).alias("lost"), (F.col("k") % 9).alias("allocated"), F.when(F.col("k") % 9 == 4, 1).otherwise(F.col("k") % 9).alias("registered"), F.lit(0).alias("retired"))
    return gates.transport_gate(o, stats, "k", ["lost"], {"balance": "allocated = registered + retired"})


@register("wire_responses", """WITH r AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS num, min(l_suppkey % 3) AS src FROM lineitem GROUP BY 1), q AS (SELECT o_orderkey AS k, o_orderkey % 2 + 1 AS rin, o_orderkey % 3 AS dst FROM orders), x AS (SELECT q.k, num, CASE WHEN n IS NULL THEN 'missing_response' WHEN n > 1 THEN 'ambiguous_response' WHEN rin <> num THEN 'back_reference' WHEN src <> dst THEN 'endpoint' ELSE 'matched' END AS reason FROM q LEFT JOIN r USING (k))
SELECT k, reason, CASE WHEN reason = 'matched' THEN num END AS response, CASE WHEN reason = 'matched' THEN 200 END AS http_status FROM x""")
def wire_responses(spark, d):
    q = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(9).cast("long").alias("src"), (F.col("o_orderkey") % 3).alias("dst"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("response_in"))
    r = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("number"), (F.col("l_suppkey") % 3).alias("src"), F.lit(9).cast("long").alias("dst"), F.lit(200).alias("status"))
    return evidence.wire_responses(q, r, ["k"])


@register("private_range_conflicts", f"""WITH {OBS}, x AS (SELECT event_id AS request, start_us AS born, end_us AS died, event_id % 500 * 10 AS low, event_id % 500 * 10 + 25 AS high FROM obs WHERE end_us > start_us)
SELECT a.request AS "first", b.request AS "second" FROM x a JOIN x b ON a.request < b.request AND greatest(a.born, b.born) < least(a.died, b.died) AND greatest(a.low, b.low) < least(a.high, b.high)""")
def private_range_conflicts(spark, d):
    x = ad.observations(spark, d).where("end_us > start_us").select(F.col("event_id").alias("request"), F.col("start_us").alias("born"), F.col("end_us").alias("died"), (F.col("event_id") % 500 * 10).alias("low"), (F.col("event_id") % 500 * 10 + 25).alias("high"))
    return joins.private_range_conflicts(x, 3_600_000_000)


@register("read_events", "SELECT event_type AS role, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def read_events(spark, d):
    """Events written as one file of JSON lines a role, then read back by it."""
    import uuid

    path = f"{shared_dir(spark)}/roles-{uuid.uuid4().hex}"
    e = ad.table(spark, d, "events").select("event_id", "event_type", "user_id")
    for role in [r[0] for r in e.select("event_type").distinct().collect()]:
        files.write_report(e.where(F.col("event_type") == role), f"{path}/{role}", "json")
    rows = files.read_events(spark, f"{path}/*", "event_id long, event_type string, user_id long", folder=True)
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@register("verify_manifest", "SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'changed' WHEN page_id % 17 = 0 THEN 'extra' ELSE 'missing' END AS change FROM pages WHERE page_id % 13 = 0 OR page_id % 17 = 0 OR page_id % 19 = 0")
def verify_manifest(spark, d):
    p = ad.table(spark, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
    got = p.where("page_id % 19 != 0 or page_id % 13 = 0 or page_id % 17 = 0").withColumn("sha256", F.when(F.col("page_id") % 13 == 0, "other").otherwise(F.col("sha256")))
    return files.verify_manifest(got, p.where("page_id % 17 != 0 or page_id % 13 = 0"), "page_id")
