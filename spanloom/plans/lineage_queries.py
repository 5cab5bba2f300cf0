"""Registered queries of repeated and torn trees, general graphs, two services, planted call trees, and rarer options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import project
from ..operators import cost, evidence, gates, graph, joins, network, score, spans
from ..scratch import materialize
from . import adapters as ad
from .adapters import ELOG, LINES, OBS, SPANS
from .further_queries import WALK, tree
from .registry import register

# ---- trees whose rows come twice, and nodes with two parents ----

TORN = "torn AS (SELECT DISTINCT g, node FROM walk WHERE place = 4 AND g % 5 = 4)"


def torn_tree(spark, d):
    """Each row of the trees twice; node 4 of some has a second parent."""
    t = tree(spark, d)
    return t.unionByName(t).unionByName(t.where("node = 4 and g % 5 = 4").withColumn("parent", F.lit(1).cast("long")))


@register("root_of_repeated", f"""WITH RECURSIVE {WALK}, {TORN} SELECT g, node, CASE WHEN t.node IS NOT NULL OR distance >= 80 THEN NULL WHEN beyond IS NOT NULL THEN beyond ELSE top END AS root,
CASE WHEN t.node IS NOT NULL OR distance >= 80 THEN NULL WHEN beyond IS NOT NULL THEN distance + 1 ELSE distance END AS distance, CASE WHEN t.node IS NOT NULL THEN 'many_parents' WHEN distance >= 80 THEN 'cycle' WHEN beyond IS NOT NULL THEN 'missing_parent' ELSE 'root' END AS status FROM ended LEFT JOIN torn t USING (g, node)""")
def root_of_repeated(spark, d):
    return graph.root_of(torn_tree(spark, d), ["g"])


@register("ancestors_repeated", f"""WITH RECURSIVE {WALK}, {TORN}, bad AS (SELECT g, node FROM torn UNION SELECT g, node FROM ended WHERE distance >= 80), a AS (SELECT g, node, parent AS ancestor, distance + 1 AS distance FROM walk WHERE parent IS NOT NULL)
SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.g = a.g AND b.node = a.node) UNION ALL SELECT g, node, NULL, NULL FROM bad""")
def ancestors_repeated(spark, d):
    return graph.ancestors(torn_tree(spark, d), ["g"])


@register("span_structure_repeated", f"""WITH RECURSIVE {WALK}, {TORN} SELECT DISTINCT g AS trace, CASE WHEN t.node IS NOT NULL THEN 'conflicting_parents' WHEN distance >= 80 THEN 'cycle' ELSE 'missing_parent' END AS rule FROM ended LEFT JOIN torn t USING (g, node) WHERE t.node IS NOT NULL OR distance >= 80 OR beyond IS NOT NULL""")
def span_structure_repeated(spark, d):
    t = torn_tree(spark, d).select(F.col("g").alias("trace"), F.col("node").alias("span"), "parent", F.lit("s").alias("service"), F.lit(1).alias("duration_us"))
    return spans.span_structure(t)


# ---- general graphs ----

MESH = """node AS (SELECT c_custkey // 64 AS g, c_custkey % 64 AS node FROM customer),
edge AS (SELECT g, node // 2 AS source, node AS target FROM node WHERE node > 1 UNION SELECT g, node // 3, node FROM node WHERE node > 2 UNION SELECT g, 40, 10 FROM node WHERE node = 40 AND g % 3 = 1),
kinds AS (SELECT g, node, CASE WHEN node % 16 = 5 THEN 'boundary' WHEN node = 7 AND g % 4 = 2 THEN 'unknown' WHEN node = 1 AND g % 2 = 1 THEN 'unbound' ELSE 'other' END AS kind FROM node)"""
ORIGINS = f"""{MESH}, r AS (SELECT g, node AS root, node FROM node WHERE node IN (9, 21, 50, 63) UNION SELECT r.g, r.root, e.source FROM r JOIN kinds k ON k.g = r.g AND k.node = r.node AND k.kind IN ('other', 'unbound') JOIN edge e ON e.g = r.g AND e.target = r.node),
c AS (SELECT g, target AS a, source AS b FROM edge JOIN kinds k USING (g) WHERE k.node = target AND kind IN ('other', 'unbound') UNION SELECT c.g, c.a, e.source FROM c JOIN kinds k ON k.g = c.g AND k.node = c.b AND k.kind IN ('other', 'unbound') JOIN edge e ON e.g = c.g AND e.target = c.b),
x AS (SELECT r.*, kind, NOT EXISTS (SELECT 1 FROM edge e WHERE e.g = r.g AND e.target = r.node) OR kind IN ('boundary', 'unknown') AS leaf, EXISTS (SELECT 1 FROM c WHERE c.g = r.g AND c.a = r.node AND c.b = r.node) AS cyc FROM r JOIN kinds USING (g, node)),
o AS (SELECT g, root, bool_or(cyc) AS cyc, list_sort(list(node) FILTER (kind = 'boundary' OR leaf AND kind <> 'unknown')) AS s, count(*) FILTER ({{doubt}}) = 0 AS known FROM x GROUP BY 1, 2)
SELECT g, root, CASE WHEN NOT cyc THEN coalesce(array_to_string(s, ','), '') END AS sources, known AND NOT cyc AS known, CASE WHEN cyc THEN 'cycle' WHEN known THEN 'known' ELSE 'unknown' END AS status FROM o"""


def mesh(spark, d):
    n = tree(spark, d).select("g", "node")
    edges = n.where("node > 1").select("g", F.expr("node div 2").alias("source"), F.col("node").alias("target")).unionByName(n.where("node > 2").select("g", F.expr("node div 3").alias("source"), F.col("node").alias("target"))).unionByName(n.where("node = 40 and g % 3 = 1").select("g", F.lit(40).cast("long").alias("source"), F.lit(10).cast("long").alias("target")))
    kind = F.when(F.col("node") % 16 == 5, "boundary").when((F.col("node") == 7) & (F.col("g") % 4 == 2), "unknown").when((F.col("node") == 1) & (F.col("g") % 2 == 1), "unbound").otherwise("other")
    return edges, n.withColumn("kind", kind), n.where("node in (9, 21, 50, 63)")


def origin_rows(spark, d, asked):
    out = graph.origins(*mesh(spark, d), ["g"], asked)
    return out.withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


@register("origins_general", f"WITH RECURSIVE {ORIGINS.format(doubt='kind IN (' + repr('unknown') + ', ' + repr('unbound') + ') AND leaf')}")
def origins_general(spark, d):
    return origin_rows(spark, d, False)


@register("origins_asked", f"WITH RECURSIVE {ORIGINS.format(doubt='leaf AND kind <> ' + repr('boundary'))}")
def origins_asked(spark, d):
    return origin_rows(spark, d, True)


@register("induced_edges", f"""WITH RECURSIVE {MESH}, r AS (SELECT g, node AS root, node FROM node WHERE node IN (9, 50) UNION SELECT r.g, r.root, e.source FROM r JOIN edge e ON e.g = r.g AND e.target = r.node AND e.target % 4 <> 3)
SELECT a.g, a.root, e.source, e.target FROM edge e JOIN r a ON a.g = e.g AND a.node = e.source JOIN r b ON b.g = e.g AND b.node = e.target AND b.root = a.root""")
def induced_edges(spark, d):
    edges, _, targets = mesh(spark, d)
    kinds = edges.withColumn("kind", F.when(F.col("target") % 4 == 3, "control").otherwise("data"))
    return graph.induced_edges(edges, graph.backward_slice(kinds, targets.where("node in (9, 50)"), ["g"], ["data"]), ["g"])


@register("effect_barriers_mesh", f"""WITH RECURSIVE {MESH}, ef AS (SELECT g, node AS effect, node % 24 AS object, node * 3 AS seq FROM node WHERE node % 5 = 3), rf AS (SELECT g, source AS owner, target AS object, (source * 7 + target) % 150 AS seq FROM edge),
r AS (SELECT g, effect, seq, object AS node FROM ef UNION SELECT r.g, r.effect, r.seq, rf.object FROM r JOIN rf ON rf.g = r.g AND rf.owner = r.node AND rf.seq < r.seq), b AS (SELECT g, node, max(seq) AS barrier FROM r GROUP BY 1, 2)
SELECT n.g, n.node AS owner, 0 AS version, n.node * 2 AS seq, coalesce(n.node * 2 > barrier, true) AS known FROM node n LEFT JOIN b USING (g, node)""")
def effect_barriers_mesh(spark, d):
    edges, nodes, _ = mesh(spark, d)
    effects = nodes.where("node % 5 = 3").select("g", F.col("node").alias("effect"), (F.col("node") % 24).alias("object"), (F.col("node") * 3).alias("seq"))
    refs = edges.distinct().select("g", F.col("source").alias("owner"), F.col("target").alias("object"), F.expr("(source * 7 + target) % 150").alias("seq"))
    return evidence.effect_barriers(effects, refs, nodes.select("g", F.col("node").alias("owner"), F.lit(0).alias("version"), (F.col("node") * 2).alias("seq")), ["g"])


# ---- two services ----

#: A response of 8 positions: 0 to 3 from m, 4 to 7 from s1; a read that gives 1 to 4 to x and 6 to y; x goes on to the sink.
STITCHED = """k AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS differs, o_orderkey % 5 = 0 AS twice FROM orders),
e AS (SELECT k, unnest([{'s': 'up:s0', 't': 'up:m'}, {'s': 'up:m', 't': 'up:w'}, {'s': 'up:s1', 't': 'up:w'}, {'s': 'down:x', 't': 'down:sink'}]) AS e FROM k
UNION ALL SELECT k, unnest(CASE WHEN differs OR twice THEN [{'s': 'down:r', 't': 'down:x'}, {'s': 'down:r', 't': 'down:y'}] ELSE [{'s': 'up:m', 't': 'down:x'}, {'s': 'up:s1', 't': 'down:x'}, {'s': 'up:s1', 't': 'down:y'}] END) FROM k)"""


def services(spark, d):
    k = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    part = lambda rows: k.select("k", F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(kind).alias("kind"), F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end")) for s, t, kind, a, b in rows])).alias("e")).select("k", "e.*")
    up = part([("s0", "m", "data", None, None), ("m", "w", "write", 0, 4), ("s1", "w", "write", 4, 8)])
    down = part([("r", "x", "data", 1, 5), ("r", "y", "data", 6, 7), ("x", "sink", "data", None, None)])
    body = F.lpad(F.col("k").cast("string"), 8, "0")
    reads = k.select("k", F.lit("r").alias("node"), F.when(F.col("k") % 7 == 0, F.reverse(F.concat(F.lit("x"), body))).otherwise(body).alias("body"))
    moved = evidence.transfers(k.select("k", F.lit("w").alias("node"), body.alias("body")), reads.unionByName(reads.where("k % 5 = 0")), ["k"], once=True)
    return evidence.stitched_graph(up, down, moved.distinct(), ["k"]), k


@register("stitched_graph", f"WITH {STITCHED} SELECT k, e.s AS source, e.t AS target FROM e")
def stitched_graph(spark, d):
    return services(spark, d)[0].select("k", "source", "target")


@register("stitched_slice", f"WITH RECURSIVE {STITCHED}, r AS (SELECT k, 'down:sink' AS root, 'down:sink' AS node FROM k UNION SELECT r.k, r.root, e.e.s FROM r JOIN e ON e.k = r.k AND e.e.t = r.node) SELECT k, root, node FROM r")
def stitched_slice(spark, d):
    edges, k = services(spark, d)
    return graph.backward_slice(edges, k.select("k", F.lit("down:sink").alias("node")), ["k"])


@register("exchange_services", f"""WITH {ELOG}, s AS (SELECT owner, field, version, count(*) AS n, min(op) AS b, min(event_id % 3) AS sv FROM elog WHERE kind = 'write' GROUP BY 1, 2, 3), r AS (SELECT owner, field, version, count(*) AS n, min(op) AS b, min(event_id % 3) AS sv FROM elog WHERE kind = 'read' GROUP BY 1, 2, 3)
SELECT owner, field, version, CASE WHEN s.n IS NULL THEN 'missing_send' WHEN r.n IS NULL THEN 'missing_receive' WHEN s.n > 1 OR r.n > 1 THEN 'ambiguous' WHEN s.sv = r.sv THEN 'same_service' WHEN s.b <> r.b THEN 'body_differs' ELSE 'matched' END AS status FROM s FULL JOIN r USING (owner, field, version)""")
def exchange_services(spark, d):
    half = lambda kind: ad.event_log(spark, d).where(F.col("kind") == kind).select("owner", "field", "version", F.col("op").alias("body"), F.array().cast("array<string>").alias("fields"), (F.col("event_id") % 3).alias("service"))
    return evidence.exchange_bridge(half("write"), half("read"), ["owner", "field", "version"], "body", "fields", service="service")


@register("reused_connections", f"""WITH {OBS} SELECT service, event_id // 6 AS connection, CASE WHEN (event_id % 4 < 2) = (event_id % 2 = 0) THEN 'client' ELSE 'server' END AS side, count(DISTINCT event_id // 3) AS messages FROM obs GROUP BY 1, 2, 3 HAVING count(DISTINCT event_id // 3) > 1""")
def reused_connections(spark, d):
    o = ad.observations(spark, d).select("service", F.expr("event_id div 6").alias("connection"), F.when(F.col("event_id") % 4 < 2, "request").otherwise("response").alias("direction"), F.when(F.col("event_id") % 2 == 0, "write").otherwise("read").alias("phase"), F.expr("event_id div 3").alias("message"))
    return evidence.reused_connections(o, ["connection"], "service", "direction", "phase", "message")


@register("http_times", """SELECT page_id, 0 AS position, CASE WHEN page_id % 11 = 0 THEN 'response_before_request' END AS issue, CASE WHEN page_id % 11 <> 0 THEN page_id * 100 END AS request_start_us, CASE WHEN page_id % 11 <> 0 THEN page_id * 100 + 70 END AS response_end_us, CASE WHEN page_id % 11 <> 0 THEN '2,3' END AS packets FROM pages""")
def http_times(spark, d):
    asked = F.encode(F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1\r\n\r\n")), "utf-8")
    told = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), "html"), "utf-8")
    early = F.when(F.col("page_id") % 11 == 0, -1).otherwise(1)
    piece = lambda a, b, t, n: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), t.cast("long").alias("time_us"), F.lit(n).cast("long").alias("packet"))
    p = ad.table(spark, d, "pages").select("page_id", asked.alias("request_stream"), told.alias("response_stream"))
    at, size = F.col("page_id") * 100, F.octet_length("response_stream")
    p = p.withColumns({"request_pieces": F.array(piece(F.lit(0), F.octet_length("request_stream"), at, 1)), "response_pieces": F.array(piece(F.lit(0), F.lit(9), at + 50 * early, 2), piece(F.lit(9), size, at + 70 * early, 3))})
    out = network.http_transactions(p, ["page_id"])
    return out.select("page_id", "position", "issue", "request_start_us", "response_end_us", F.array_join(F.col("response_packets").cast("array<string>"), ",").alias("packets"))


@register("observations_refused", """SELECT page_id AS trace, 'GET' AS method, '/a' AS path FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 3 <> 0""")
def observations_refused(spark, d):
    url = F.when(F.col("page_id") % 5 == 0, "https://host").when(F.col("page_id") % 3 == 0, "amqp://host/a").otherwise("https://host/a?b")
    p = ad.table(spark, d, "pages").select(F.col("page_id").alias("trace"), F.lit(1).cast("long").alias("span"), F.lit(None).cast("long").alias("parent"), F.lit("s").alias("service"), F.lit("CLIENT").alias("kind"), F.create_map(F.lit("http.method"), F.lit("get"), F.lit("http.url"), url).alias("tags"), F.lit(0).alias("start_us"), F.when(F.col("page_id") % 7 == 0, -5).otherwise(1).alias("duration_us"))
    return project.project_observations(p, ["s"]).select("trace", "method", "path")


# ---- planted call trees ----

#: Eight calls a tree by their number: the one before it in the tree, begin and end in seconds.
CALLS = [(None, 0, 1000), (0, 10, 990), (1, 20, 500), (2, 30, 490), (3, 40, 300), (4, 50, 290), (1, 510, 900), (6, 520, 890)]
#: Every fiftieth tree has the times and services of the one before it, so that all of their pairs are tied.
TWIN = 50


def planted(spark, d):
    """Calls of trees that follow from event ids alone: a tree begins eleven seconds after the one before, so some ninety overlap."""
    k, t = F.col("event_id") % 8, F.expr("event_id div 8")
    like = F.expr(f"if(tree % {TWIN} = {TWIN - 1} , tree - 1, tree)")
    pick = lambda at: F.element_at(F.array(*[F.lit(c[at]) for c in CALLS]), F.col("k").cast("int") + 1)
    rows = ad.table(spark, d, "events").select("event_id", k.alias("k"), t.alias("tree")).withColumn("like", like)
    first = F.col("like") % 50
    home = F.when(F.col("k") == 0, -1).when(F.col("k").isin(1, 2, 6), first).when(F.col("k").isin(3, 4), 100 + F.col("like") % 45).when(F.col("k") == 5, 200 + F.col("like") % 40).otherwise(300)
    called = F.when(F.col("k") == 0, first).when(F.col("k") == 2, 100 + F.col("like") % 45).when(F.col("k") == 4, 200 + F.col("like") % 40).when(F.col("k") == 6, 300)
    start = F.col("like") * 11
    return rows.select("event_id", "tree", "k", home.cast("int").alias("service"), called.cast("int").alias("peer"), F.when(F.col("k") % 2 == 0, "CLIENT").otherwise("SERVER").alias("kind"), F.lit("/call").alias("path"), ((start + pick(1)) * 1_000_000).alias("start_us"), ((start + pick(2)) * 1_000_000).alias("end_us"))


def timing_edges(obs, slack_us=60_000_000):
    """(parent, child): calls matched over the wire and calls inside a service, from times and names alone; each child has one parent at most."""
    transport = joins.match_calls(obs, slack_us).where("not tied").select(F.col("client").alias("parent"), F.col("server").alias("child"))
    return transport.unionByName(joins.local_parents(obs).select("parent", "child"))


def timing_score(calls):
    """Trees found by timing against the planted ones, by the entry call of each tree: tp, fp, fn, exact and the ratios."""
    calls = materialize(calls, "calls")
    edges = materialize(timing_edges(calls.drop("tree", "k")), "edges")
    tops = graph.climb(edges.select(F.lit(0).alias("g"), F.col("child").alias("node"), "parent"), ["g"]).where("top is not null")
    entries = calls.where("kind = 'CLIENT'").join(edges.select(F.col("child").alias("event_id")), "event_id", "left_anti").select(F.col("event_id").alias("query"))
    found = tops.join(entries, F.col("top") == F.col("query")).select("query", F.col("node").alias("item"))
    roots = calls.where("k = 0").select("tree", F.col("event_id").alias("query"))
    truth = calls.where("k > 0").join(roots, "tree").select("query", F.col("event_id").alias("item"))
    return score.prf(score.set_score(truth, found, ["query"], ["item"]))


@register("w1_timing_score", f"""WITH t AS (SELECT event_id // 8 AS tree, count(*) - 1 AS n FROM events GROUP BY 1), s AS (SELECT tree * 8 AS query, n, tree % {TWIN} = {TWIN - 1} OR tree % {TWIN} = {TWIN - 2} AND (tree + 1) IN (SELECT tree FROM t) AS tied FROM t WHERE n > 0)
SELECT query, CASE WHEN tied THEN 0 ELSE n END AS tp, 0::BIGINT AS fp, CASE WHEN tied THEN n ELSE 0 END AS fn, NOT tied AS exact, CASE WHEN NOT tied THEN 1.0::DOUBLE END AS "precision", CASE WHEN tied THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS recall, CASE WHEN tied THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS f1 FROM s""")
def w1_timing_score(spark, d):
    """Call trees from timing alone: wire and local edges, roots by pointer doubling, scored against the planted trees; twins of equal times abstain and count as missed."""
    return timing_score(planted(spark, d))


# ---- cost ----

ENUMERATED = """k AS (SELECT *, count(*) OVER (PARTITION BY m) AS n, row_number() OVER (PARTITION BY m ORDER BY x) AS i FROM r WHERE x IS NOT NULL),
c AS (SELECT DISTINCT m, n, 0 AS depth, []::DOUBLE[] AS xs FROM k UNION ALL SELECT c.m, c.n, depth + 1, list_append(xs, k.x) FROM c JOIN k USING (m) WHERE depth < c.n),
s AS (SELECT m, n, list_sort(xs) AS xs FROM c WHERE depth = n), b AS (SELECT m, n, (xs[(n + 1) // 2] + xs[n // 2 + 1]) / 2 AS md FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY md) AS rk, count(*) OVER (PARTITION BY m) AS many FROM b),
z AS (SELECT m, min(md) FILTER (rk >= ceil(many * 0.025)) AS low, min(md) FILTER (rk >= ceil(many * 0.975)) AS high FROM q GROUP BY m),
g AS (SELECT m, count(x) AS n, count(*) FILTER (x > 1) AS up, count(*) FILTER (x < 1) AS down FROM r GROUP BY m),
p AS (SELECT m, sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1))) / pow(2, max(up + down)) AS tail FROM g, range(0, 9) t(i) WHERE i <= least(up, down) GROUP BY m)
SELECT g.m AS metric, g.n, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN g.n > 0 THEN round(least(1.0, 2 * tail), 6) END AS sign_p, CASE WHEN g.n > 0 THEN round(1 - pow(2, 1 - g.n), 6) END AS coverage FROM g LEFT JOIN z USING (m) LEFT JOIN p USING (m)"""
UNCERTAIN = ("low", "high", "sign_p", "coverage")


@register("paired_uncertainty", f"WITH RECURSIVE {LINES}, r AS (SELECT l_linestatus AS m, round, (sum(metric) FILTER (mode = 'A'))::DOUBLE / (sum(metric) FILTER (mode = 'N'))::DOUBLE AS x FROM lines GROUP BY 1, 2), {ENUMERATED.replace('g.m AS metric', 'g.m AS l_linestatus')}")
def paired_uncertainty(spark, d):
    t = ad.lines(spark, d).groupBy("l_linestatus", "round").agg((F.sum(F.when(F.col("mode") == "A", F.col("metric"))) / F.sum(F.when(F.col("mode") == "N", F.col("metric")))).alias("ratio"))
    return cost.paired_uncertainty(t, "l_linestatus", "ratio").withColumns({c: F.round(c, 6) for c in UNCERTAIN})


@register("paired_uncertainty_counts", f"WITH RECURSIVE r AS (SELECT l_linenumber AS m, l_suppkey % (1 + l_linenumber % 6) AS block, (sum(l_quantity) FILTER (l_tax > 0.04))::DOUBLE / (sum(l_quantity) FILTER (l_tax < 0.04))::DOUBLE AS x FROM lineitem GROUP BY 1, 2), {ENUMERATED}")
def paired_uncertainty_counts(spark, d):
    """Two to six ratios a metric, and one."""
    t = ad.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("metric"), F.expr("l_suppkey % (1 + l_linenumber % 6)").alias("block"))
    t = t.agg((F.sum(F.when(F.col("l_tax") > 0.04, F.col("l_quantity"))) / F.sum(F.when(F.col("l_tax") < 0.04, F.col("l_quantity")))).alias("ratio"))
    return cost.paired_uncertainty(t, "metric", "ratio").withColumns({c: F.round(c, 6) for c in UNCERTAIN})


@register("nearest_rank_whole", f"""WITH {LINES}, r AS (SELECT metric, row_number() OVER (ORDER BY metric) AS rn, count(*) OVER () AS n FROM lines) SELECT min(metric) FILTER (rn >= (n * 50 + 99) // 100) AS p50, min(metric) FILTER (rn >= (n * 99 + 99) // 100) AS p99 FROM r""")
def nearest_rank_whole(spark, d):
    """One group of all rows."""
    return cost.nearest_rank(ad.lines(spark, d), [], "metric", [50, 99])


@register("complete_blocks", """WITH g AS (SELECT o_custkey, count(*) AS a, count(*) FILTER (o_totalprice > 20000) AS n, count(DISTINCT o_orderstatus) AS k FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1) SELECT o_orderkey, o.o_custkey FROM orders o JOIN g USING (o_custkey) WHERE k = 2 AND n = 2 AND a = 2""")
def complete_blocks(spark, d):
    o = ad.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") > 20000).alias("good"))
    return cost.complete_blocks(o, ["o_custkey"], "o_orderstatus", ["F", "O"], "good").select("o_orderkey", "o_custkey")


@register("volume_difference", """WITH f AS (SELECT lang, count(*) AS e, sum(strlen(coalesce(text, '')))::BIGINT AS b FROM documents GROUP BY 1), l AS (SELECT lang, count(*) AS e, sum(strlen(coalesce(text, '')))::BIGINT AS b FROM documents WHERE doc_id % 3 <> 0 AND lang <> 'en' GROUP BY 1)
SELECT lang, f.e AS full_events, coalesce(l.e, 0) AS less_events, f.b AS full_bytes, coalesce(l.b, 0) AS less_bytes, f.b - coalesce(l.b, 0) AS saved_bytes, round(f.b / 10.0::DOUBLE, 6) AS full_bytes_per_request, round(l.b / 10.0::DOUBLE, 6) AS less_bytes_per_request FROM f LEFT JOIN l USING (lang)""")
def volume_difference(spark, d):
    t = ad.table(spark, d, "documents")
    side = lambda df: df.groupBy("lang").agg(F.count("*").alias("events"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")).withColumn("requests", F.lit(10))
    out = cost.volume_difference(side(t), side(t.where("doc_id % 3 != 0 and lang != 'en'")), ["lang"], "requests")
    return out.withColumns({f"{p}_bytes_per_request": F.round(f"{p}_bytes_per_request", 6) for p in ("full", "less")})


@register("tier_growth", f"""WITH {LINES}, t AS (SELECT round, mode, l_linestatus AS tier, sum(metric)::BIGINT AS m FROM lines GROUP BY ALL), x AS (SELECT t.round, t.mode, t.tier, t.m - b.m AS delta FROM t JOIN t b ON b.round = t.round AND b.tier = t.tier AND b.mode = 'N' WHERE t.mode <> 'N')
SELECT round, mode, (max(delta) FILTER (tier = 'F')) - (max(delta) FILTER (tier = 'O')) AS growth FROM x GROUP BY 1, 2""")
def tier_growth(spark, d):
    t = ad.lines(spark, d).groupBy("round", "mode", F.col("l_linestatus").alias("tier")).agg(F.sum("metric").alias("metric"))
    return cost.tier_growth(cost.baseline_delta(t, ["round", "tier"], "mode", "metric", "N"), ["round"], "mode", "tier", "O", "F")


# ---- parts that no other query runs ----


@register("chain_leftovers", f"""WITH {SPANS}, m AS (SELECT a.trace, a.span FROM spans a JOIN spans b ON b.trace = a.trace AND b.span = a.span + 3 WHERE a.span % 4 = 0) SELECT trace, span FROM spans s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.trace = s.trace AND m.span = s.span - s.span % 4)""")
def chain_leftovers(spark, d):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("INTERNAL", "SERVER", "CLIENT", "SERVER")]), (F.col("span") % 4 + 1).cast("int"))
    t = ad.turn_spans(spark, d).withColumn("kind", kinds)
    return evidence.chain_leftovers(t, evidence.span_chains(t))


@register("span_chains_checked", f"""WITH {SPANS} SELECT a.trace, a.span, CASE WHEN b.span IS NULL THEN 'missing_server' WHEN b.trace % 3 = 1 THEN 'wrong_server' WHEN c.span IS NULL THEN 'missing_client' WHEN u.span IS NULL THEN 'missing_upstream' ELSE 'matched' END AS status
FROM spans a LEFT JOIN spans b ON b.trace = a.trace AND b.span = a.span + 1 LEFT JOIN spans c ON c.trace = a.trace AND c.span = a.span + 2 LEFT JOIN spans u ON u.trace = a.trace AND u.span = a.span + 3 WHERE a.span % 4 = 0""")
def span_chains_checked(spark, d):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("INTERNAL", "SERVER", "CLIENT", "SERVER")]), (F.col("span") % 4 + 1).cast("int"))
    out = evidence.span_chains(ad.turn_spans(spark, d).withColumn("kind", kinds), {"server": F.col("trace") % 3 != 1})
    return out.select("trace", "span", "status")


@register("attribution_balance", f"""WITH {SPANS}, o AS (SELECT trace, span, duration_us AS b, CASE WHEN span >= 2 AND trace % 2 = 1 THEN 'steady' WHEN span < 2 AND trace % 2 = 0 THEN 'warm-up' ELSE 'unattributed_or_shared' END AS phase FROM spans)
SELECT trace, phase, count(*) AS records, sum(b)::BIGINT AS bytes, (sum(sum(b)) OVER (PARTITION BY trace))::BIGINT AS batch_bytes FROM o GROUP BY 1, 2""")
def attribution_balance(spark, d):
    t = ad.turn_spans(spark, d).select("trace", F.col("span").alias("node"), "parent", F.col("duration_us").alias("bytes"))
    owners = t.where("node = 0 and trace % 2 = 0 or node = 2").select("trace", "node", F.when(F.col("node") == 0, "a").otherwise("b").alias("owner"))
    phases = spark.createDataFrame([("a", "warm-up"), ("b", "steady")], "owner string, phase string")
    return evidence.attribution_balance(evidence.strict_attribution(t, owners, ["trace"]), phases, ["trace"])


@register("cut_lines", """WITH l AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'plain' ELSE url END AS line FROM pages), p AS (SELECT page_id, string_split(line, '/') AS parts, contains(line, '/') AS has FROM l), c AS (SELECT page_id, has, unnest(range(0, len(parts))) AS field, unnest(parts) AS value FROM p)
SELECT page_id, NOT has AS whole, string_agg(field || '=' || value, ';' ORDER BY field) AS cells FROM c WHERE NOT has OR field IN (2, 4) GROUP BY 1, 2""")
def cut_lines(spark, d):
    p = ad.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 6 == 0, "plain").otherwise(F.col("url")).alias("line"))
    out = joins.cut_lines(p, 0, "page_id", "line", "/", [2, 4])
    return out.select("page_id", "whole", F.array_join(F.transform("cells", lambda c: F.concat_ws("=", c["field"].cast("string"), c["value"])), ";").alias("cells"))


@register("cut_lines_complement", """WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages WHERE contains(url, '/')), c AS (SELECT page_id, unnest(range(0, len(parts))) AS field FROM p) SELECT page_id, string_agg(field::VARCHAR, ';' ORDER BY field) AS fields FROM c WHERE field NOT IN (2, 4) GROUP BY 1""")
def cut_lines_complement(spark, d):
    p = ad.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 6 == 0, F.regexp_replace("url", "^$", "x")).otherwise(F.col("url")).alias("line"))
    out = joins.cut_lines(p, 0, "page_id", "line", "/", [2, 4], complement=True, only_delimited=True)
    return out.select("page_id", F.array_join(F.transform("cells", lambda c: c["field"].cast("string")), ";").alias("fields"))


@register("binding_table", "SELECT DISTINCT sha256('salt|' || user_id || '|' || event_type) AS opaque_id, user_id, event_type FROM events")
def binding_table(spark, d):
    return project.binding_table(ad.table(spark, d, "events"), ["user_id", "event_type"], "salt")


@register("unmapped_kinds", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def unmapped_kinds(spark, d):
    return project.unmapped_kinds(ad.table(spark, d, "events"), {"view": "reading", "click": "reading"}, "event_type")


@register("phase_violations", f"""WITH {OBS}, c AS (SELECT service, event_id, start_us, end_us, CASE WHEN event_id % 100 = 99 AND service = 2 THEN 'other' WHEN start_us < 86400000000::BIGINT * (service - 1) + (SELECT min(start_us) FROM obs) THEN 'warm-up-1' ELSE 'steady-1' END AS name FROM obs),
g AS (SELECT service, count(*) FILTER (name = 'other') AS neither, max(end_us) FILTER (name = 'warm-up-1') AS w, min(start_us) FILTER (name = 'steady-1') AS s FROM c GROUP BY 1) SELECT service, unnest(list_filter([CASE WHEN neither > 0 THEN 'no_phase' END, CASE WHEN w > s THEN 'phases_overlap' END], lambda x: x IS NOT NULL)) AS rule FROM g""")
def phase_violations(spark, d):
    o = ad.observations(spark, d)
    first = o.agg(F.min("start_us").alias("first"))
    name = F.when((F.col("event_id") % 100 == 99) & (F.col("service") == 2), "other").when(F.col("start_us") < (F.col("service") - 1) * 86_400_000_000 + F.col("first"), "warm-up-1").otherwise("steady-1")
    return project.phase_violations(o.join(F.broadcast(first)).withColumn("case", name), ["service"], "case", "start_us", "end_us")


@register("cohort_violation", """SELECT event_id AS record, CASE WHEN user_id // 6 % 2 = 0 AND user_id // 2 % 3 = 0 THEN user_id // 2 * 2 END AS request, CASE WHEN user_id // 6 % 2 = 1 AND user_id // 2 % 3 < 2 THEN 'violation' WHEN user_id // 2 % 3 = 0 THEN 'request' ELSE 'global' END AS status FROM events""")
def cohort_violation(spark, d):
    """Pairs of users are components; in some the first two pairs are linked and hold a request each."""
    e = ad.table(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("u"))
    users = e.select("u").distinct()
    pair = F.expr("u div 2 * 2")
    joined = users.where("u div 6 % 2 = 1 and u % 6 = 0").select(F.col("u").alias("a"), (F.col("u") + 2).alias("b"))
    links = users.select(F.col("u").alias("a"), pair.alias("b")).unionByName(joined)
    held = users.where("u div 2 % 3 = 0 or u div 6 % 2 = 1 and u div 2 % 3 = 1").select(pair.alias("request"), pair.alias("id")).distinct()
    return graph.cohort_attribution(links, e.select(F.col("event_id").alias("record"), F.col("u").alias("id")), held)


# ---- options ----


@register("monotonic_strict", "WITH x AS (SELECT user_id, round(value) AS v, lag(round(value)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, 'monotonic' AS rule, count(*)::VARCHAR AS detail FROM x WHERE v <= b GROUP BY 1")
def monotonic_strict(spark, d):
    return gates.monotonic_gate(ad.table(spark, d, "events").withColumn("value", F.round("value")), ["user_id"], ["event_id"], "value", strict=True)


@register("version_weak", f"WITH {ELOG}, w AS (SELECT owner, field, event_id % 50 AS v, lag(event_id % 50) OVER (PARTITION BY owner, field ORDER BY seq) AS b FROM elog WHERE kind = 'write') SELECT owner, field, 'version' AS rule, count(*)::VARCHAR AS detail FROM w WHERE v <= b GROUP BY 1, 2")
def version_weak(spark, d):
    return gates.version_gate(ad.event_log(spark, d).withColumn("version", F.col("event_id") % 50), ["owner", "field"], "seq", F.col("kind") == "write", "version", weak=True)


@register("pairing_equal", f"""WITH {ELOG}, x AS (SELECT ctx, version, count(*) FILTER (kind = 'write') AS b, count(*) FILTER (kind = 'read') AS e, max(seq) FILTER (kind = 'write') AS tb, min(seq) FILTER (kind = 'read') AS te, count(DISTINCT field) AS f FROM elog WHERE kind <> 'barrier' GROUP BY 1, 2)
SELECT ctx, version, 'pairing' AS rule, b || '/' || e AS detail FROM x WHERE b <> 1 OR e <> 1 OR te <= tb OR f <> 1""")
def pairing_equal(spark, d):
    return gates.pairing_gate(ad.event_log(spark, d), ["ctx", "version"], "kind", "seq", ["write"], ["read"], ["field"])


@register("transport_methods", f"""WITH {OBS}, m AS (SELECT *, event_id // 2 % 3 AS method FROM obs) SELECT c.event_id AS client, s.event_id AS server, s.service, s.path, s.method, abs(s.start_us - c.start_us) + abs(s.end_us - c.end_us) AS cost FROM m c JOIN m s ON c.kind = 'CLIENT' AND s.kind = 'SERVER' AND c.peer = s.service AND c.path = s.path AND c.method = s.method AND s.start_us >= c.start_us - 60000000 AND s.end_us <= c.end_us + 60000000""")
def transport_methods(spark, d):
    return joins.transport_candidates(ad.observations(spark, d).withColumn("method", F.expr("event_id div 2 % 3")), 60_000_000)


@register("runtime_errors_otel", f"WITH {SPANS} SELECT trace, span, concat_ws(',', CASE WHEN error IS NOT NULL THEN 'error_tag' END, CASE WHEN span % 3 = 0 THEN 'otel_error' END, CASE WHEN status >= 400 THEN 'http_' || status END) AS reasons FROM spans WHERE error IS NOT NULL OR status >= 400 OR span % 3 = 0")
def runtime_errors_otel(spark, d):
    t = ad.turn_spans(spark, d).withColumn("otel_status", F.when(F.col("span") % 3 == 0, "ERROR"))
    return spans.runtime_errors(t).withColumn("reasons", F.array_join("reasons", ","))


@register("sync_scope_http", f"""WITH {SPANS}, q AS (SELECT trace, min(span) FILTER (duration_us % 11 = 0) AS first FROM spans GROUP BY 1), h AS (SELECT s.trace, max(s.span) AS last FROM spans s JOIN q USING (trace) WHERE s.status = 200 AND (first IS NULL OR s.span < first) GROUP BY 1)
SELECT s.trace, s.span FROM spans s JOIN h USING (trace) WHERE s.span <= last""")
def sync_scope_http(spark, d):
    t = ad.turn_spans(spark, d).withColumn("kind", F.when(F.col("duration_us") % 11 == 0, "PRODUCER").otherwise("SERVER"))
    return evidence.select_sync_scope(t, http=F.col("status") == 200)


@register("empty_is_unknown", """WITH g AS (SELECT l_orderkey AS q, count(DISTINCT l_suppkey) AS e, coalesce(count(DISTINCT l_suppkey) FILTER (l_linenumber = 3), 0) AS p FROM lineitem GROUP BY 1) SELECT q, p > 0 AS known, p AS tp, 0::BIGINT AS fp, e - p AS fn, p > 0 AND e = p AS exact FROM g""")
def empty_is_unknown(spark, d):
    g = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set("l_suppkey").alias("expected"), F.collect_set(F.when(F.col("l_linenumber") == 3, F.col("l_suppkey"))).alias("predicted"))
    return score.unknown_policy(g, empty_is_unknown=True).drop("expected", "predicted")


@register("span_chains_closed", f"""WITH {SPANS}, b AS (SELECT trace, max(span) AS last FROM spans GROUP BY 1) SELECT trace, span, CASE WHEN trace % 5 = 1 AND last >= 1 THEN 'reused_span' WHEN last < span + 1 THEN 'missing_server' WHEN last < span + 2 THEN 'missing_client' WHEN last < span + 3 THEN 'missing_upstream' WHEN last > span + 3 THEN 'open_upstream' ELSE 'matched' END AS status FROM spans JOIN b USING (trace) WHERE span % 4 = 0""")
def span_chains_closed(spark, d):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("INTERNAL", "SERVER", "CLIENT", "SERVER")]), (F.col("span") % 4 + 1).cast("int"))
    t = ad.turn_spans(spark, d).withColumn("kind", kinds)
    return evidence.span_chains(t.unionByName(t.where("trace % 5 = 1 and span = 1")), closed=True).select("trace", "span", "status")


@register("property_echo", """WITH w AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_suppkey % 3) AS fs, min(l_quantity) AS sent FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS service, l_quantity AS v, l_partkey % 2 = 0 AS resp, CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 10 = 2 THEN l_orderkey + 1 ELSE l_orderkey END AS echo, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS readers FROM lineitem WHERE l_tax > 0.02)
SELECT r.l_orderkey, r.l_linenumber, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 OR readers > 1 THEN 'ambiguous' WHEN fs = service THEN 'same_service' WHEN resp AND echo IS DISTINCT FROM l_orderkey THEN 'echo_differs' WHEN sent <> v THEN 'value_differs' ELSE 'matched' END AS status FROM r LEFT JOIN w USING (l_orderkey, l_linenumber)""")
def property_echo(spark, d):
    x = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("service"), F.col("l_quantity").alias("value"), "l_linestatus", "l_tax", F.when(F.col("l_partkey") % 2 == 0, "response").otherwise("request").alias("direction"), F.when(F.col("l_partkey") % 6 == 0, None).when(F.col("l_partkey") % 10 == 2, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey")).alias("echo"))
    out = joins.property_bridge(x.where("l_linestatus = 'F'"), x.where("l_tax > 0.02"), ["l_orderkey", "l_linenumber"], "service", "value", "direction", "echo", "l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "status")


@register("repeated_transports", "SELECT l_orderkey, l_returnflag, count(DISTINCT l_linenumber) AS events FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber) > 1")
def repeated_transports(spark, d):
    return joins.repeated_transports(ad.table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linenumber")


@register("json_pointers_nested", """WITH x AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer) SELECT k, '/a~1b/t~0/0' AS path, n AS value FROM x UNION ALL SELECT k, '/a~1b/t~0/1/z', m FROM x UNION ALL SELECT k, '/a~1b/t~0/1/n', k::VARCHAR FROM x UNION ALL SELECT k, '/b', 'true' FROM x""")
def json_pointers_nested(spark, d):
    nested = F.concat(F.lit('{"a/b": {"t~": ["'), "c_name", F.lit('", {"z": "'), "c_mktsegment", F.lit('", "n": '), F.col("c_custkey").cast("string"), F.lit("}]}, \"b\": true}"))
    return project.json_leaves(ad.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), nested.alias("j")), "j", ["k"], "pointer")


@register("capture_plan", f"""WITH {SPANS} SELECT trace, 'capture_closed' AS rule, first || '/footer/1/0' AS detail FROM (SELECT trace, CASE WHEN trace % 9 = 4 THEN 'row' ELSE 'header' END AS first, max(span) AS last FROM spans GROUP BY trace) WHERE last > 0 AND (trace % 9 = 4 OR trace % 10 = 3)
UNION ALL SELECT trace, 'capture_closed', CASE WHEN trace % 9 = 4 THEN 'row/row/0/0' ELSE 'header/header/0/0' END FROM spans GROUP BY trace HAVING max(span) = 0 UNION ALL SELECT trace, 'plan', CASE WHEN trace % 9 = 4 THEN 'none' ELSE 'p' || trace % 7 END FROM spans GROUP BY trace HAVING trace % 9 = 4 OR trace % 7 <> 2""")
def capture_plan(spark, d):
    t = ad.turn_spans(spark, d)
    last = t.groupBy("trace").agg(F.max("span").alias("last"))
    kind = F.when((F.col("span") == 0) & (F.col("trace") % 9 != 4), "header").when((F.col("span") == F.col("last")) & (F.col("span") > 0), "footer").otherwise("row")
    rows = t.join(last, "trace").select("trace", "span", kind.alias("kind"), (F.col("last") + (F.col("trace") % 10 == 3).cast("int")).alias("counted"), F.concat(F.lit("p"), (F.col("trace") % 7).cast("string")).alias("plan"))
    return gates.capture_closed_gate(rows, ["trace"], "span", "kind", "counted", "plan", "p2")


@register("phase_barriers_ordered", f"WITH {OBS}, x AS (SELECT event_id // 4 AS batch, start_us, end_us, CASE WHEN event_id % 40 <> 7 THEN event_id END AS a, event_id // 4 * 4 + 4 - (event_id // 4 % 3 = 1)::INT AS b FROM obs) SELECT batch, max(start_us) AS last_entry, min(end_us) AS first_exit, max(start_us) < min(end_us) AS together, coalesce(max(a) < min(b), false) AND count(a) = count(*) AS ordered FROM x GROUP BY 1")
def phase_barriers_ordered(spark, d):
    o = ad.observations(spark, d).select(F.expr("event_id div 4").alias("batch"), "start_us", "end_us", F.when(F.col("event_id") % 40 != 7, F.col("event_id")).alias("read_end"), F.expr("event_id div 4 * 4 + 4 - int(event_id div 4 % 3 = 1)").alias("read_begin"))
    return cost.phase_barriers(o, ["batch"], "start_us", "end_us", [("read_end", "read_begin")])


@register("families_applicable", "SELECT o_orderpriority AS fam, count(*) FILTER (o_custkey % 4 <> 1) AS targets, count(*) FILTER (o_custkey % 4 = 1) AS not_applicable, count(*) FILTER (o_custkey % 4 <> 1 AND o_orderstatus = 'F') AS correct, count(*) FILTER (o_custkey % 4 <> 1 AND o_orderstatus = 'O') AS wrong FROM orders GROUP BY 1")
def families_applicable(spark, d):
    o = ad.table(spark, d, "orders").select(F.col("o_orderpriority").alias("fam"), "o_custkey", F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "wrong").alias("state"))
    return score.family_counts(o, "fam", "state", ["correct", "wrong"], F.col("o_custkey") % 4 != 1)


@register("micro_unknown", """WITH q AS (SELECT o_orderpriority AS m, o_custkey % 3 AS tp, o_custkey % 2 AS fp, o_orderkey % 2 AS fn, o_orderstatus <> 'P' AS known FROM orders) SELECT m AS method, count(*) AS queries, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) FILTER (fp = 0 AND fn = 0) AS exact, count(*) FILTER (NOT known) AS unknown,
round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS "precision", round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS recall, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6) AS f1 FROM q GROUP BY 1""")
def micro_unknown(spark, d):
    q = ad.table(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 3).alias("tp"), (F.col("o_custkey") % 2).alias("fp"), (F.col("o_orderkey") % 2).alias("fn"), (F.col("o_orderstatus") != "P").alias("known"))
    return score.micro_summary(q.withColumn("exact", F.expr("fp = 0 and fn = 0")), ["method"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@register("resources_in_window", """WITH s AS (SELECT user_id, event_id AS t, event_id * 3 + user_id - CASE WHEN event_id % 400 = 200 THEN 2000 ELSE 0 END AS cpu, event_id % 77 AS rss FROM events WHERE event_id BETWEEN user_id * 2 AND 700), f AS (SELECT *, cpu < lag(cpu) OVER (PARTITION BY user_id ORDER BY t) AS fell FROM s)
SELECT user_id, CASE WHEN count(*) >= 2 AND count(*) FILTER (fell) = 0 THEN round((max(cpu) - min(cpu)) * 100 / (max(t) - min(t)), 6) END AS cpu_percent, round(avg(rss), 6) AS rss_mean, max(rss) AS rss_peak, count(*) < 2 OR count(*) FILTER (fell) > 0 AS violation FROM f GROUP BY 1""")
def resources_in_window(spark, d):
    s = ad.table(spark, d, "events").select("user_id", F.col("event_id").alias("t"), (F.col("event_id") * 3 + F.col("user_id") - F.when(F.col("event_id") % 400 == 200, 2000).otherwise(0)).alias("cpu"), (F.col("event_id") % 77).alias("rss"))
    out = cost.resource_summary(s, ["user_id"], "t", "cpu", "rss", (F.col("user_id") * 2, F.lit(700)))
    return out.withColumns({"cpu_percent": F.round("cpu_percent", 6), "rss_mean": F.round("rss_mean", 6)})


@register("foreign_ids_anywhere", "SELECT DISTINCT p.page_id, o.page_id AS owner, o.page_id::VARCHAR AS id FROM pages p JOIN pages o ON contains(p.url, o.page_id::VARCHAR) WHERE o.page_id <> p.page_id")
def foreign_ids_anywhere(spark, d):
    p = ad.table(spark, d, "pages")
    return evidence.foreign_id_hits(p.select("page_id", F.col("url").alias("path")), p.select("page_id", F.col("page_id").cast("string").alias("id")), "page_id", "path", "id", substring=True)
