"""Registered queries of cross-service evidence and of packets, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import project
from ..operators import evidence, network
from . import adapters as ad
from .adapters import ELOG, OBS, SPANS
from .registry import register

KEY = ["owner", "field", "version"]


def side(spark, d, kind):
    return ad.event_log(spark, d).where(F.col("kind") == kind)


def turns(spark, d):
    return ad.turn_spans(spark, d).withColumn("node", F.col("span"))


BOTH = f"""{ELOG}, s AS (SELECT owner, field, version, count(*) AS n, min(event_id % 2) AS body, min(op) AS f FROM elog WHERE kind = 'write' GROUP BY 1, 2, 3),
r AS (SELECT owner, field, version, count(*) AS n, min(event_id % 2) AS body, min(op) AS f FROM elog WHERE kind = 'read' GROUP BY 1, 2, 3),
j AS (SELECT owner, field, version, s.n AS sn, r.n AS rn, s.body AS sb, r.body AS rb, s.f AS sf, r.f AS rf FROM s FULL JOIN r USING (owner, field, version))"""


@register("exchange_bridge", f"WITH {BOTH} SELECT owner, field, version, CASE WHEN sn IS NULL THEN 'missing_send' WHEN rn IS NULL THEN 'missing_receive' WHEN sn > 1 OR rn > 1 THEN 'ambiguous' WHEN sb <> rb THEN 'body_differs' WHEN sf <> rf THEN 'fields_differ' ELSE 'matched' END AS status FROM j")
def exchange_bridge(spark, d):
    half = lambda kind: side(spark, d, kind).select(*KEY, (F.col("event_id") % 2).alias("body"), F.array("op").alias("fields"))
    return evidence.exchange_bridge(half("write"), half("read"), KEY, "body", "fields")


@register("wire_call_reconcile", f"WITH {BOTH} SELECT owner, field, version, CASE WHEN sn IS NULL THEN 'call_only' WHEN rn IS NULL THEN 'wire_only' WHEN sn > 1 OR rn > 1 THEN 'ambiguous' WHEN sb <> rb THEN 'status' WHEN sf <> rf THEN 'endpoint' ELSE 'matched' END AS reason FROM j")
def wire_call_reconcile(spark, d):
    half = lambda kind: side(spark, d, kind).select(*KEY, (F.col("event_id") % 2).alias("status"), F.col("op").alias("endpoint"))
    return evidence.wire_call_reconcile(half("write"), half("read"), KEY, ["status", "endpoint"])


@register("stitch_services", f"""WITH {ELOG} SELECT r.owner, r.field, r.version, 'up:' || w.event_id AS source, 'down:' || r.event_id AS target, unnest(range(length(r.op)))::INT AS position
FROM elog r JOIN elog w ON w.owner = r.owner AND w.field = r.field AND w.version = r.version AND w.kind = 'write' AND r.kind = 'read' AND w.op = r.op""")
def stitch_services(spark, d):
    half = lambda kind: side(spark, d, kind).select(*KEY, F.col("event_id").alias("node"), F.col("op").alias("body"))
    edges = evidence.stitch_services(half("write"), half("read"), KEY)
    return edges.select(*KEY, "source", "target", F.explode(F.sequence("start", F.col("end") - 1)).alias("position"))


@register("candidate_value_edges", f"""WITH {ELOG} SELECT w.owner, w.field, w.version, w.event_id AS source, r.event_id AS target, 'candidate' AS kind
FROM elog w JOIN elog r ON w.owner = r.owner AND w.field = r.field AND w.version = r.version AND w.kind = 'write' AND r.kind = 'read' AND w.op = r.op AND w.seq < r.seq""")
def candidate_value_edges(spark, d):
    half = lambda kind: side(spark, d, kind).select(*KEY, F.col("event_id").alias("node"), F.col("op").alias("value"), F.col("seq").alias("at"))
    return evidence.candidate_value_edges(half("write"), half("read"), KEY)


@register("context_match", """WITH e AS (SELECT event_id // 2 AS message, event_id AS span, CASE WHEN event_id % 2 = 0 OR user_id % 7 = 0 THEN 'client' ELSE 'server' END AS role, CASE WHEN user_id % 5 = 0 THEN event_id ELSE event_id - 1 END AS parent FROM events),
m AS (SELECT message, count(*) FILTER (role = 'client') AS c, count(*) FILTER (role = 'server') AS s, min(span) FILTER (role = 'client') AS cs, min(span) FILTER (role = 'server') AS ss, min(parent) FILTER (role = 'server') AS sp FROM e GROUP BY 1)
SELECT message, CASE WHEN c = 0 OR s = 0 THEN 'missing' WHEN c > 1 OR s > 1 THEN 'ambiguous' WHEN cs = ss THEN 'same_span' WHEN sp <> cs THEN 'parent_differs' ELSE 'matched' END AS status FROM m""")
def context_match(spark, d):
    e = ad.table(spark, d, "events").select(F.expr("event_id div 2").alias("message"), F.col("event_id").alias("span"), F.expr("if(event_id % 2 = 0 or user_id % 7 = 0, 'client', 'server')").alias("role"), F.expr("if(user_id % 5 = 0, event_id, event_id - 1)").alias("parent"))
    return evidence.context_match(e, ["message"], "role", "span", "parent")


@register("span_chains", f"""WITH {SPANS} SELECT a.trace, a.span, CASE WHEN d.span IS NOT NULL THEN b.span END AS server, CASE WHEN d.span IS NOT NULL THEN c.span END AS client, d.span AS upstream,
CASE WHEN b.span IS NULL THEN 'missing_server' WHEN c.span IS NULL THEN 'missing_client' WHEN d.span IS NULL THEN 'missing_upstream' ELSE 'matched' END AS status
FROM spans a LEFT JOIN spans b ON b.trace = a.trace AND b.parent = a.span LEFT JOIN spans c ON c.trace = a.trace AND c.parent = b.span LEFT JOIN spans d ON d.trace = a.trace AND d.parent = c.span WHERE a.span % 4 = 0""")
def span_chains(spark, d):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("INTERNAL", "SERVER", "CLIENT", "SERVER")]), (F.col("span") % 4 + 1).cast("int"))
    return evidence.span_chains(ad.turn_spans(spark, d).withColumn("kind", kinds))


@register("select_sync_scope", f"WITH {SPANS} SELECT trace, span FROM spans c WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace = c.trace AND p.span <= c.span AND p.duration_us % 11 = 0)")
def select_sync_scope(spark, d):
    return evidence.select_sync_scope(ad.turn_spans(spark, d).withColumn("kind", F.when(F.col("duration_us") % 11 == 0, "PRODUCER").otherwise("SERVER")))


@register("foreign_id_hits", """WITH t AS (SELECT DISTINCT page_id, unnest(regexp_split_to_array(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '[^A-Za-z0-9]+')) AS id FROM pages)
SELECT t.page_id, o.page_id AS owner, id FROM t JOIN pages o ON o.page_id::VARCHAR = id WHERE o.page_id <> t.page_id""")
def foreign_id_hits(spark, d):
    p = ad.table(spark, d, "pages")
    return evidence.foreign_id_hits(p.select("page_id", project.url_path(F.col("url")).alias("path")), p.select("page_id", F.col("page_id").cast("string").alias("id")), "page_id", "path", "id")


@register("select_entry_queries", f"""WITH {OBS}, a AS (SELECT DISTINCT service, path FROM obs WHERE kind = 'SERVER' AND end_us - start_us > 60000000), m AS (SELECT DISTINCT peer AS service, path FROM obs WHERE kind = 'CLIENT' AND service <> peer)
SELECT service, path, CASE WHEN m.path IS NULL THEN 'not_in_manifest' WHEN a.path IS NULL THEN 'not_observed' ELSE 'query' END AS status FROM a FULL JOIN m USING (service, path)""")
def select_entry_queries(spark, d):
    obs = ad.observations(spark, d)
    manifest = obs.where("kind = 'CLIENT' and service != peer").select(F.col("peer").alias("service"), "path")
    return evidence.select_entry_queries(obs, manifest, ["service", "path"], F.expr("kind = 'SERVER' and end_us - start_us > 60000000"))


@register("buffer_origin", f"""WITH {ELOG}, u AS (SELECT ctx, seq, event_id AS use, field * 4 + 1 + k AS byte, k FROM elog, range(3) r(k) WHERE kind = 'read' AND k < 1 + event_id % 3),
b AS (SELECT u.ctx, u.use, u.k, arg_max(w.event_id, w.seq) AS op, arg_max(w.event_id * 10 + u.byte - w.field * 4, w.seq) AS place FROM u LEFT JOIN elog w ON w.ctx = u.ctx AND w.kind = 'write' AND w.seq < u.seq AND u.byte BETWEEN w.field * 4 AND w.field * 4 + w.event_id % 8 GROUP BY 1, 2, 3),
g AS (SELECT ctx, use, count(*) FILTER (op IS NULL) = 0 AND count(DISTINCT op) = 1 AND count(DISTINCT place - k) = 1 AS one, min(op) AS op, min(place - k) AS origin FROM b GROUP BY 1, 2)
SELECT ctx, use, CASE WHEN one THEN op END AS op, CASE WHEN one THEN origin END AS origin FROM g""")
def buffer_origin(spark, d):
    e = ad.event_log(spark, d)
    reads = e.where("kind = 'write'").select("ctx", "seq", F.col("event_id").alias("op"), (F.col("field") * 4).alias("address"), (F.col("event_id") % 8 + 1).alias("length"), (F.col("event_id") * 10).alias("offset"))
    uses = e.where("kind = 'read'").select("ctx", "seq", F.col("event_id").alias("use"), (F.col("field") * 4 + 1).alias("address"), (F.col("event_id") % 3 + 1).alias("length"))
    return evidence.buffer_origin(reads, uses, ["ctx"])


@register("reference_identity", f"""WITH {ELOG}, p AS (SELECT ctx, field AS slot, arg_max(event_id % 15, seq) AS published FROM elog WHERE kind = 'write' GROUP BY 1, 2), o AS (SELECT *, published + (ctx % 4 = 0)::INT AS object FROM p),
i AS (SELECT ctx, event_id % 15 AS object, count(*) AS n, min(seq) AS position FROM elog WHERE kind = 'barrier' GROUP BY 1, 2), s AS (SELECT ctx, slot, position, CASE WHEN published <> object OR n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'exact' END AS status FROM o LEFT JOIN i USING (ctx, object))
SELECT ctx, slot, status, CASE WHEN status = 'exact' THEN position END AS position FROM s""")
def reference_identity(spark, d):
    named = ad.event_log(spark, d).withColumn("object", F.col("event_id") % 15)
    writes = named.where("kind = 'write'").select("ctx", F.col("field").alias("slot"), "object", "seq")
    outputs = writes.groupBy("ctx", "slot").agg((F.max_by("object", "seq")).alias("object")).withColumn("object", F.col("object") + (F.col("ctx") % 4 == 0).cast("int"))
    return evidence.reference_identity(named.where("kind = 'barrier'").select("ctx", F.col("seq").alias("position"), "object"), writes, outputs, ["ctx"])


@register("source_family", f"WITH {SPANS} SELECT trace, span - span % 3 AS root, span * 10 AS source FROM spans")
def source_family(spark, d):
    frames = turns(spark, d).select("trace", "node", F.when(F.col("node") % 3 != 0, F.col("parent")).alias("parent"))
    return evidence.source_family(frames, frames.select("trace", "node", (F.col("node") * 10).alias("source")), ["trace"])


@register("rule_truth", f"""WITH {ELOG}, q AS (SELECT DISTINCT ctx AS family, op AS api, '/f/' || field || '/x' AS path FROM elog), c AS (SELECT ctx AS family, op AS api, count(*) AS n, min(event_id) AS source FROM elog WHERE kind = 'write' GROUP BY 1, 2)
SELECT family, api, path, CASE WHEN api = 'view' THEN 'constant' WHEN n = 1 THEN 'source' ELSE 'oracle_unavailable' END AS status, CASE WHEN api <> 'view' AND n = 1 THEN source END AS source FROM q LEFT JOIN c USING (family, api)""")
def rule_truth(spark, d):
    e = ad.event_log(spark, d)
    returns = e.select(F.col("ctx").alias("family"), F.col("op").alias("api"), F.concat(F.lit("/f/"), F.col("field").cast("string"), F.lit("/x")).alias("path")).distinct()
    rules = e.select(F.col("op").alias("api")).distinct().select("api", F.lit("/f/*/x").alias("pattern"), (F.col("api") == "view").alias("constant"), F.lit("write").alias("boundary"), F.col("api").alias("wanted"))
    sources = e.select(F.col("ctx").alias("family"), F.concat(F.lit("call:"), "kind").alias("callee"), F.col("op").alias("field"), F.col("event_id").alias("source"))
    return evidence.rule_truth(returns, rules, sources)


@register("flow_alerts", f"""WITH {ELOG}, f AS (SELECT ctx, version, bool_and(event_id % 101 <> 0) AS k, bool_or(field = 1) AS s, bool_or(field = 2) AS u FROM elog WHERE kind = 'read' GROUP BY 1, 2), h AS (SELECT ctx, version, bool_or(event_id % 2 = 0 AND op = 'click') AS h FROM elog GROUP BY 1, 2)
SELECT ctx, version, CASE WHEN k THEN s END AS disclosure, CASE WHEN k THEN u AND h END AS unsafe_lookup FROM f JOIN h USING (ctx, version)""")
def flow_alerts(spark, d):
    e = ad.event_log(spark, d)
    logs = e.select("ctx", "version", F.expr("if(event_id % 2 = 0, concat(\"'\", op, \"'\"), op)").alias("expression"), F.lit("click").alias("looked_up"))
    answers = e.where("kind = 'read'").select("ctx", "version", F.col("field").alias("origin"), (F.col("event_id") % 101 != 0).alias("known"))
    return evidence.flow_alerts(answers, logs, ["ctx", "version"], F.col("origin") == 1, F.col("origin") == 2)


@register("field_candidates", f"""WITH {SPANS}, m AS (SELECT trace, max(span) FILTER (service = 'assistant' AND span > 0) AS t FROM spans GROUP BY 1)
SELECT s.trace, 1 AS query, s.span AS node, 'candidates' AS status FROM spans s JOIN m ON m.trace = s.trace AND s.span <= m.t UNION ALL SELECT trace, 1, NULL, 'sink_not_observed' FROM m WHERE t IS NULL UNION ALL SELECT trace, 2, NULL, 'sink_not_observed' FROM m""")
def field_candidates(spark, d):
    t = turns(spark, d)
    nodes = t.select("trace", "node", F.col("service").alias("path"), F.when(F.col("node") > 0, "send").otherwise("receive").alias("side"))
    queries = t.select("trace").distinct().select("trace", F.explode(F.array(F.struct(F.lit(1).alias("query"), F.lit("assistant").alias("path")), F.struct(F.lit(2).alias("query"), F.lit("none").alias("path")))).alias("q")).select("trace", "q.*")
    return evidence.field_candidates(nodes, t.where("parent is not null").select("trace", F.col("parent").alias("source"), F.col("node").alias("target")), queries, ["trace"])


@register("effect_barriers", f"""WITH RECURSIVE {ELOG}, rf AS (SELECT ctx, field AS owner, (field + 1) % 5 AS object, min(seq) AS seq FROM elog WHERE kind = 'write' GROUP BY 1, 2, 3),
r AS (SELECT ctx, event_id AS effect, seq, field AS node FROM elog WHERE kind = 'barrier' UNION SELECT r.ctx, r.effect, r.seq, rf.object FROM r JOIN rf ON rf.ctx = r.ctx AND rf.owner = r.node AND rf.seq < r.seq), b AS (SELECT ctx, node, max(seq) AS barrier FROM r GROUP BY 1, 2)
SELECT e.ctx, e.field AS owner, e.version, e.seq, coalesce(e.seq > barrier, true) AS known FROM elog e LEFT JOIN b ON b.ctx = e.ctx AND b.node = e.field WHERE e.kind = 'write'""")
def effect_barriers(spark, d):
    e = ad.event_log(spark, d)
    effects = e.where("kind = 'barrier'").select("ctx", F.col("event_id").alias("effect"), F.col("field").alias("object"), "seq")
    writes = e.where("kind = 'write'")
    references = writes.groupBy("ctx", F.col("field").alias("owner")).agg(F.min("seq").alias("seq")).withColumn("object", (F.col("owner") + 1) % 5)
    return evidence.effect_barriers(effects, references, writes.select("ctx", F.col("field").alias("owner"), "version", "seq"), ["ctx"])


@register("strict_attribution", f"""WITH {SPANS} SELECT trace, span AS node, duration_us AS bytes, CASE WHEN span >= 2 AND trace % 2 = 1 THEN 'b' WHEN span < 2 AND trace % 2 = 0 THEN 'a' ELSE 'unattributed_or_shared' END AS owner FROM spans""")
def strict_attribution(spark, d):
    t = turns(spark, d)
    owners = t.where("node = 0 and trace % 2 = 0 or node = 2").select("trace", "node", F.when(F.col("node") == 0, "a").otherwise("b").alias("owner"))
    return evidence.strict_attribution(t.select("trace", "node", "parent", F.col("duration_us").alias("bytes")), owners, ["trace"])


@register("distinguishing_features", """WITH p AS (SELECT o_orderkey % 2 AS a, o_custkey % 3 AS b, o_orderkey % 4 AS c, o_orderkey % 4 = 3 AS o FROM orders) SELECT 'a' AS feature WHERE EXISTS (SELECT 1 FROM p GROUP BY c HAVING count(DISTINCT o) > 1)
UNION ALL SELECT 'b' WHERE EXISTS (SELECT 1 FROM p GROUP BY a, c HAVING count(DISTINCT o) > 1) UNION ALL SELECT 'c' WHERE EXISTS (SELECT 1 FROM p GROUP BY a, b HAVING count(DISTINCT o) > 1)""")
def distinguishing_features(spark, d):
    p = ad.table(spark, d, "orders").select((F.col("o_orderkey") % 2).alias("a"), (F.col("o_custkey") % 3).alias("b"), (F.col("o_orderkey") % 4).alias("c"), (F.col("o_orderkey") % 4 == 3).alias("o"))
    return spark.createDataFrame([(f,) for f in evidence.distinguishing_features(p, ["a", "b", "c"], "o")], "feature string")


@register("wire_edges", """WITH l AS (SELECT page_id, 'request' AS direction, '$["u"]' AS path, url AS value FROM pages UNION ALL SELECT page_id, 'response', '$["r"][0]', url FROM pages)
SELECT *, concat_ws('|', page_id, direction, path, 'send') AS source, concat_ws('|', page_id, direction, path, 'receive') AS target, 'wire_transfer' AS kind FROM l""")
def wire_edges(spark, d):
    p = ad.table(spark, d, "pages").select("page_id", F.to_json(F.struct(F.col("url").alias("u"))).alias("request"), F.to_json(F.struct(F.array("url").alias("r"))).alias("response"))
    return evidence.wire_edges(p, ["page_id"], ["request", "response"])


# ---- packets ----


def turn_packets(spark, d):
    """Turns as segments of one stream a conversation, whose sequence numbers wrap; an opening packet comes first."""
    c = ad.table(spark, d, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    before = F.expr("coalesce(sum(octet_length(data)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)")
    segments = c.withColumn("seq", (before + (1 << 32) - 99) % (1 << 32)).where("not (conv_id % 5 = 0 and turn = 1)")
    opening = c.select("conv_id").distinct().select("conv_id", F.lit((1 << 32) - 100).alias("seq"), F.lit(True).alias("syn"), F.lit(b"").alias("data"))
    return segments.select("conv_id", "seq", F.lit(False).alias("syn"), "data").unionByName(opening).withColumn("fin", F.lit(False))


@register("reassemble", """WITH g AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS whole, string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (turn <> 1) AS rest, coalesce(sum(strlen(text)) FILTER (turn = 1), 0) AS cut, coalesce(sum(strlen(text)) FILTER (turn > 1), 0) AS late FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 5 = 0 AND cut > 0 AND late > 0 THEN 'gap' END AS issue, CASE WHEN conv_id % 5 <> 0 THEN sha256(whole) WHEN cut > 0 AND late > 0 THEN NULL ELSE sha256(coalesce(rest, '')) END AS digest FROM g""")
def reassemble(spark, d):
    return network.reassemble(turn_packets(spark, d), ["conv_id"]).select("conv_id", "issue", F.sha2("stream", 256).alias("digest"))


@register("assign_connections", """SELECT conv_id * 100 + turn AS number, CASE WHEN role = 'assistant' THEN 'response' ELSE 'request' END AS side, sum((turn = 0 AND role <> 'assistant')::INT) OVER (PARTITION BY conv_id // 2 ORDER BY conv_id * 100 + turn)::BIGINT AS connection FROM conversations""")
def assign_connections(spark, d):
    client = F.concat(F.lit("c"), F.expr("conv_id div 2").cast("string"))
    told = F.col("role") == "assistant"
    packets = ad.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("number"), F.when(told, "srv").otherwise(client).alias("src"), F.when(told, client).otherwise("srv").alias("dst"), F.col("conv_id").alias("seq"), (F.col("turn") == 0).alias("syn"))
    return network.assign_connections(packets, spark.createDataFrame([("srv",)], "endpoint string")).select("number", "side", "connection")


@register("http_transactions", """SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN 0 END AS position, CASE WHEN page_id % 7 <> 0 THEN 'GET ' || url || ' HTTP/1.1' END AS request, CASE WHEN page_id % 7 <> 0 THEN sha256(html) END AS digest, CASE WHEN page_id % 7 = 0 THEN 'unequal_counts' END AS issue FROM pages""")
def http_transactions(spark, d):
    asked = F.encode(F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1\r\nHost: x\r\n\r\n")), "utf-8")
    told = F.encode(F.concat(F.lit("HTTP/1.1 100 Continue\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), "html"), "utf-8")
    streams = ad.table(spark, d, "pages").select("page_id", asked.alias("request_stream"), F.when(F.col("page_id") % 7 != 0, told).alias("response_stream"))
    return network.http_transactions(streams, ["page_id"]).select("page_id", "position", "request", F.sha2("response_body", 256).alias("digest"), "issue")
