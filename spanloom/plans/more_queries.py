"""Registered queries of further gates, scores and projections, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import project
from ..operators import gates, graph, joins, score, spans
from . import adapters as ad
from .adapters import ELOG, SPANS
from .registry import register

CUT = "not (span = 1 and trace % 3 = 0)"


@register("capture_closed_gate", f"""WITH {ELOG}, e AS (SELECT ctx, seq, CASE WHEN seq = 1 THEN 'header' WHEN seq = max(seq) OVER (PARTITION BY ctx) AND ctx % 3 <> 0 THEN 'footer' WHEN event_id % 997 = 0 THEN 'problem' ELSE 'row' END AS k FROM elog)
SELECT ctx, 'capture_closed' AS rule, concat_ws('/', 'header', arg_max(k, seq), count(*) FILTER (k = 'footer'), count(*) FILTER (k = 'problem')) AS detail FROM e GROUP BY ctx HAVING arg_max(k, seq) <> 'footer' OR count(*) FILTER (k = 'problem') > 0""")
def capture_closed_gate(spark, d):
    kind = F.expr("case when seq = 1 then 'header' when seq = max(seq) over (partition by ctx) and ctx % 3 != 0 then 'footer' when event_id % 997 = 0 then 'problem' else 'row' end")
    e = ad.event_log(spark, d).withColumn("kind", kind).withColumn("rows_before", F.col("seq") - 1)
    return gates.capture_closed_gate(e, ["ctx"], "seq", "kind", "rows_before")


@register("task_lifecycle", f"""WITH {ELOG}, s AS (SELECT owner, field, version, count(*) FILTER (op = 'signup') AS su, count(*) FILTER (op = 'purchase') AS rj, count(*) FILTER (op = 'click') AS st, count(*) FILTER (op = 'view') AS en, count(*) FILTER (op = 'error') AS th,
min(seq) FILTER (op = 'signup') AS t0, min(seq) FILTER (op = 'click') AS t1, coalesce(min(seq) FILTER (op = 'view'), min(seq) FILTER (op = 'error')) AS t2 FROM elog GROUP BY 1, 2, 3)
SELECT owner, field, version, CASE WHEN su <> 1 OR rj + least(st, 1) > 1 OR st > 1 OR en + th > 1 OR en + th > st OR t1 <= t0 OR t2 <= t1 THEN 'violation' WHEN rj = 1 THEN 'submission_rejected' WHEN en = 1 THEN 'worker_completed' WHEN th = 1 THEN 'worker_exceptional' ELSE 'not_started' END AS status FROM s""")
def task_lifecycle(spark, d):
    names = F.create_map(*[F.lit(x) for p in {"signup": "submit", "purchase": "reject", "click": "start", "view": "end", "error": "throw"}.items() for x in p])
    return gates.task_lifecycle(ad.event_log(spark, d).withColumn("step", names[F.col("op")]), ["owner", "field", "version"], "step", "seq")


@register("rooted_tree_gate", f"WITH {SPANS} SELECT trace, count(*) - 1 AS n, count(*) - 2 AS m, 1::BIGINT AS reached FROM spans WHERE trace % 3 = 0 GROUP BY 1 HAVING max(span) > 1")
def rooted_tree_gate(spark, d):
    t = ad.turn_spans(spark, d).where(CUT)
    return spans.rooted_tree_gate(t.select("trace", F.col("span").alias("node")), t.where("parent is not null").select("trace", "parent", F.col("span").alias("child")), t.where("span = 0").select("trace", F.col("span").alias("node")))


@register("missing_endpoints", f"WITH {SPANS}, r AS (SELECT DISTINCT trace, unnest(['system', 'user', 'assistant']) AS service FROM spans) SELECT trace, service, service AS path FROM r WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.trace = r.trace AND s.service = r.service)")
def missing_endpoints(spark, d):
    t = ad.turn_spans(spark, d).withColumn("kind", F.lit("SERVER"))
    required = t.select("trace").distinct().select("trace", F.explode(F.array(*[F.lit(r) for r in ("system", "user", "assistant")])).alias("service")).withColumn("path", F.col("service"))
    return spans.missing_endpoints(t, required)


@register("membership_score", f"""WITH {SPANS}, r AS (SELECT trace, span AS n FROM spans WHERE span > 0), p AS (SELECT trace, span AS n FROM spans WHERE span > 0 AND span % 3 <> 2 UNION SELECT trace, parent FROM spans WHERE span % 3 <> 2 AND parent > 0),
j AS (SELECT coalesce(r.trace, p.trace) AS trace, r.n IS NOT NULL AS e, p.n IS NOT NULL AS a FROM r FULL JOIN p ON r.trace = p.trace AND r.n = p.n), c AS (SELECT trace, count(*) FILTER (e AND a) AS tp, count(*) FILTER (NOT e AND a) AS fp, count(*) FILTER (e AND NOT a) AS fn FROM j GROUP BY 1) SELECT *, fp = 0 AND fn = 0 AS exact FROM c""")
def membership_score(spark, d):
    edges = ad.turn_spans(spark, d).where("parent is not null").select("trace", "parent", F.col("span").alias("child"), F.lit(0).cast("long").alias("root"))
    return score.membership_score(edges, edges.where("child % 3 != 2"), "trace", "parent", "child", "root")


@register("answer_state", """WITH g AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS e, list_sort(list(DISTINCT l_suppkey) FILTER (l_linenumber % 2 = 1)) AS a FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN k % 13 = 0 THEN 'planning_refused' WHEN a IS NULL THEN 'unknown' WHEN a = e THEN 'known_correct' ELSE 'known_wrong' END AS state, CASE WHEN k % 13 = 0 THEN 'rejected' WHEN a IS NULL THEN 'unknown' WHEN a = e THEN 'correct' ELSE 'wrong' END AS rolled FROM g""")
def answer_state(spark, d):
    odd = F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey")))
    g = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias("e"), F.when(F.size(odd) > 0, odd).alias("a"))
    state = score.answer_state(F.when(F.col("k") % 13 == 0, "planning_refused").otherwise("answered"), F.col("e"), F.col("a"))
    return g.select("k", state.alias("state")).withColumn("rolled", score.state_rollup(F.col("state")))


@register("decode_tokens", "WITH i AS (SELECT c_custkey AS token, count(*) AS n, min(c_name) AS s FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_nationkey = 3) GROUP BY 1) SELECT o_orderkey, o_custkey AS token, CASE WHEN n = 1 THEN s ELSE 'unknown-token' END AS source FROM orders LEFT JOIN i ON token = o_custkey")
def decode_tokens(spark, d):
    c = ad.table(spark, d, "customer")
    index = c.unionByName(c.where("c_nationkey = 3")).select(F.col("c_custkey").alias("token"), F.col("c_name").alias("source"))
    return joins.decode_tokens(ad.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("token")), index, "token").select("o_orderkey", "token", "source")


@register("offsets_to_fields", f"""WITH {ELOG}, o AS (SELECT DISTINCT ctx, event_id % 40 AS "offset" FROM elog), s AS (SELECT ctx, field, field * 8 AS b, field * 8 + count(*) % 12 AS f FROM elog WHERE kind = 'write' GROUP BY 1, 2)
SELECT o.ctx, o."offset", coalesce(min('f' || s.field), '$nonvalue-byte:' || o."offset") AS field, count(s.field) > 1 AS overlap FROM o LEFT JOIN s ON s.ctx = o.ctx AND o."offset" >= b AND o."offset" < f GROUP BY 1, 2""")
def offsets_to_fields(spark, d):
    e = ad.event_log(spark, d)
    fields = e.where("kind = 'write'").groupBy("ctx", "field").agg((F.col("field") * 8).alias("begin"), (F.col("field") * 8 + F.count("*") % 12).alias("finish")).withColumn("field", F.concat(F.lit("f"), F.col("field").cast("string")))
    return joins.offsets_to_fields(e.select("ctx", (F.col("event_id") % 40).alias("offset")).distinct(), fields, ["ctx"])


@register("cell_project", "SELECT s_name AS value, s_suppkey AS record, 0 AS file FROM supplier")
def cell_project(spark, d):
    cells = joins.with_cells(ad.table(spark, d, "supplier").select(F.col("s_suppkey").alias("rec"), "s_name", "s_nationkey"), 0, "rec")
    return joins.cell_project(cells, ["rec", "s_nationkey"], complement=True).select("s_name.value", "s_name.record", "s_name.file")


@register("observation_closure", """WITH RECURSIVE u AS (SELECT DISTINCT user_id AS f FROM events), n AS (SELECT f FROM u WHERE f % 4 = 3 UNION SELECT n.f // 2 FROM n JOIN u USING (f)), x AS (SELECT event_type || user_id % 10 AS site, list_sort(list(DISTINCT user_id) FILTER (user_id IN (SELECT f FROM n))) AS r FROM events GROUP BY 1)
SELECT site, CASE WHEN r IS NULL THEN 'drop' ELSE 'keep' END AS action, CASE WHEN r IS NULL THEN 'no fact of it is needed' ELSE 'producer of a needed fact' END AS reason, coalesce(array_to_string(r, ','), '') AS relevant FROM x""")
def observation_closure(spark, d):
    e = ad.table(spark, d, "events")
    users = e.select(F.col("user_id").alias("fact")).distinct()
    site = F.concat("event_type", (F.col("user_id") % 10).cast("string"))
    out = graph.observation_closure(e.select(site.alias("site"), F.col("user_id").alias("fact")), users.withColumn("dependency", F.expr("fact div 2")), users.where("fact % 4 = 3"))
    return out.withColumn("relevant", F.array_join(F.col("relevant").cast("array<string>"), ","))


@register("parse_traceparent", "SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN md5(url) END AS trace_id, CASE WHEN page_id % 5 <> 0 THEN left(md5(html), 16) END AS span_id, CASE WHEN page_id % 5 <> 0 THEN page_id % 2 = 1 END AS sampled FROM pages")
def parse_traceparent(spark, d):
    header = F.concat(F.when(F.col("page_id") % 5 == 0, "01-").otherwise("00-"), F.md5("url"), F.lit("-"), F.left(F.md5("html"), F.lit(16)), F.lit("-0"), (F.col("page_id") % 2).cast("string"))
    return ad.table(spark, d, "pages").select("page_id", project.parse_traceparent(header).alias("t")).select("page_id", "t.trace_id", "t.span_id", "t.sampled")


@register("leak_check", "WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(url, '[^A-Za-z0-9_-]+')) AS id FROM pages) SELECT DISTINCT page_id::VARCHAR AS id FROM pages JOIN t ON t.id = page_id::VARCHAR")
def leak_check(spark, d):
    p = ad.table(spark, d, "pages")
    return project.leak_check(p, p.select(F.col("page_id").cast("string").alias("id")), "url", "id")


@register("project_observations", """WITH u AS (SELECT page_id, url, page_id % 3 AS s FROM pages) SELECT page_id AS trace, 1::BIGINT AS span, 's' || s AS service, 'CLIENT' AS kind, 'GET' AS method, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1) AS peer, 200 AS status_code FROM u WHERE s < 2""")
def project_observations(spark, d):
    tags = F.create_map(F.lit("http.request.method"), F.lit("get"), F.lit("url.full"), F.col("url"), F.lit("http.status_code"), F.lit("200"))
    p = ad.table(spark, d, "pages").select(F.col("page_id").alias("trace"), F.lit(1).cast("long").alias("span"), F.lit(None).cast("long").alias("parent"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("service"), F.lit("CLIENT").alias("kind"), tags.alias("tags"), F.lit(0).alias("start_us"), F.lit(1).alias("duration_us"))
    return project.project_observations(p, ["s0", "s1"]).drop("parent", "start_us", "duration_us")


@register("wildcard_path_match", "WITH p AS (SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path FROM pages) SELECT page_id, regexp_full_match(path, '/en/[0-9]+') AS strict, regexp_full_match(path, '/en/[^/]*') AS loose FROM p")
def wildcard_path_match(spark, d):
    path, pattern = project.url_path(F.col("url")), F.lit("/en/*")
    return ad.table(spark, d, "pages").select("page_id", project.wildcard_path_match(path, pattern).alias("strict"), project.wildcard_path_match(path, pattern, strict=False).alias("loose"))


@register("categorize", "SELECT CASE event_type WHEN 'view' THEN 'reading' WHEN 'click' THEN 'reading' WHEN 'purchase' THEN 'writing' END AS category, count(*) AS n FROM events GROUP BY 1")
def categorize(spark, d):
    return project.categorize(ad.table(spark, d, "events"), {"view": "reading", "click": "reading", "purchase": "writing"}, "event_type").groupBy("category").agg(F.count("*").alias("n"))


@register("split_phase", "SELECT CASE WHEN starts_with(event_type, 'sign') THEN 'warm-up' ELSE 'steady' END AS phase, count(*) AS n FROM events GROUP BY 1")
def split_phase(spark, d):
    return project.split_phase(ad.table(spark, d, "events"), "event_type", "sign").groupBy("phase").agg(F.count("*").alias("n"))
