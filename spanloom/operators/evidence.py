"""Evidence matched across services: exchanges, contexts, wire calls, buffers, references, rules, alerts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.project import contained, json_leaves, wildcard_path_match
from ..scratch import materialize
from .graph import backward_slice, climb, reach, root_of
from .joins import unique_join
from .ranges import MOST_PIECES, PIECE_ROWS, fits, overlaps, running


def _differ(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def exchange_bridge(sends: DataFrame, receives: DataFrame, key: list[str], body: str, fields: str, service: str | None = None) -> DataFrame:
    """Exchanges of both sides with ``status``: matched only where each side has one message with equal body and equal field sets.

    With ``service``, a column of both sides, an exchange whose two ends are one service is same_service.
    """
    extra = [service] if service else []
    side = lambda df, p: df.groupBy(*key).agg(F.count("*").alias(f"{p}_n"), F.min(body).alias(f"{p}_body"), F.min(F.array_sort(F.array_distinct(fields))).alias(f"{p}_fields"), *[F.min(c).alias(f"{p}_service") for c in extra])
    both = side(sends, "s").join(side(receives, "r"), key, "full_outer")
    status = F.when(F.col("s_n").isNull(), "missing_send").when(F.col("r_n").isNull(), "missing_receive").when((F.col("s_n") > 1) | (F.col("r_n") > 1), "ambiguous")
    if service:
        status = status.when(F.col("s_service").eqNullSafe(F.col("r_service")), "same_service")
    status = status.when(_differ("s_body", "r_body"), "body_differs").when(_differ("s_fields", "r_fields"), "fields_differ").otherwise("matched")
    return both.select(*key, status.alias("status"))


def reused_connections(messages: DataFrame, connection: list[str], service: str, direction: str, phase: str, message: str) -> DataFrame:
    """(service, connection, side) that carry more than one message: no exchange over them is admitted.

    A request written or a response read is the client's side, the others are the server's.
    """
    client = (F.col(direction) == "request") == (F.col(phase) == "write")
    ends = messages.groupBy(service, *connection, F.when(client, "client").otherwise("server").alias("side"))
    return ends.agg(F.count_distinct(message).alias("messages")).where("messages > 1")


def context_match(events: DataFrame, message: list[str], role: str, span: str, parent: str) -> DataFrame:
    """Messages with ``status``: matched where one client and one server saw it, the server's parent is the client's span and the spans differ."""
    c, s = F.col(role) == "client", F.col(role) == "server"
    m = events.groupBy(*message).agg(F.count_if(c).alias("clients"), F.count_if(s).alias("servers"), F.min(F.when(c, F.col(span))).alias("client_span"), F.min(F.when(s, F.col(span))).alias("server_span"), F.min(F.when(s, F.col(parent))).alias("server_parent"))
    status = F.when((F.col("clients") == 0) | (F.col("servers") == 0), "missing").when((F.col("clients") > 1) | (F.col("servers") > 1), "ambiguous").when(F.col("client_span").eqNullSafe(F.col("server_span")), "same_span").when(_differ("server_parent", "client_span"), "parent_differs").otherwise("matched")
    return m.select(*message, status.alias("status"))


def wire_call_reconcile(wire: DataFrame, calls: DataFrame, key: list[str], checks: list[str]) -> DataFrame:
    """Packet-level exchanges and agents' calls by key (trace, parent span, method, target), with one ``reason``.

    matched, wire_only, call_only, ambiguous, or the first of the check columns that differs: both sides carry the columns to
    compare, such as endpoints, the response's back reference (``responses``, ``back_reference``) and the status.
    """
    side = lambda df, p: df.groupBy(*key).agg(F.count("*").alias(f"{p}_n"), *[F.min(c).alias(f"{p}_{c}") for c in checks])
    both = side(wire, "w").join(side(calls, "c"), key, "full_outer")
    reason = F.when(F.col("w_n").isNull(), "call_only").when(F.col("c_n").isNull(), "wire_only").when((F.col("w_n") > 1) | (F.col("c_n") > 1), "ambiguous")
    for c in checks:
        reason = reason.when(_differ(f"w_{c}", f"c_{c}"), c)
    return both.select(*key, reason.otherwise("matched").alias("reason"))


def wire_responses(requests: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Wire requests (key, endpoints, response_in) with their one response (key, its own number, endpoints) and a ``reason``.

    matched, missing_response, ambiguous_response, back_reference (the request names another response) or endpoint (the
    response doesn't come from where the request went). Requests have src, dst, response_in; responses have number, src, dst, status.
    """
    one = unique_join(requests, responses.select(*key, F.col("number").alias("response"), F.col("src").alias("from"), F.col("dst").alias("to"), F.col("status").alias("http_status")), key)
    reason = F.when(F.col("status") != "matched", F.concat("status", F.lit("_response"))).when(_differ("response_in", "response"), "back_reference").when(_differ("from", "dst") | _differ("to", "src"), "endpoint").otherwise("matched")
    return one.select(*key, reason.alias("reason"), F.when(reason == "matched", F.col("response")).alias("response"), F.when(reason == "matched", F.col("http_status")).alias("http_status"))


def span_chains(spans: DataFrame, checks: dict[str, Column] | None = None, closed: bool = False) -> DataFrame:
    """Driver spans (those of kind INTERNAL) with the server below each, the client below that and the server below the client.

    Columns trace, span, server, client, upstream, ``status``: matched where each step has exactly one child of the kind,
    else missing or ambiguous at the first step that fails. ``checks`` has a condition for steps, over the span's own columns
    (such as a remote parent flag or the service's name); a step whose span fails it is wrong at that step. With ``closed``
    each span is used once and the chain ends with its last server: a span that was exported twice makes the chains of its
    trace reused_span, and a last server with spans below it has status open_upstream.
    """
    checks = checks or {}

    def below(kind: str, name: str, parent: str) -> DataFrame:
        good = F.coalesce(checks.get(name, F.lit(True)), F.lit(False))
        return spans.where(F.col("kind") == kind).groupBy("trace", F.col("parent").alias(parent)).agg(F.count("*").alias(f"{name}_n"), F.min("span").alias(name), F.bool_and(good).alias(f"{name}_good"))

    out = spans.where("kind = 'INTERNAL'").select("trace", "span")
    out = out.join(below("SERVER", "server", "span"), ["trace", "span"], "left").join(below("CLIENT", "client", "server"), ["trace", "server"], "left").join(below("SERVER", "upstream", "client"), ["trace", "client"], "left")
    status = F.when(F.lit(False), "")
    for name in ("server", "client", "upstream"):
        status = status.when(F.col(f"{name}_n").isNull(), f"missing_{name}").when(F.col(f"{name}_n") > 1, f"ambiguous_{name}").when(~F.col(f"{name}_good"), f"wrong_{name}")
    if closed:
        twice = spans.groupBy("trace", "span").agg(F.count("*").alias("n")).where("n > 1").select("trace", F.lit(True).alias("reused")).distinct()
        parents = spans.select("trace", F.col("parent").alias("upstream"), F.lit(True).alias("open")).distinct()
        out = out.join(twice, "trace", "left").join(parents, ["trace", "upstream"], "left")
        status = F.when(F.col("reused"), "reused_span").otherwise(status.when(F.col("open"), "open_upstream").otherwise("matched"))
    else:
        status = status.otherwise("matched")
    return out.select("trace", "span", *[F.when(status == "matched", F.col(c)).alias(c) for c in ("server", "client", "upstream")], status.alias("status"))


def chain_leftovers(spans: DataFrame, chains: DataFrame) -> DataFrame:
    """Spans (trace, span) that no matched chain uses."""
    used = chains.where("status = 'matched'").select("trace", F.explode(F.array("span", "server", "client", "upstream")).alias("span"))
    return spans.select("trace", "span").join(used, ["trace", "span"], "left_anti")


def select_sync_scope(spans: DataFrame, http: Column | None = None) -> DataFrame:
    """Spans (trace, span) that are no producer or consumer and have none above them; a broken chain stays.

    With ``http``, a condition on spans, only such spans and what stands above them up to the root are selected.
    """
    tree = spans.select("trace", F.col("span").alias("node"), "parent")
    queued = spans.where("kind in ('PRODUCER', 'CONSUMER')").select("trace", "span")
    above = climb(tree, ["trace"], marks=queued.select("trace", F.col("span").alias("node"), F.lit("q").alias("mark")))
    behind = above.where("lo is not null").select("trace", F.col("node").alias("span"))
    sync = spans.join(queued.unionByName(behind).distinct(), ["trace", "span"], "left_anti")
    if http is None:
        return sync.select("trace", "span")
    heads = sync.where(http).select("trace", F.col("span").alias("node"))
    up = reach(spans.where("parent is not null").select("trace", F.col("span").alias("parent"), F.col("parent").alias("child")), heads, ["trace"])
    kept = up.select("trace", F.col("node").alias("span")).distinct()
    return sync.select("trace", "span").join(kept, ["trace", "span"], "left_semi")


def foreign_id_hits(paths: DataFrame, requests: DataFrame, trace: str, path: str, ident: str, substring: bool = False) -> DataFrame:
    """(trace, owner, id): ids of other requests that stand as a token in a trace's path or, with ``substring``, anywhere in it."""
    if substring:
        tokens = contained(paths.select(trace, path), requests, path, ident).select(trace, ident)
    else:
        tokens = paths.select(trace, F.explode(F.array_distinct(F.split(F.col(path), r"[^A-Za-z0-9]+"))).alias(ident)).where(F.col(ident) != "")
    owned = requests.select(F.col(trace).alias("owner"), ident).distinct()
    return tokens.join(owned, ident).where(F.col("owner") != F.col(trace)).select(trace, "owner", ident).distinct()


def select_entry_queries(obs: DataFrame, manifest: DataFrame, key: list[str], entry: Column) -> DataFrame:
    """Entry operations against a manifest: key and ``status`` query, not_in_manifest or not_observed."""
    seen = obs.where(entry).select(*key).distinct().withColumn("seen", F.lit(True))
    both = seen.join(manifest.select(*key).distinct().withColumn("listed", F.lit(True)), key, "full_outer")
    return both.select(*key, F.when(F.col("listed").isNull(), "not_in_manifest").when(F.col("seen").isNull(), "not_observed").otherwise("query").alias("status"))


def buffer_origin(reads: DataFrame, uses: DataFrame, context: list[str]) -> DataFrame:
    """Each used range's source: ``op`` and ``origin`` (its first offset) where every byte was last read by one operation at consecutive offsets.

    ``reads`` has context, seq, op, address, length, offset; ``uses`` has context, seq, use, address, length. Ranges without
    a single source have nulls. A read at the same seq as a use doesn't count.

    Addresses of a context are cut wherever a read or a use begins or ends, and numbered. A read or use is a run of these
    intervals, with a row for each, so rows follow how many ranges share an address and not how many bytes they have. Offsets
    are consecutive where the distance of offset and address is one.
    """
    kind = uses.schema["use"].dataType
    r = reads.where("length > 0").select(*context, "seq", F.col("address").alias("begin"), (F.col("address") + F.col("length")).alias("finish"), F.struct("op", (F.col("offset") - F.col("address")).alias("shift")).alias("read"), F.lit(None).cast(kind).alias("use"))
    u = uses.where("length > 0").select(*context, "seq", F.col("address").alias("begin"), (F.col("address") + F.col("length")).alias("finish"), F.lit(None).cast(r.schema["read"].dataType).alias("read"), "use")
    rows = materialize(r.unionByName(u), "ranges")
    cuts = rows.select(*context, F.explode(F.array("begin", "finish")).alias("begin")).distinct()
    places = materialize(running(cuts, context, ["begin"], sums={"first": F.lit(1)}, small=fits(rows, context) or None), "cuts")
    spans = rows.join(places, [*context, "begin"]).join(places.select(*context, F.col("begin").alias("finish"), F.col("first").alias("last")), [*context, "finish"])
    parts = spans.withColumn("part", F.explode(F.sequence("first", F.col("last") - 1)))
    # uses come before reads of the same seq
    parts = parts.select(*context, "part", "seq", F.col("use").isNull().alias("later"), "begin", "read", "use")
    last = running(parts, [*context, "part"], ["seq", "later"], lasts={"found": F.col("read")}).where("use is not null")
    whole = last.groupBy(*context, "use").agg(F.count_if(F.col("found").isNull()).alias("holes"), F.min("found").alias("lo"), F.max("found").alias("hi"), F.min("begin").alias("begin"))
    one = F.expr("holes = 0 and lo = hi")
    return whole.select(*context, "use", F.when(one, F.col("lo.op")).alias("op"), F.when(one, F.col("lo.shift") + F.col("begin")).alias("origin"))


def transfers(up: DataFrame, down: DataFrame, key: list[str], once: bool = False) -> DataFrame:
    """Downstream reads (key, node, body) with the one upstream response (key, node, body) of the same key: key, source, target, start, end, status.

    ``status`` is matched, missing, ambiguous, body_differs, empty or, with ``once``, reused: more than one read of the key. A
    match covers the positions from start to end of the body, in one row; ids get the side as a prefix. Both sides are as
    large as the traffic, however small Spark takes a few columns of a file to be, so they are shuffled and not broadcast.
    """
    one = unique_join(down.select(*key, F.col("node").alias("target"), "body"), up.select(*key, F.col("node").alias("source"), F.col("body").alias("sent")).hint("merge"), key)
    status = F.when(F.col("status") != "matched", F.col("status")).when(_differ("body", "sent"), "body_differs").when(F.col("body") == "", "empty").otherwise("matched")
    rows = one.withColumn("status", status)
    if once:
        reads = down.groupBy(*key).agg(F.count("*").alias("reads"))
        rows = rows.join(reads.hint("merge"), key).withColumn("status", F.when(F.expr("status = 'matched' and reads > 1"), "reused").otherwise(F.col("status")))
    good = F.col("status") == "matched"
    named = lambda side, c: F.concat(F.lit(f"{side}:"), F.col(c).cast("string"))
    return rows.select(*key, F.when(good, named("up", "source")).alias("source"), named("down", "target").alias("target"), F.when(good, F.lit(0)).alias("start"), F.when(good, F.octet_length("body")).alias("end"), "status")


def stitch_services(up: DataFrame, down: DataFrame, key: list[str]) -> DataFrame:
    """Edges (key, source, target, start, end) from the one upstream response to a downstream read of the same key where the bodies are equal; one row covers all positions."""
    return transfers(up, down, key).where("status = 'matched'").drop("status")


def stitched_graph(up_edges: DataFrame, down_edges: DataFrame, moved: DataFrame, key: list[str], bucket: int = 16) -> DataFrame:
    """One graph of two services: key, source, target, kind, with the ids' sides as prefixes.

    Edges have key, source, target, kind and, where they carry a part of a body, its positions ``start`` and ``end``: into an
    upstream response, and out of a downstream read. ``moved`` is what ``transfers`` matched. A matched read node is
    replaced: its edges go, and what it gave its positions to is linked to what the response had those positions from. So an
    overwritten position has no link, and nothing hangs on the read as a whole.
    """
    good = materialize(moved.where("status = 'matched'").select(*key, "source", "target"), "moved").hint("merge")
    named = lambda df, side: df.select(*key, F.concat(F.lit(f"{side}:"), F.col("source").cast("string")).alias("source"), F.concat(F.lit(f"{side}:"), F.col("target").cast("string")).alias("target"), "kind", "start", "end")
    above, below = named(up_edges, "up"), named(down_edges, "down")
    kept = below.join(good.select(*key, F.col("target").alias("source")), [*key, "source"], "left_anti")
    written = above.where("start is not null").select(*key, F.col("source").alias("writer"), F.col("target").alias("response"), F.col("start").alias("from_at"), F.col("end").alias("from_end"))
    written = written.join(good.select(*key, F.col("source").alias("response"), F.col("target").alias("read")), [*key, "response"])
    used = below.where("start is not null").select(*key, F.col("source").alias("read"), F.col("target").alias("user"), F.col("start").alias("to_at"), F.col("end").alias("to_end"))
    links = overlaps(written, used, [*key, "read"], bucket, ("from_at", "from_end"), ("to_at", "to_end"))
    links = links.select(*key, F.col("writer").alias("source"), F.col("user").alias("target"), F.lit("transfer").alias("kind"), F.greatest("from_at", "to_at").alias("start"), F.least("from_end", "to_end").alias("end"))
    return above.unionByName(kept).unionByName(links)


def reference_identity(inputs: DataFrame, publications: DataFrame, outputs: DataFrame, scope: list[str]) -> DataFrame:
    """Output slots (scope, slot) with ``status`` and, if exact, the input ``position`` that held the object.

    The slot's last publication (slot, object, seq) must name the output's object; that object's positions among the inputs
    (position, object) decide: one exact, more ambiguous, none unknown.
    """
    last = publications.groupBy(*scope, "slot").agg(F.max_by("object", "seq").alias("published"))
    places = inputs.groupBy(*scope, "object").agg(F.count("*").alias("n"), F.min("position").alias("position"))
    rows = outputs.join(last, [*scope, "slot"], "left").join(places, [*scope, "object"], "left")
    status = F.when(_differ("published", "object"), "unknown").when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("exact")
    return rows.select(*scope, "slot", status.alias("status"), F.when(status == "exact", F.col("position")).alias("position"))


def source_family(frames: DataFrame, sources: DataFrame, by: list[str]) -> DataFrame:
    """Source events (node, source) with the ``root`` frame above them, over frames (node, parent); a frame without parent is its own root."""
    roots = root_of(frames, by).where("status = 'root'").select(*by, "node", "root")
    return sources.join(roots, [*by, "node"]).select(*by, "root", "source")


def rule_truth(returns: DataFrame, rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Expected source of each returned field (family, api, path): ``status`` constant, source or oracle_unavailable, and ``source``.

    Rules have api, pattern, constant, boundary and wanted; a source (family, callee, field, source) counts if its callee
    contains the rule's boundary and its field is the wanted one. None or several give no answer.
    """
    ruled = returns.join(rules, "api").where(wildcard_path_match(F.col("path"), F.col("pattern")))
    one = ruled.groupBy(*returns.columns).agg(F.count("*").alias("rules"), F.first(F.struct("constant", "boundary", "wanted")).alias("rule"))
    rows = returns.join(one, returns.columns, "left").withColumn("field", F.col("rule.wanted"))
    found = rows.where("rules = 1 and not rule.constant").join(sources, ["family", "field"]).where(F.expr("contains(callee, rule.boundary)")).groupBy(*returns.columns).agg(F.count("*").alias("n"), F.min("source").alias("source"))
    out = rows.join(found, returns.columns, "left")
    return out.select(*returns.columns, F.when(~F.col("rules").eqNullSafe(1), "oracle_unavailable").when(F.col("rule.constant"), "constant").when(F.col("n") == 1, "source").otherwise("oracle_unavailable").alias("status"), F.when(F.col("n") == 1, F.col("source")).alias("source"))


def flow_alerts(answers: DataFrame, logs: DataFrame, frame: list[str], sensitive: Column, untrusted: Column) -> DataFrame:
    """Per sink frame: ``disclosure`` and ``unsafe_lookup``; null where the origins are unknown.

    ``answers`` has frame, origin and known, a row an origin; ``logs`` has frame, expression and looked_up. The lookup is
    unsafe if an origin is untrusted and the expression is one quoted literal equal to the key looked up.
    """
    facts = answers.groupBy(*frame).agg(F.bool_and("known").alias("known"), F.bool_or(F.coalesce(sensitive, F.lit(False))).alias("s"), F.bool_or(F.coalesce(untrusted, F.lit(False))).alias("u"))
    literal = F.regexp_extract("expression", r"^\s*[\"']([^\"']*)[\"']\s*$", 1)
    hit = logs.groupBy(*frame).agg(F.bool_or(F.coalesce((literal == F.col("looked_up")) & (literal != ""), F.lit(False))).alias("hit"))
    known = F.col("known")
    return facts.join(hit, frame, "left").select(*frame, F.when(known, F.col("s")).alias("disclosure"), F.when(known, F.col("u") & F.coalesce("hit", F.lit(False))).alias("unsafe_lookup"))


def field_candidates(nodes: DataFrame, edges: DataFrame, queries: DataFrame, by: list[str]) -> DataFrame:
    """Whole candidate subgraph of each query (by, query, path): by, query, node, ``status``. Sinks are nodes sent with that path; without one there is one row, sink_not_observed."""
    sinks = queries.join(nodes.where("side = 'send'").select(*by, "path", "node"), [*by, "path"], "left")
    walked = backward_slice(edges, sinks.where("node is not null").select(*by, "node").distinct(), by)
    got = sinks.withColumnRenamed("node", "root").join(walked, [*by, "root"], "left")
    return got.select(*by, "query", F.coalesce("node", "root").alias("node"), F.when(F.col("root").isNull(), "sink_not_observed").otherwise("candidates").alias("status")).distinct()


def effect_barriers(effects: DataFrame, references: DataFrame, versions: DataFrame, by: list[str]) -> DataFrame:
    """Versions (by, owner, version, seq) with ``known``: false if written no later than an opaque effect (by, object, effect, seq) that spreads to the owner.

    An effect spreads over references (by, owner, object, seq) written before it, from an owner to its object.

    Each node has one label, the greatest seq of the effects that reach it, and passes it on over references written before
    it: where the greatest is too early for a reference, all others are too. Only labels that rose in a round are passed on
    in the next, so cycles end.
    """
    links = materialize(references.groupBy(*by, F.col("owner").alias("node"), F.col("object").alias("next")).agg(F.min("seq").alias("at")), "references")
    labels = materialize(effects.groupBy(*by, F.col("object").alias("node")).agg(F.max("seq").alias("barrier")), "labels")
    risen = labels
    while True:
        passed = risen.join(links, [*by, "node"]).where("at < barrier").groupBy(*by, F.col("next").alias("node")).agg(F.max("barrier").alias("new"))
        risen = materialize(passed.join(labels, [*by, "node"], "left").where("barrier is null or new > barrier").select(*by, "node", F.col("new").alias("barrier")), "risen")
        if risen.isEmpty():
            break
        labels = materialize(labels.unionByName(risen).groupBy(*by, "node").agg(F.max("barrier").alias("barrier")), "labels")
    return versions.join(labels.withColumnRenamed("node", "owner"), [*by, "owner"], "left").select(*versions.columns, F.coalesce(F.col("seq") > F.col("barrier"), F.lit(True)).alias("known"))


def strict_attribution(records: DataFrame, owners: DataFrame, by: list[str]) -> DataFrame:
    """Records (by, node, parent, bytes) with the one owner among themselves and their parents, else unattributed_or_shared."""
    marks = owners.select(*by, "node", F.col("owner").alias("mark"))
    above = climb(records.select(*by, "node", "parent"), by, marks=marks).select(*by, "node", "lo", "hi", "status")
    own = marks.groupBy(*by, "node").agg(F.min("mark").alias("own_lo"), F.max("mark").alias("own_hi"))
    all_of = records.join(above, [*by, "node"], "left").join(own, [*by, "node"], "left").withColumns({"lo": F.least("lo", "own_lo"), "hi": F.greatest("hi", "own_hi")})
    one = F.expr("lo = hi and not (status <=> 'cycle')")
    return all_of.select(*by, "node", "bytes", F.when(one, F.col("lo")).otherwise("unattributed_or_shared").alias("owner"))


def attribution_balance(attributed: DataFrame, phases: DataFrame, by: list[str]) -> DataFrame:
    """Records and bytes of each phase, owners' phases from (owner, phase), the rest unattributed_or_shared; ``batch_bytes`` is their sum."""
    rows = attributed.join(phases.select("owner", "phase"), "owner", "left").withColumn("phase", F.coalesce("phase", F.lit("unattributed_or_shared")))
    sums = rows.groupBy(*by, "phase").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))
    return sums.withColumn("batch_bytes", F.sum("bytes").over(Window.partitionBy(*by)))


def distinguishing_features(paths: DataFrame, features: list[str], outcome: str) -> list[str]:
    """Features left after deleting, last name first, each one without which every signature still has one outcome. One grouping a feature."""
    kept = sorted(features)
    small = paths.groupBy(*kept, outcome).agg(F.count("*").alias("n"))
    for name in sorted(features, reverse=True):
        rest = [f for f in kept if f != name]
        kinds = small.groupBy(*rest).agg(F.count_distinct(F.struct(outcome)).alias("kinds"))
        if kinds.where("kinds > 1").isEmpty():
            kept = rest
    return kept


def wire_edges(transactions: DataFrame, keys: list[str], bodies: list[str]) -> DataFrame:
    """Edges of kind wire_transfer, one for each JSON leaf of each body column: keys, direction, path, value, source, target."""
    out = None
    for body in bodies:
        leaves = json_leaves(transactions, body, keys, "jsonpath").withColumn("direction", F.lit(body))
        out = leaves if out is None else out.unionByName(leaves)
    name = lambda side: F.concat_ws("|", *[F.col(k).cast("string") for k in keys], "direction", "path", F.lit(side))
    return out.select(*keys, "direction", "path", "value", name("send").alias("source"), name("receive").alias("target"), F.lit("wire_transfer").alias("kind"))


def candidate_value_edges(received: DataFrame, sent: DataFrame, scope: list[str]) -> DataFrame:
    """All (source, target) of values received and later sent on with equal content in one scope (service and inbound request), as labelled candidates.

    Both have scope, node, value, at; values are compared by sha256, then whole.
    """
    pack = lambda df, node, value, at: df.select(*scope, F.sha2("value", 256).alias("digest"), F.col("node").alias(node), F.col("value").alias(value), F.col("at").alias(at))
    pairs = pack(received, "source", "got", "got_at").join(pack(sent, "target", "put", "put_at"), [*scope, "digest"])
    return pairs.where("got = put and got_at < put_at").select(*scope, "source", "target", F.lit("candidate").alias("kind"))


def _open_throughout(batches: Iterator[pa.RecordBatch], separator: str | None = None, rows: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Source, target and contexts: of the requests around, those open from a source's call to the sending of a later target; ``rows`` bounds what is held.

    A source's targets, in the order of time, look only at the requests that were open during its call, not at all around.
    """
    for batch in batches:
        for sources, targets, around in zip(*(batch.column(n) for n in ("sources", "targets", "around")), strict=True):
            sources, targets = sources.values, targets.values.take(pc.array_sort_indices(targets.values.field("target_at")))
            field = lambda of, *names: [of.field(n).to_numpy() for n in names]
            (source_at, call_at), (target_at,), (begin, end) = field(sources, "source_at", "call_at"), field(targets, "target_at"), field(around.values, "from_us", "to_us")
            ids = [sources.field("source"), targets.field("target"), around.values.field("tx")]
            if separator is not None:
                ids[2] = ids[2].cast(pa.string())
            held, size, tall = [], 0, max(1, rows // len(end))
            for top in range(0, len(source_at), tall):
                at, call = source_at[top : top + tall], call_at[top : top + tall]
                fit = (begin <= call[:, None]) & (end >= at[:, None])
                reach = np.where(fit, end, np.iinfo(np.int64).min).max(axis=1)
                first, last = np.searchsorted(target_at, at), np.searchsorted(target_at, reach, "right")
                for k in np.flatnonzero(first < last):
                    near = np.flatnonzero(fit[k])
                    step = max(1, rows // len(near))
                    for low in range(first[k], last[k], step):
                        when = target_at[low : min(low + step, last[k]), None]
                        still = end[near] >= when
                        if call[k] > at[k]:
                            still &= begin[near] <= when
                        held.append((top + k, low, np.count_nonzero(still, axis=1), np.broadcast_to(near, still.shape)[still]))
                        size += len(held[-1][3])
                        if size >= rows:
                            yield _edges(held, ids, separator)
                            held, size = [], 0
            if size:
                yield _edges(held, ids, separator)


def _edges(held: list[tuple], ids: list[pa.Array], separator: str | None) -> pa.RecordBatch:
    """One batch of what was held: a source, its first target, and how many contexts each target from there on has, with these."""
    tops, lows, counts, picked = zip(*held, strict=True)
    source = np.repeat(tops, [len(c) for c in counts])
    target = np.concatenate([np.arange(low, low + len(c)) for low, c in zip(lows, counts, strict=True)])
    counts, picked = np.concatenate(counts), np.concatenate(picked)
    some = np.flatnonzero(counts)
    offsets = np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)
    contexts = pa.ListArray.from_arrays(pa.array(offsets), ids[2].take(pa.array(picked)))
    if separator is not None:
        contexts = pc.binary_join(contexts, separator)
    return pa.RecordBatch.from_arrays([ids[0].take(pa.array(source[some])), ids[1].take(pa.array(target[some])), contexts], ["source", "target", "contexts"])


def value_edges_in_context(nodes: DataFrame, transactions: DataFrame, bucket_us: int = 1_000_000, separator: str | None = None) -> DataFrame:
    """Candidate edges (source, target, contexts) from a value received to the same value sent on by the same service, with every inbound request that allows it.

    ``nodes`` has node, tx, direction (request, response), side (send, receive), service, value, start_us, end_us;
    ``transactions`` has tx, client, server, request_start_us, response_end_us. An edge needs a value that had arrived
    before it was sent. A response is sent in its own transaction; a request in any inbound one of the service that is open
    when it is sent. A value from a request must have come in that very transaction; one from a response must come from a
    call of the service that began inside it and ended before it did. Clients outside all services send no edges.

    A pair is made once, in one cell of its service's time; cells are as wide as a mean request, ``bucket_us`` at least.
    Where one end names the context, that is a join by value and cell. From a response to a request, the ends of a value in
    a cell are shuffled as two arrays to the array of the requests that are open in the cell, and a pair's contexts are
    picked there, so no row of a source, target and context is ever shuffled. Only if nodes or transactions repeat, pairs
    are grouped. Contexts are a sorted array, or with ``separator`` one text.
    """
    cell = lambda at, width: F.floor(at / F.lit(width))
    inbound = transactions.select("tx", F.col("server").alias("service"), F.col("request_start_us").cast("long").alias("from_us"), F.col("response_end_us").cast("long").alias("to_us")).where("tx is not null and from_us is not null and to_us is not null")
    width = max(bucket_us, int(inbound.agg(F.avg(F.greatest(F.col("to_us") - F.col("from_us"), F.lit(0)))).first()[0] or 0))
    # long values stand as digests, which are longer than those that stand for themselves
    key = F.when(F.length("value") <= 32, F.col("value")).otherwise(F.sha2("value", 256))
    end = lambda side, direction, node, at: nodes.where((F.col("side") == side) & (F.col("direction") == direction)).select("service", key.alias("key"), F.col("node").alias(node), F.col(at).cast("long").alias(f"{node}_at"), "tx").where(F.col("key").isNotNull() & F.col(f"{node}_at").isNotNull())
    own = end("receive", "request", "source", "end_us").join(inbound.hint("merge"), ["service", "tx"])
    calls = transactions.select("tx", F.col("client").alias("service"), F.col("request_start_us").cast("long").alias("call_at")).where("call_at is not null")
    called = end("receive", "response", "source", "end_us").join(calls.hint("merge"), ["service", "tx"]).drop("tx")
    asked = end("send", "request", "target", "start_us").select("service", "key", "target", "target_at", cell(F.col("target_at"), width).alias("cell"))
    answered = end("send", "response", "target", "start_us")
    spread = lambda df, lo, hi: df.withColumn("cell", F.explode(F.sequence(cell(lo, width), cell(hi, width))))
    least, most = (lambda *c: F.least(*map(F.col, c))), (lambda *c: F.greatest(*map(F.col, c)))
    again = lambda df, *names: not df.groupBy(*names).count().where("count > 1").isEmpty()
    repeated = again(transactions, "tx") or again(nodes, "side", "node")
    between = None if repeated else separator
    one = (F.array("tx") if between is None else F.col("tx").cast("string")).alias("contexts")

    passed_on = spread(own.withColumn("lo", most("source_at", "from_us")).where("lo <= to_us"), F.col("lo"), F.col("to_us"))
    passed_on = passed_on.join(asked.hint("merge"), ["service", "key", "cell"]).where("target_at between lo and to_us").select("source", "target", one)
    replied = own.select("service", "tx", "key", "source", "source_at").join(answered.hint("merge"), ["service", "tx", "key"]).where("source_at <= target_at").select("source", "target", one)
    # a call may end before it began: both spans are taken from their lesser to their greater time, and meet where the later one starts
    within = spread(called.withColumn("a", least("call_at", "source_at")), F.col("a"), F.col("call_at"))
    holding = answered.join(inbound.hint("merge"), ["service", "tx"]).withColumn("b", least("from_us", "to_us"))
    holding = spread(holding, F.col("b"), most("from_us", "to_us"))
    returned = within.join(holding.hint("merge"), ["service", "key", "cell"]).where((F.col("cell") == cell(most("a", "b"), width)) & F.expr("from_us <= call_at and source_at <= to_us and source_at <= target_at")).select("source", "target", one)

    open_at = inbound.where("from_us <= to_us")
    event = lambda df, at, kind, *c: df.select("service", F.col(at).alias("at"), F.lit(kind).alias("kind"), *c)
    begun = event(open_at, "from_us", 0, "to_us").unionByName(event(called, "call_at", 1, "key", "source", "source_at"), allowMissingColumns=True)
    # how long any request that was open when the call began stays open
    reaching = running(begun, ["service"], ["at", "kind"], maxes={"reach": F.col("to_us")}).where("kind = 1 and source_at <= reach")
    sources = spread(reaching, F.col("source_at"), F.col("reach")).groupBy("service", "cell", "key").agg(F.collect_list(F.struct("source", "source_at", F.col("at").alias("call_at"))).alias("sources"))
    targets = asked.groupBy("service", "cell", "key").agg(F.collect_list(F.struct("target", "target_at")).alias("targets"))
    around = spread(open_at, F.col("from_us"), F.col("to_us")).groupBy("service", "cell").agg(F.sort_array(F.collect_list(F.struct("tx", "from_us", "to_us"))).alias("around"))
    ends = materialize(sources.join(targets.hint("merge"), ["service", "cell", "key"]), "ends")
    # few bytes become many pairs, so tasks follow the pairs and not the bytes
    compared = ends.agg(F.sum(F.size("sources").cast("long") * F.size("targets"))).first()[0] or 0
    parts = max(1, min(MOST_PIECES, -(-compared // PIECE_ROWS)))
    met = ends.repartition(parts, "service", "cell").hint("merge").join(around.repartition(parts, "service", "cell"), ["service", "cell"])
    kind = ArrayType(transactions.schema["tx"].dataType) if between is None else StringType()
    schema = StructType([StructField(n, t) for n, t in (("source", nodes.schema["node"].dataType), ("target", nodes.schema["node"].dataType), ("contexts", kind))])
    sent_on = met.select("sources", "targets", "around").mapInArrow(lambda batches: _open_throughout(batches, between), schema)

    edges = passed_on.unionByName(replied).unionByName(returned).unionByName(sent_on)
    if not repeated:
        return edges
    whole = F.array_sort(F.array_distinct(F.flatten(F.collect_list("contexts"))))
    return edges.groupBy("source", "target").agg((whole if separator is None else F.array_join(whole.cast("array<string>"), separator)).alias("contexts"))
