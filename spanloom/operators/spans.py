"""Checks of span trees. Spans have trace, span, parent, service, kind, path, start_us, duration_us, status, error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import climb, reach

#: Expected edges are told to every trace, so there must not be more of them than this.
MOST_EXPECTED = 10_000


def span_structure(spans: DataFrame, id_form: str | None = None) -> DataFrame:
    """Broken rules by trace: missing_parent, no_root, many_roots (unexpected ones), missing_service, bad_duration, invalid_id, cycle, conflicting_parents.

    Equal rows are one span that was delivered more than once.

    ``id_form`` is a pattern that span ids must match, for instance ``^(?!0{16})[0-9a-f]{16}$``.
    """
    known = spans.select("trace", F.col("span").alias("parent")).distinct().withColumn("known", F.lit(True))
    rows = spans.distinct().join(known, ["trace", "parent"], "left")
    bad_id = F.col("span").isNull() if id_form is None else ~F.coalesce(F.col("span").cast("string").rlike(id_form), F.lit(False))
    flags = rows.groupBy("trace").agg(
        F.count_if(F.col("parent").isNotNull() & F.col("known").isNull()).alias("missing_parent"), F.count_if(F.col("parent").isNull()).alias("roots"),
        F.count_if(F.col("service").isNull()).alias("missing_service"), F.count_if(F.col("duration_us").isNull() | (F.col("duration_us") < 0)).alias("bad_duration"), F.count_if(bad_id).alias("invalid_id"),
    )
    rule = lambda broken, name: F.when(broken, F.lit(name))
    rules = F.array_compact(F.array(*[rule(F.col(c) > 0, c) for c in ("missing_parent", "missing_service", "bad_duration", "invalid_id")], rule(F.col("roots") == 0, "no_root"), rule(F.col("roots") > 1, "many_roots")))
    ends = climb(spans.select("trace", F.col("span").alias("node"), "parent"), ["trace"]).where("status in ('cycle', 'many_parents')").select("trace", "status").distinct()
    return flags.select("trace", F.explode(rules).alias("rule")).unionByName(ends.select("trace", F.when(F.col("status") == "cycle", "cycle").otherwise("conflicting_parents").alias("rule")))


def trace_status(spans: DataFrame, violations: DataFrame) -> DataFrame:
    """Every trace with ``status`` passed or incomplete."""
    broken = violations.select("trace").distinct().withColumn("broken", F.lit(True))
    return spans.select("trace").distinct().join(broken, "trace", "left").select("trace", F.when(F.col("broken"), "incomplete").otherwise("passed").alias("status"))


def unreachable_spans(spans: DataFrame) -> DataFrame:
    """Spans that no root reaches: behind a missing parent or on a cycle."""
    edges = spans.where("parent is not null").select("trace", "parent", F.col("span").alias("child"))
    seen = reach(edges, spans.where("parent is null").select("trace", F.col("span").alias("node")), ["trace"])
    return spans.join(seen.select("trace", F.col("node").alias("span")), ["trace", "span"], "left_anti").select("trace", "span")


def service_edges(spans: DataFrame) -> DataFrame:
    """Distinct (trace, from_service, to_service) of parents and children in different services."""
    up = spans.select("trace", F.col("span").alias("parent"), F.col("service").alias("from_service"))
    return spans.join(up, ["trace", "parent"]).where("from_service != service").select("trace", "from_service", F.col("service").alias("to_service")).distinct()


def missing_edges(edges: DataFrame, expected: DataFrame, traces: DataFrame) -> DataFrame:
    """Expected (from_service, to_service) that a trace lacks; more than ``MOST_EXPECTED`` of them are refused."""
    wanted = expected.select("from_service", "to_service").distinct().limit(MOST_EXPECTED + 1).collect()
    if len(wanted) > MOST_EXPECTED:
        raise ValueError("too many expected edges")
    edge = lambda a, b: F.struct(a.alias("from_service"), b.alias("to_service"))
    kind = expected.schema["from_service"].dataType, expected.schema["to_service"].dataType
    every = F.array(*[edge(F.lit(r[0]).cast(kind[0]), F.lit(r[1]).cast(kind[1])) for r in wanted])
    if not wanted:
        return traces.select("trace", *[F.lit(None).cast(k).alias(c) for k, c in zip(kind, ("from_service", "to_service"), strict=True)]).limit(0)
    # a trace holds no more of the expected edges than there are
    seen = edges.join(F.broadcast(expected.select("from_service", "to_service").distinct()), ["from_service", "to_service"]).groupBy("trace").agg(F.collect_set(edge(F.col("from_service"), F.col("to_service"))).alias("seen"))
    lacks = traces.select("trace").distinct().join(seen, "trace", "left").select("trace", F.explode(F.filter(every, lambda e: ~F.coalesce(F.array_contains("seen", e), F.lit(False)))).alias("e"))
    return lacks.select("trace", "e.from_service", "e.to_service")


def missing_endpoints(spans: DataFrame, required: DataFrame) -> DataFrame:
    """Required (trace, service, path) not seen as a server."""
    return required.join(spans.where("kind = 'SERVER'"), ["trace", "service", "path"], "left_anti")


def producer_consumer_links(spans: DataFrame, sender: str | None = None) -> DataFrame:
    """Consumers with whether some ancestor is a producer, of the sending service if one is named."""
    producers = spans.where("kind = 'PRODUCER'" + ("" if sender is None else f" and service = '{sender}'"))
    above = climb(spans.select("trace", F.col("span").alias("node"), "parent"), ["trace"], marks=producers.select("trace", F.col("span").alias("node"), F.lit("p").alias("mark")))
    linked = above.where("lo is not null").select("trace", F.col("node").alias("span"), F.lit(True).alias("linked"))
    return spans.where("kind = 'CONSUMER'").join(linked, ["trace", "span"], "left").select("trace", "span", F.coalesce("linked", F.lit(False)).alias("linked"))


def runtime_errors(spans: DataFrame) -> DataFrame:
    """Spans with an error tag (even an empty one), an ``otel_status`` of ERROR if there is that column, or a status of 400 and more, with the reasons."""
    otel = F.when(F.col("otel_status") == "ERROR", F.lit("otel_error")) if "otel_status" in spans.columns else F.lit(None).cast("string")
    reasons = F.array_compact(F.array(F.when(F.col("error").isNotNull(), F.lit("error_tag")), otel, F.when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status").cast("string")))))
    return spans.select("trace", "span", reasons.alias("reasons")).where(F.size("reasons") > 0)


def nearest_observed_parent(spans: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept spans (trace, span) with their closest kept ancestor: trace, child, parent."""
    nodes = kept.select("trace", F.col("span").alias("node"))
    above = climb(spans.select("trace", F.col("span").alias("node"), "parent"), ["trace"], stops=nodes).where("status = 'stop'")
    return above.join(nodes, ["trace", "node"], "left_semi").select("trace", F.col("node").alias("child"), F.col("top").alias("parent"))


def edge_relations(links: DataFrame, spans: DataFrame) -> DataFrame:
    """Links (trace, child, parent) with ``relation``: local, transport, endpoints_differ or unexpected.

    A server's client in the same service is local; a client's server is transport if it has the client's peer as its
    service and the same method and path. ``spans`` has trace, span, kind, service, peer, method, path.
    """
    columns = ("kind", "service", "peer", "method", "path")
    end = lambda side: spans.select("trace", F.col("span").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    both = links.join(end("parent"), ["trace", "parent"]).join(end("child"), ["trace", "child"])
    same = F.expr("parent_peer <=> child_service and parent_method <=> child_method and parent_path <=> child_path")
    relation = F.when(F.expr("parent_kind = 'SERVER' and child_kind = 'CLIENT' and parent_service = child_service"), "local").when(F.expr("parent_kind = 'CLIENT' and child_kind = 'SERVER'"), F.when(same, "transport").otherwise("endpoints_differ")).otherwise("unexpected")
    return both.select("trace", "child", "parent", relation.alias("relation"))


def rooted_tree_gate(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Traces whose nodes aren't one tree below the root: nodes (trace, node), edges (trace, parent, child), roots (trace, node)."""
    seen = reach(edges, roots, ["trace"]).groupBy("trace").agg(F.count("*").alias("reached"))
    n, m = nodes.groupBy("trace").agg(F.count("*").alias("n")), edges.groupBy("trace").agg(F.count("*").alias("m"))
    joined = n.join(m, "trace", "left").join(seen, "trace", "left").na.fill(0, ["m", "reached"])
    return joined.where("reached != n or m != n - 1").select("trace", "n", "m", "reached")
