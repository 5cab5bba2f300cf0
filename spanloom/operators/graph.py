"""Lineage graphs: closures, ancestors, origins with taint, byte ranges, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .components import connected_components


def _closure(edges: DataFrame, seeds: DataFrame, by: list[str], at: str, to: str) -> DataFrame:
    """Nodes reached from the seeds (by, root, node) along at -> to, in rounds; each round joins the frontier and drops what was seen, so cycles end.

    Both sides of a round's joins are shuffled: written rows compress so well that Spark takes millions for a table to broadcast.
    """
    step = materialize(edges.select(*by, F.col(at).alias("node"), F.col(to).alias("next")).distinct(), "steps")
    seen = materialize(seeds.select(*by, "root", "node").distinct(), "seen")
    frontier, rounds = seen, 0
    while True:
        new = frontier.join(step.hint("merge"), [*by, "node"]).select(*by, "root", F.col("next").alias("node")).distinct().join(seen.hint("merge"), [*by, "root", "node"], "left_anti")
        frontier = materialize(new, "frontier")
        if frontier.isEmpty():
            return seen
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % 16 == 0:  # one table again, so that plans don't grow with the depth
            seen = materialize(seen, "seen")


def backward_slice(edges: DataFrame, sinks: DataFrame, by: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Nodes from which a sink (by, node) is reached over edges (source, target, kind) of the allowed kinds: by, root (the sink), node."""
    used = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    return _closure(used, sinks.withColumn("root", F.col("node")), by, "target", "source")


def reach(edges: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """Nodes reached from each root (by, node) over edges (parent, child): by, root, node."""
    return _closure(edges, roots.withColumn("root", F.col("node")), by, "parent", "child")


def used_edges(edges: DataFrame, reached: DataFrame, by: list[str]) -> DataFrame:
    """The edges (parent, child) that a closure (by, root, node) ran along, by root."""
    return edges.join(reached.withColumnRenamed("node", "parent"), [*by, "parent"]).select(*by, "root", "parent", "child").distinct()


def slice_report(nodes: DataFrame, sliced: DataFrame, by: list[str]) -> DataFrame:
    """Source nodes with whether they contribute to each sink."""
    roots = sliced.select(*by, "root").distinct()
    hit = sliced.withColumn("contributes", F.lit(True))
    return nodes.where("kind = 'source'").join(roots, by).join(hit, [*by, "root", "node"], "left").select(*by, "root", "node", F.coalesce("contributes", F.lit(False)).alias("contributes"))


def induced_edges(edges: DataFrame, sliced: DataFrame, by: list[str]) -> DataFrame:
    """The edges (source, target) both of whose ends are in a slice (by, root, node), by root."""
    ends = sliced.select(*by, "root", F.col("node").alias("source"))
    inside = edges.join(ends, [*by, "source"])
    return inside.join(sliced.select(*by, "root", F.col("node").alias("target")), [*by, "root", "target"]).select(*by, "root", "source", "target").distinct()


def climb(edges: DataFrame, by: list[str], stops: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """For each node with a parent, where its chain of parents ends: by, node, top, distance, lo, hi, status.

    ``edges`` has by, node, parent; repeated rows count once. A chain ends at the first of ``stops`` (by, node) above the
    node, or at the last parent. ``status`` is stop, root, missing_parent (the last parent is no node itself), cycle or
    many_parents (the node, or one above it before any stop, has different parents); for the last two top and the rest are null.
    ``lo`` and ``hi`` are the least and greatest of ``marks`` (by, node, mark) above the node, the top's included.

    Pointers double: a round is one join of as many rows as there are nodes, and there are as many rounds as the longest
    chain's length has bits. What is still open after as many as the largest group's size has is on or below a cycle.
    """
    nodes = materialize(edges.groupBy(*by, "node").agg(F.min("parent").alias("parent"), F.expr("count(distinct parent) + cast(bool_or(parent is null) as int)").alias("parents")), "nodes")
    rows = nodes.where("parents = 1 and parent is not null").select(*by, "node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("distance"))
    own = nodes.select(*by, F.col("node").alias("at"), F.when(F.col("parents") > 1, "many_parents").when(F.col("parent").isNull(), "root").otherwise("inner").alias("is"))
    rows = rows.join(own, [*by, "at"], "left")
    if stops is not None:
        rows = rows.join(stops.select(*by, F.col("node").alias("at"), F.lit(True).alias("stop")).distinct(), [*by, "at"], "left")
    else:
        rows = rows.withColumn("stop", F.lit(None).cast("boolean"))
    if marks is not None:
        rows = rows.join(marks.groupBy(*by, F.col("node").alias("at")).agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")), [*by, "at"], "left")
    else:
        rows = rows.withColumns({"lo": F.lit(None).cast("string"), "hi": F.lit(None).cast("string")})
    status = F.when(F.col("stop"), "stop").when(F.col("is").isNull(), "missing_parent").when(F.col("is") != "inner", F.col("is"))
    state = materialize(rows.select(*by, "node", "at", "distance", "lo", "hi", status.alias("status")), "climb")
    largest = nodes.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(largest).bit_length() + 1):
        if state.where("status is null").isEmpty():
            break
        far = state.select(*by, F.col("node").alias("at"), F.col("at").alias("at2"), F.col("distance").alias("distance2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("status").alias("status2"))
        jumped = state.where("status is null").join(far, [*by, "at"]).select(*by, "node", F.col("at2").alias("at"), (F.col("distance") + F.col("distance2")).alias("distance"), F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"), F.col("status2").alias("status"))
        state = materialize(state.where("status is not null").unionByName(jumped), "climb")
    ended = F.coalesce(F.col("status") != "many_parents", F.lit(False))
    values = (("at", "top"), ("distance", "distance"), ("lo", "lo"), ("hi", "hi"))
    out = state.select(*by, "node", *[F.when(ended, F.col(c)).alias(n) for c, n in values], F.coalesce("status", F.lit("cycle")).alias("status"))
    torn = nodes.where("parents > 1").select(*by, "node", *[F.lit(None).cast(state.schema[c].dataType).alias(n) for c, n in values], F.lit("many_parents").alias("status"))
    return out.unionByName(torn)


def root_of(edges: DataFrame, by: list[str], stops: DataFrame | None = None) -> DataFrame:
    """Each node's root, or its nearest ancestor among ``stops``: by, node, root, distance, status; nodes without parent are their own root."""
    alone = edges.groupBy(*by, "node").agg(F.max("parent").alias("parent")).where("parent is null")
    heads = alone.select(*by, "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("distance"), F.lit("root").alias("status"))
    return climb(edges, by, stops).select(*by, "node", F.col("top").alias("root"), "distance", "status").unionByName(heads)


def ancestors(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, ancestor, distance) over edges (node, parent), by doubling: each round joins paths to paths.

    Repeated edges count once. Nodes on or below a cycle, or with different parents themselves or above them, have one row
    with null ancestor and distance; other groups and chains keep their answers.
    """
    edges = materialize(edges.select(*by, "node", "parent").distinct(), "parents")
    torn = not edges.groupBy(*by, "node").count().where("count > 1").isEmpty()
    paths = materialize(edges.where("parent is not null").select(*by, "node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")), "paths")
    new, longest = paths, 1
    while not new.isEmpty():
        if torn or not new.where("node = ancestor").isEmpty():
            broken = materialize(climb(edges, by).where("status in ('cycle', 'many_parents')").select(*by, "node"), "broken")
            sound = ancestors(edges.join(broken, [*by, "node"], "left_anti"), by)
            kind = paths.schema["ancestor"].dataType
            return sound.unionByName(broken.select(*by, "node", F.lit(None).cast(kind).alias("ancestor"), F.lit(None).cast("long").alias("distance")))
        far = paths.where(F.col("distance") == longest).select(*by, F.col("node").alias("mid0"), F.col("ancestor").alias("mid"))
        tail = paths.select(*by, F.col("node").alias("mid"), "ancestor", "distance")
        new = materialize(far.join(tail.hint("merge"), [*by, "mid"]).select(*by, F.col("mid0").alias("node"), "ancestor", (F.col("distance") + longest).alias("distance")), "paths")
        paths = paths.unionByName(new)
        longest *= 2
    return paths


def endless(links: DataFrame, by: list[str]) -> DataFrame:
    """Nodes (by, node) from which links (by, node, next) run into a cycle: nodes without a further link are trimmed until none is left to trim."""
    left = materialize(links.select(*by, "node", "next").distinct(), "links")
    while True:
        heads = left.select(*by, F.col("node").alias("next")).distinct()
        kept = materialize(left.join(heads, [*by, "next"], "left_semi").select(*by, "node", "next"), "links")
        if kept.count() == left.count():
            return kept.select(*by, "node").distinct()
        left = kept


def origins(edges: DataFrame, nodes: DataFrame, targets: DataFrame, by: list[str], asked: bool = False) -> DataFrame:
    """(by, root, sources, known, status): the boundary and leaf nodes from which a target comes.

    ``nodes`` has by, node, kind (boundary, unknown, unbound, other). Boundary and unknown nodes end the walk; one unknown
    node anywhere makes the whole answer unknown, an empty set of sources is still an answer. A leaf is a source; an unbound
    one makes the answer unknown, and so does any leaf that is no boundary if boundaries were ``asked`` for. ``status`` is
    known, unknown, or cycle where a target comes from itself or from a node that does: that is no answer, and sources are null.
    """
    stops = nodes.where("kind in ('boundary', 'unknown')").select(*by, F.col("node").alias("target")).distinct()
    open_edges = materialize(edges.select(*by, "source", "target").join(stops, [*by, "target"], "left_anti").distinct(), "open")
    walked = materialize(_closure(open_edges, targets.withColumn("root", F.col("node")), by, "target", "source"), "walked")
    met = walked.select(*by, F.col("node").alias("target")).distinct()
    cyclic = endless(open_edges.join(met, [*by, "target"], "left_semi").select(*by, F.col("target").alias("node"), F.col("source").alias("next")), by).withColumn("cyclic", F.lit(True))
    inner = open_edges.select(*by, F.col("target").alias("node")).distinct().withColumn("inner", F.lit(True))
    ends = walked.join(inner, [*by, "node"], "left").join(nodes.select(*by, "node", "kind").distinct(), [*by, "node"], "left").join(cyclic, [*by, "node"], "left")
    leaf = F.col("inner").isNull()
    source = F.when((F.col("kind") == "boundary") | (leaf & (F.col("kind") != "unknown")), F.col("node"))
    doubt = F.col("kind").isNull() | (F.col("kind") == "unknown") | (leaf & (F.col("kind") == "unbound"))
    if asked:
        doubt = doubt | (leaf & (F.col("kind") != "boundary"))
    sums = ends.groupBy(*by, "root").agg(F.array_sort(F.collect_set(source)).alias("sources"), (F.count_if(doubt) == 0).alias("known"), F.coalesce(F.bool_or("cyclic"), F.lit(False)).alias("cyclic"))
    return sums.select(*by, "root", F.when(~F.col("cyclic"), F.col("sources")).alias("sources"), (F.col("known") & ~F.col("cyclic")).alias("known"), F.when(F.col("cyclic"), "cycle").when(F.col("known"), "known").otherwise("unknown").alias("status"))


def byte_ranges(mappings: DataFrame, sinks: DataFrame, by: list[str]) -> DataFrame:
    """Source byte ranges behind each sink (by, node, length): by, root, source, start, end, and ``complete``.

    Mappings (child, parent, out_start, out_end, parent_start) carry half-open ranges of a child to its parent; ranges are
    clipped and shifted level by level, and touching ranges of one source are merged. ``complete`` is false for all rows of
    a sink where, at any step, the mapped bytes of a range don't add up to its length; if no range is left, the sink has
    one row with null source, start and end. There are as many rounds as the longest chain; ranges that run in a cycle, which
    outlast as many rounds as their group has children, make their sinks incomplete.
    """
    maps = mappings.select(*by, F.col("child").alias("node"), "parent", "out_start", "out_end", "parent_start")
    inner = maps.select(*by, "node").distinct().withColumn("inner", F.lit(True))
    now = materialize(sinks.select(*by, F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("end")), "ranges")
    most = maps.select(*by, "node").distinct().groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    done, holes = [], []
    for _ in range(most + 1):
        marked = now.join(inner, [*by, "node"], "left")
        done.append(marked.where("inner is null").drop("inner"))
        stepped = marked.where("inner").join(maps, [*by, "node"])
        a, b = F.greatest("start", "out_start"), F.least("end", "out_end")
        covered = stepped.groupBy(*by, "root", "node", "start", "end").agg(F.sum(F.greatest(b - a, F.lit(0))).alias("covered"))
        holes.append(covered.where(F.col("covered") != F.col("end") - F.col("start")).select(*by, "root"))
        now = materialize(stepped.where(a < b).select(*by, "root", F.col("parent").alias("node"), (a - F.col("out_start") + F.col("parent_start")).alias("start"), (b - F.col("out_start") + F.col("parent_start")).alias("end")).distinct(), "ranges")
        if now.isEmpty():
            break
    else:
        holes.append(now.select(*by, "root"))
        done.append(done[0].limit(0))
    rows, broken = done[0], holes[0]
    for more, hole in zip(done[1:], holes[1:], strict=True):
        rows, broken = rows.unionByName(more), broken.unionByName(hole)
    w = Window.partitionBy(*by, "root", "node").orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = rows.distinct().withColumn("new", fresh.cast("int")).withColumn("island", F.sum("new").over(w))
    ranges = islands.groupBy(*by, "root", F.col("node").alias("source"), "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    broken = broken.distinct().withColumn("hole", F.lit(True))
    return ranges.join(broken, [*by, "root"], "full_outer").select(*by, "root", "source", "start", "end", F.col("hole").isNull().alias("complete"))


def cohort_attribution(links: DataFrame, records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records (record, id) with the one request (request, id) of their component over links (a, b); two make a violation, none is global."""
    ids = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = connected_components(ids)
    part_of = lambda df: df.join(parts, df["id"] == parts["node"], "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    owners = part_of(requests).groupBy("component").agg(F.count_distinct("request").alias("n"), F.min("request").alias("request"))
    joined = part_of(records).join(owners, "component", "left")
    return joined.select("record", F.when(F.col("n") == 1, F.col("request")).alias("request"), F.when(F.col("n").isNull(), "global").when(F.col("n") == 1, "request").otherwise("violation").alias("status"))


def observation_closure(observations: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Sites (site, fact) with ``action`` keep or drop, ``reason`` and ``relevant`` (their needed facts).

    A fact is needed if a target depends on it over rules (fact, dependency); all producers of a needed fact stay.
    """
    needed = needed_facts(rules, targets).withColumn("needed", F.lit(True))
    sites = observations.join(needed, "fact", "left").groupBy("site").agg(F.array_sort(F.collect_set(F.when(F.col("needed"), F.col("fact")))).alias("relevant"))
    keep = F.size("relevant") > 0
    return sites.select("site", F.when(keep, "keep").otherwise("drop").alias("action"), F.when(keep, "producer of a needed fact").otherwise("no fact of it is needed").alias("reason"), "relevant")


def needed_facts(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts that the targets (fact) depend on, themselves included."""
    edges = rules.select(F.lit(0).alias("g"), F.col("dependency").alias("source"), F.col("fact").alias("target"))
    return backward_slice(edges, targets.select(F.lit(0).alias("g"), F.col("fact").alias("node")), ["g"]).select(F.col("node").alias("fact")).distinct()


def closure_violations(observations: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(fact, rule) of a model that gives no answer: observed_and_derived, missing (needed, but neither), cycle (needed, and depends on itself)."""
    needed = materialize(needed_facts(rules, targets), "needed")
    seen, derived = observations.select("fact").distinct(), rules.select("fact").distinct()
    both = seen.join(derived, "fact", "left_semi").select("fact", F.lit("observed_and_derived").alias("rule"))
    missing = needed.join(seen, "fact", "left_anti").join(derived, "fact", "left_anti").select("fact", F.lit("missing").alias("rule"))
    links = rules.join(needed, "fact", "left_semi").select(F.lit(0).alias("g"), F.col("fact").alias("node"), F.col("dependency").alias("next"))
    return both.unionByName(missing).unionByName(endless(links, ["g"]).select(F.col("node").alias("fact"), F.lit("cycle").alias("rule")))
