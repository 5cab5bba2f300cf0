"""Byte ranges with whole mappings and with holes."""

from spanloom.operators.graph import ancestors, byte_ranges, climb, root_of
from spanloom.operators.spans import nearest_observed_parent, producer_consumer_links, span_structure, trace_status


def test_byte_ranges_complete(spark):
    maps = [
        ("whole", 2, 1, 0, 60, 0), ("whole", 2, 1, 60, 100, 60), ("whole", 1, 0, 0, 100, 5),
        ("hole", 2, 1, 0, 100, 0), ("hole", 1, 0, 10, 100, 10),  # bytes 0 to 9 are lost at the second step
        ("lost", 2, 1, 0, 100, 0), ("lost", 1, 0, 100, 200, 0),  # no byte reaches a source
        ("unused", 2, 1, 0, 50, 10), ("unused", 2, 1, 50, 100, 60), ("unused", 1, 0, 10, 110, 0),  # only the bytes asked for count
    ]
    mappings = spark.createDataFrame(maps, "g string, child long, parent long, out_start long, out_end long, parent_start long")
    sinks = spark.createDataFrame([(g, 2, 100) for g in ("whole", "hole", "lost", "unused", "source")], "g string, node long, length long")
    got = {tuple(r) for r in byte_ranges(mappings, sinks, ["g"]).collect()}
    assert got == {("whole", 2, 0, 5, 105, True), ("hole", 2, 0, 10, 100, False), ("lost", 2, None, None, None, False), ("unused", 2, 0, 0, 100, True), ("source", 2, 2, 0, 100, True)}


EDGES = [("ok", 0, None), ("ok", 1, 0), ("ok", 2, 1), ("ok", 3, 1), ("loop", 0, None), ("loop", 1, 2), ("loop", 2, 1), ("loop", 3, 2), ("lost", 1, 9), ("lost", 2, 1), ("self", 5, 5)]


def test_cycles_keep_to_themselves(spark):
    edges = spark.createDataFrame(EDGES, "g string, node long, parent long")
    rows = {tuple(r) for r in ancestors(edges, ["g"]).collect()}
    assert rows == {("ok", 1, 0, 1), ("ok", 2, 1, 1), ("ok", 3, 1, 1), ("ok", 2, 0, 2), ("ok", 3, 0, 2), ("loop", 1, None, None), ("loop", 2, None, None), ("loop", 3, None, None), ("lost", 1, 9, 1), ("lost", 2, 1, 1), ("lost", 2, 9, 2), ("self", 5, None, None)}
    roots = {(r.g, r.node): (r.root, r.status) for r in root_of(edges, ["g"]).collect()}
    assert roots[("ok", 3)] == (0, "root") and roots[("loop", 3)] == (None, "cycle") and roots[("lost", 2)] == (9, "missing_parent") and roots[("ok", 0)] == (0, "root")


def test_climb_stops_and_marks(spark):
    chain = spark.createDataFrame([(0, k, k - 1 if k else None) for k in range(40)], "g int, node long, parent long")
    stops = chain.where("node in (7, 20)").select("g", "node")
    marks = spark.createDataFrame([(0, 3, "b"), (0, 25, "a"), (0, 25, "c")], "g int, node long, mark string")
    got = {r.node: r for r in climb(chain, ["g"], stops, marks).collect()}
    for k in range(1, 40):
        top = max([s for s in (7, 20) if s < k], default=0)
        over = [m for n, m in ((3, "b"), (25, "a"), (25, "c")) if top <= n < k]
        assert (got[k].top, got[k].distance, got[k].lo, got[k].hi) == (top, k - top, min(over, default=None), max(over, default=None))
        assert got[k].status == ("stop" if top else "root")


def test_span_trees(spark):
    rows = [(t, n, p, "s" if n != 3 else "q", "PRODUCER" if n == 1 else "CONSUMER" if n == 3 else "SERVER", 1) for t, n, p in EDGES]
    spans = spark.createDataFrame(rows, "trace string, span long, parent long, service string, kind string, duration_us long")
    broken = span_structure(spans)
    assert {tuple(r) for r in broken.collect()} == {("loop", "cycle"), ("lost", "missing_parent"), ("lost", "no_root"), ("self", "cycle"), ("self", "no_root")}
    assert {tuple(r) for r in trace_status(spans, broken).collect()} == {("ok", "passed"), ("loop", "incomplete"), ("lost", "incomplete"), ("self", "incomplete")}
    assert {tuple(r) for r in producer_consumer_links(spans, "s").where("trace = 'ok'").collect()} == {("ok", 3, True)}
    assert not producer_consumer_links(spans, "other").where("linked").count()
    kept = spans.where("span in (0, 3)").select("trace", "span")
    assert {tuple(r) for r in nearest_observed_parent(spans, kept).collect()} == {("ok", 3, 0)}
