"""Operators whose groups may be of any size, against brute force, with bounds so small that every piece is met."""

import itertools
import math
import random
import statistics
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import project
from spanloom.operators import cost, evidence, gates, graph, joins, ranges
from spanloom.plans import lineage_queries, queries  # noqa: F401  the queries register themselves together
from tests.test_matching import brute


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(ranges, "GROUP_ROWS", 3)
    monkeypatch.setattr(ranges, "PIECE_ROWS", 20)


def test_running(spark, small):
    rng = random.Random(1)
    rows = [(g, k, rng.randrange(-3, 4), rng.choice([None, "a", "b", "c"])) for g in (None, 1, 2) for k in range(1 if g == 2 else 90)]
    got = ranges.running(spark.createDataFrame(rows, "g int, k int, n int, v string").repartition(4), ["g"], ["k"], {"s": F.col("n")}, {"l": F.col("v")})
    want, total, last = {}, defaultdict(int), {}
    for g, k, n, v in rows:
        total[g] += n
        last[g] = v or last.get(g)
        want[g, k] = (n, v, total[g], last[g])
    assert {(r.g, r.k): (r.n, r.v, r.s, r.l) for r in got.collect()} == want


def test_greedy_rounds(spark):
    """Rounds of local minima settle what going cost by cost does; ties, repeated pairs and long chains included."""
    rng = random.Random(2)
    for n, costs in ((1, 1), (60, 3), (250, 6), (250, 1000)):
        pairs = sorted({(rng.randrange(40), rng.randrange(40), rng.randrange(costs)) for _ in range(n)})
        df = spark.createDataFrame([(c, s, s % 2, "p", k) for c, s, k in pairs], "client long, server long, service int, path string, cost long")
        # one service a server: clients of both are different ends
        want = set().union(*[brute([p for p in pairs if p[1] % 2 == half]) for half in (0, 1)])
        for together in (0, 20):
            got = joins.greedy_match(df, together=together).collect()
            assert {(r.client, r.server, r.cost, r.tied) for r in got} == want and len(got) == len(want)
    chain = [(k // 2, (k + 1) // 2, 0, "p", k) for k in range(24)] + [(None, 1, 0, "p", 1), (1, 1, 0, "p", None)]
    got = joins.greedy_match(spark.createDataFrame(chain, "client long, server long, service int, path string, cost long"), together=0)
    assert {(r.client, r.server, r.tied) for r in got.collect()} == {(k, k, False) for k in range(12)}
    twice = spark.createDataFrame([(1, 1, 0, "p", 5)] * 2, "client long, server long, service int, path string, cost long")
    assert [r.tied for r in joins.greedy_match(twice, together=0).collect()] == [True, True]


def test_frames_in_ranges(spark, small):
    rng = random.Random(3)
    rows, want = [], set()
    for thread in ("a", "b"):
        stack, depth = [], 0
        for seq in range(150):
            if stack and rng.random() < 0.5:
                enter, at = stack.pop()
                want.add((thread, enter, seq, at, stack[-1][0] if stack else None))
                rows.append((thread, seq, "out"))
            elif rng.random() < 0.8:
                stack.append((seq, len(stack) + 1))
                rows.append((thread, seq, "in"))
            else:
                rows.append((thread, seq, "other"))
        want |= {(thread, enter, None, at, stack[at - 2][0] if at > 1 else None) for enter, at in stack}
    df = spark.createDataFrame(rows, "thread string, seq int, op string").repartition(3)
    got = gates.nesting_frames(df, ["thread"], "seq", F.col("op") == "in", F.col("op") == "out")
    assert {(r.thread, r.enter_seq, r.exit_seq, r.depth, r.parent_seq) for r in got.collect()} == want
    balance = {t: sum((o == "in") - (o == "out") for x, _, o in rows if x == t) for t in "ab"}
    assert {(r.thread, r.detail.split("/")[1]) for r in gates.nesting_gate(df, ["thread"], "seq", F.col("op") == "in", F.col("op") == "out").collect()} == {(t, str(b)) for t, b in balance.items() if b}


def test_ranks_in_ranges(spark, small):
    rng = random.Random(4)
    values = {g: [rng.randrange(60) for _ in range(n)] for g, n in ((None, 70), (1, 200), (2, 1))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [(1, None)], "g int, v int")
    rank = lambda vs, p: sorted(vs)[max(-(-len(vs) * p // 100), 1) - 1]
    got = cost.nearest_rank(df, ["g"], "v", [1, 50, 95, 100])
    assert {r.g: (r.p1, r.p50, r.p95, r.p100) for r in got.collect()} == {g: tuple(rank(vs, p) for p in (1, 50, 95, 100)) for g, vs in values.items()}
    everything = sum(values.values(), [])
    assert tuple(cost.nearest_rank(df, [], "v", [50]).first()) == (rank(everything, 50),)


def test_last_write_in_ranges(spark, small):
    rng = random.Random(5)
    rows = [("o", k, rng.choice(["read", "read", "write", "barrier", "abort"]), k * 10, rng.randrange(2)) for k in range(120)]
    want, last = {}, None
    for _, _, kind, event, version in rows:
        if kind == "read":
            want[event] = last[0] if last and last[1] and last[2] == version else None
        else:
            last = (event, kind == "write", version)
    got = joins.last_write_asof(spark.createDataFrame(rows, "o string, seq int, kind string, event int, version int"), ["o"], "seq", "kind", "event", "version")
    assert {r.event: r.source for r in got.collect()} == want


def test_buffer_origin(spark, small):
    rng = random.Random(6)
    reads = [("c", rng.randrange(60), k % 9, rng.randrange(40), rng.randrange(0, 14), rng.randrange(100)) for k in range(40)] + [("c", 70, 100, 1000, 5, 7), ("c", 71, 100, 1005, 5, 12), ("c", 72, 101, 2000, 10**9, 3)]
    reads = list({r[1]: r for r in reads}.values())
    uses = [("c", rng.randrange(75), k, rng.randrange(45), rng.randrange(1, 6)) for k in range(60)] + [("c", 80, 900, 1002, 6), ("c", 80, 901, 2500, 4), ("d", 80, 902, 1002, 6), ("c", 80, 903, 999, 3)]
    want = {}
    for c, seq, use, address, length in uses:
        places = set()
        for byte in range(address, address + length):
            over = [(s, op, offset + byte - a) for x, s, op, a, n, offset in reads if x == c and s < seq and a <= byte < a + n]
            places.add((max(over)[1], max(over)[2] - byte) if over else None)
        one = places.pop() if len(places) == 1 else None
        want[use] = (one[0], one[1] + address) if one else (None, None)
    got = evidence.buffer_origin(spark.createDataFrame(reads, "c string, seq int, op int, address long, length long, offset long"), spark.createDataFrame(uses, "c string, seq int, use int, address long, length long"), ["c"])
    assert {r.use: (r.op, r.origin) for r in got.collect()} == want
    assert want[900] == (100, 9) and want[901] == (101, 503) and want[902] == (None, None)


def test_conflicts_and_overlaps(spark):
    rng = random.Random(7)
    objects = [(k // 2, b := rng.randrange(300), b + rng.choice([1, 3, 40, 500]), a := rng.randrange(200), a + rng.choice([1, 8, 90])) for k in range(90)] + [(200, 0, 10**12, 50, 51), (201, 10, 11, 0, 10**12), (202, 5, 5, 0, 9)]
    want = {(min(x[0], y[0]), max(x[0], y[0])) for x in objects for y in objects if x[0] != y[0] and x[1] < x[2] and y[1] < y[2] and max(x[1], y[1]) < min(x[2], y[2]) and max(x[3], y[3]) < min(x[4], y[4])}
    got = joins.private_range_conflicts(spark.createDataFrame(objects, "request int, born long, died long, low long, high long"), 4, 4).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    spans = [(k % 2, k, s := rng.randrange(-50, 400), s + rng.choice([0, 1, 7, 100])) for k in range(120)] + [(0, 500, -5, 10**10), (0, 501, 3, 10**10)]
    got = joins.overlapping_pairs(spark.createDataFrame(spans, "g int, id int, s long, e long"), ["g"], "id", "s", "e", 2).collect()
    hits = {(x[0], x[1], y[1]) for x in spans for y in spans if x[0] == y[0] and x[1] < y[1] and max(x[2], y[2]) < min(x[3], y[3])}
    assert {tuple(r) for r in got} == hits and len(got) == len(hits)
    left, right = (spark.createDataFrame(part, f"g int, {n} int, {n}s long, {n}e long") for part, n in ((spans[::2], "l"), (spans[1::2], "r")))
    got = ranges.overlaps(left, right, ["g"], 2, ("ls", "le"), ("rs", "re")).collect()
    hits = {(x[1], y[1]) for x in spans[::2] for y in spans[1::2] if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3])}
    assert {(r.l, r.r) for r in got} == hits and len(got) == len(hits)
    got = ranges.containing(left, right, ["g"], 2, ("ls", "le"), ("rs", "re")).collect()
    hits = {(x[1], y[1]) for x in spans[::2] for y in spans[1::2] if x[0] == y[0] and y[2] <= x[2] and x[3] <= y[3]}
    assert {(r.l, r.r) for r in got} == hits and len(got) == len(hits)


def test_long_intervals_make_few_rows(spark):
    plan = joins.overlapping_pairs(spark.createDataFrame([("k", 1, 0, 10**9), ("k", 2, 5, 10**9)], "k string, id int, s long, e long"), ["k"], "id", "s", "e", 100)
    assert [tuple(r) for r in plan.collect()] == [("k", 1, 2)]
    rows = ranges.cells(F.lit(0), F.lit(10**9), "level", 100)
    assert len(spark.range(1).select(ranges.level_of(F.lit(10**9), 100).alias("level")).select(rows.alias("c")).first().c) <= 2


def test_effect_barriers(spark):
    rng = random.Random(8)
    for _ in range(3):
        effects = [("n", rng.randrange(12), k, 10 * rng.randrange(9) + 5) for k in range(4)]
        refs = [("n", rng.randrange(12), rng.randrange(12), rng.randrange(90)) for _ in range(25)]
        barrier = {}
        for _, start, _, seq in effects:
            seen, todo = {start}, [start]
            while todo:
                at = todo.pop()
                for _, owner, thing, when in refs:
                    if owner == at and when < seq and thing not in seen:
                        seen.add(thing)
                        todo.append(thing)
            for node in seen:
                barrier[node] = max(seq, barrier.get(node, -1))
        versions = [("n", o, v, 7 * v) for o in range(12) for v in range(12)]
        got = evidence.effect_barriers(spark.createDataFrame(effects, "g string, object int, effect int, seq int"), spark.createDataFrame(refs, "g string, owner int, object int, seq int"), spark.createDataFrame(versions, "g string, owner int, version int, seq int"), ["g"])
        assert {(r.owner, r.version): r.known for r in got.collect()} == {(o, v): seq > barrier.get(o, -1) for _, o, v, seq in versions}


def test_origins(spark):
    edges = [("diamond", a, b) for a, b in ((1, 2), (1, 3), (2, 4), (3, 4))] + [("loop", 1, 2), ("loop", 2, 3), ("loop", 3, 2), ("loop", 3, 4), ("loop", 9, 8)] + [("below", 1, 2), ("below", 2, 2)] + [("cut", 1, 2), ("cut", 2, 1), ("cut", 2, 3)] + [("leaf", 1, 3), ("leaf", 2, 3)]
    kinds = [("diamond", k, "other") for k in range(1, 5)] + [("loop", k, "other") for k in (1, 2, 3, 4, 8, 9)] + [("below", 1, "other"), ("below", 2, "other"), ("cut", 1, "other"), ("cut", 2, "boundary"), ("cut", 3, "other"), ("leaf", 1, "boundary"), ("leaf", 2, "unbound"), ("leaf", 3, "other")]
    targets = [("diamond", 4), ("loop", 4), ("loop", 8), ("below", 2), ("cut", 3), ("leaf", 3)]
    args = (spark.createDataFrame(edges * 2, "g string, source int, target int"), spark.createDataFrame(kinds * 2, "g string, node int, kind string"), spark.createDataFrame(targets, "g string, node int"), ["g"])
    got = {(r.g, r.root): (r.sources, r.known, r.status) for r in graph.origins(*args).collect()}
    assert got == {("diamond", 4): ([1], True, "known"), ("loop", 4): (None, False, "cycle"), ("loop", 8): ([9], True, "known"), ("below", 2): (None, False, "cycle"), ("cut", 3): ([2], True, "known"), ("leaf", 3): ([1, 2], False, "unknown")}
    asked = {(r.g, r.root): (r.known, r.status) for r in graph.origins(*args, asked=True).collect()}
    assert asked[("diamond", 4)] == (False, "unknown") and asked[("cut", 3)] == (True, "known")


def test_repeated_spans(spark):
    """Every span delivered twice gives the rows that once gives; different parents are told, not multiplied."""
    rows = [("deep", k, k - 1 if k else None) for k in range(40)] + [("torn", 0, None), ("torn", 1, 0), ("torn", 1, 2), ("torn", 2, 0), ("torn", 3, 1), ("torn", 4, 2)]
    once, twice = (spark.createDataFrame(rows * n, "g string, node int, parent int") for n in (1, 3))
    for f in (graph.climb, graph.root_of, graph.ancestors):
        a, b = (sorted(map(repr, f(df, ["g"]).collect())) for df in (once, twice))
        assert a == b
    ends = {(r.g, r.node): (r.top, r.status) for r in graph.climb(twice, ["g"]).collect()}
    assert ends[("deep", 39)] == (0, "root") and ends[("torn", 1)] == (None, "many_parents") and ends[("torn", 3)] == (None, "many_parents") and ends[("torn", 4)] == (0, "root")
    above = {(r.node, r.ancestor) for r in graph.ancestors(twice, ["g"]).where("g = 'torn'").collect()}
    assert above == {(1, None), (3, None), (2, 0), (4, 2), (4, 0)}
    assert graph.ancestors(twice, ["g"]).where("g = 'deep'").count() == 40 * 39 // 2


def test_refused_observations(spark):
    tags = lambda url, method="get": {"http.method": method, "http.url": url}
    rows = [(1, 5, 5, tags("http://h/a")), (2, 5, -5, tags("http://h/a")), (3, 5, 5, tags("http://h")), (4, None, 5, tags("/x")), (5, 5, 5, tags("ftp://h")), (6, 5, 5, {"http.method": "get"}), (7, 5, 5, {"http.url": "/a"})]
    spans = spark.createDataFrame([("t", n, None, "s", "CLIENT", start, length, t) for n, start, length, t in rows], "trace string, span int, parent int, service string, kind string, start_us long, duration_us long, tags map<string,string>")
    assert [(r.span, r.method, r.path, r.peer) for r in project.project_observations(spans, ["s"]).collect()] == [(1, "GET", "/a", "h")]
    assert {(r.span, r.rule) for r in project.observation_violations(spans, ["s"]).collect()} == {(2, "bad_timing"), (3, "bad_path"), (4, "bad_timing"), (6, "bad_path")}


def test_stitched_graph(spark):
    """Two services: the read node goes, an overwritten position has no link, what isn't matched stays."""
    up = [(1, "src", "mid", "data", None, None), (1, "mid", "resp", "write", 0, 3), (1, "other", "resp", "write", 3, 6), (2, "src", "resp", "write", 0, 6)]
    down = [(1, "read", "x", "data", 2, 4), (1, "read", "z", "data", 5, 6), (1, "x", "sink", "data", None, None), (2, "read", "sink", "data", 0, 6)]
    schema = "k int, source string, target string, kind string, start int, end int"
    ends = lambda node, bodies: spark.createDataFrame([(k, node, b) for k, b in bodies], "k int, node string, body string")
    moved = evidence.transfers(ends("resp", [(1, "abcdef"), (2, "abcdef"), (3, "q"), (5, ""), (6, "s")]), ends("read", [(1, "abcdef"), (2, "abcdeX"), (3, "q"), (3, "q"), (4, "r"), (5, ""), (6, "s")]), ["k"], once=True)
    assert {(r.k, r.status) for r in moved.collect()} == {(1, "matched"), (2, "body_differs"), (3, "reused"), (4, "missing"), (5, "empty"), (6, "matched")}
    whole = evidence.stitched_graph(spark.createDataFrame(up, schema), spark.createDataFrame(down, schema), moved, ["k"])
    rows = {tuple(r)[:4] + (r.start, r.end) for r in whole.where("kind = 'transfer'").collect()}
    assert rows == {(1, "up:mid", "down:x", "transfer", 2, 3), (1, "up:other", "down:x", "transfer", 3, 4), (1, "up:other", "down:z", "transfer", 5, 6)}
    assert {r.k for r in whole.where("source = 'down:read'").collect()} == {2}
    back = graph.backward_slice(whole, spark.createDataFrame([(1, "down:sink"), (2, "down:sink")], "k int, node string"), ["k"])
    assert {(r.k, r.node) for r in back.collect()} == {(1, n) for n in ("down:sink", "down:x", "up:mid", "up:src", "up:other")} | {(2, "down:sink"), (2, "down:read")}


def test_exchanges(spark):
    sends = spark.createDataFrame([(1, "a", "b1", ["f"]), (2, "a", "b", ["f"]), (3, "a", "b", ["f"])], "k int, s string, body string, f array<string>")
    reads = spark.createDataFrame([(1, "b", "b1", ["f"]), (2, "a", "b", ["f"]), (3, "c", "x", ["f"])], "k int, s string, body string, f array<string>")
    assert {(r.k, r.status) for r in evidence.exchange_bridge(sends, reads, ["k"], "body", "f", service="s").collect()} == {(1, "matched"), (2, "same_service"), (3, "body_differs")}
    rows = [("a", "c1", "request", "write", "m1"), ("a", "c1", "response", "read", "m1"), ("b", "c1", "request", "read", "m1"), ("a", "c2", "request", "write", "m2"), ("a", "c2", "request", "write", "m3"), ("b", "c2", "response", "write", "m2")]
    got = evidence.reused_connections(spark.createDataFrame(rows, "s string, c string, d string, p string, m string"), ["c"], "s", "d", "p", "m").collect()
    assert [tuple(r) for r in got] == [("a", "c2", "client", 2)]


def test_value_edges(spark):
    rng = random.Random(9)
    tx = [(k, rng.randrange(3), rng.randrange(3), s := rng.randrange(100), s + rng.choice([0, 5, 60])) for k in range(40)]
    nodes = [(4 * t + k, t, "request" if k < 2 else "response", "receive" if k % 2 else "send", c if k in (0, 3) else v, f"v{t % 3}", s if k < 2 else e, s if k < 2 else e) for t, c, v, s, e in tx for k in range(4)]
    of = {t[0]: t for t in tx}
    want = defaultdict(set)
    for a in nodes:
        for b in nodes:
            if a[3] == "receive" and b[3] == "send" and a[4] == b[4] and a[5] == b[5] and a[7] <= b[6]:
                for c in tx:
                    sent = c[3] <= b[6] <= c[4] if b[2] == "request" else c[0] == b[1]
                    came = c[0] == a[1] if a[2] == "request" else of[a[1]][1] == a[4] and c[3] <= of[a[1]][3] and a[7] <= c[4]
                    if c[2] == a[4] and sent and came:
                        want[a[0], b[0]].add(c[0])
    got = evidence.value_edges_in_context(spark.createDataFrame(nodes, "node int, tx int, direction string, side string, service int, value string, start_us long, end_us long"), spark.createDataFrame(tx, "tx int, client int, server int, request_start_us long, response_end_us long"), 4)
    assert {(r.source, r.target): set(r.contexts) for r in got.collect()} == dict(want)


def test_paired_uncertainty(spark):
    """The bounds of the median that going through all resamples gives, ties and nulls included; large counts stay finite."""
    rng = random.Random(10)
    cases = {n: [rng.choice([0.5, 0.9, 1.0, 1.25, rng.random() * 2]) for _ in range(n)] for n in range(1, 7)} | {0: []}
    rows = [(n, x) for n, xs in cases.items() for x in [*xs, None]]
    got = {r.m: r for r in cost.paired_uncertainty(spark.createDataFrame(rows, "m int, x double"), "m", "x").collect()}
    for n, xs in cases.items():
        if not n:
            assert tuple(got[0]) == (0, 0, None, None, None, None)
            continue
        medians = sorted(statistics.median(s) for s in itertools.product(xs, repeat=n))
        up, down = sum(x > 1 for x in xs), sum(x < 1 for x in xs)
        sign = min(1, 2 * sum(math.comb(up + down, i) for i in range(min(up, down) + 1)) / 2 ** (up + down))
        want = (n, medians[math.ceil(len(medians) * 0.025) - 1], medians[math.ceil(len(medians) * 0.975) - 1], sign, 1 - 2 ** (1 - n))
        assert tuple(got[n])[1:] == pytest.approx(want)
    many = spark.createDataFrame([(m, k / m) for m in (300, 301) for k in range(m)], "m int, x double")
    for r in cost.paired_uncertainty(many, "m", "x").collect():
        assert 0.38 < r.low < 0.47 and 0.53 < r.high < 0.62 and r.coverage == 1.0


def test_planted_trees(spark):
    """The score falls when calls are not where they belong."""
    calls = lineage_queries.planted(spark, "/root/testdata/sf0.001")
    ratios = lambda df: tuple(df.agg(F.sum("tp") / (F.sum("tp") + F.sum("fp")), F.sum("tp") / (F.sum("tp") + F.sum("fn"))).first())
    good = ratios(lineage_queries.timing_score(calls))
    assert good[0] == 1.0 and good[1] > 0.95
    late = F.when(F.col("k") == 2, 25_000_000).when(F.col("k") == 3, -25_000_000).otherwise(0)
    moved = calls.withColumns({"start_us": F.col("start_us") + late, "end_us": F.col("end_us") + late, "peer": F.when(F.col("k") == 4, F.col("peer") + 1).otherwise(F.col("peer"))})
    bad = ratios(lineage_queries.timing_score(moved))
    assert bad[0] < 0.95 and bad[1] < good[1] - 0.1


def test_closures_do_not_broadcast(spark, tmp_path):
    """Rows that compress to few bytes are shuffled: a table of millions of them is no table to send to every task."""
    spark.range(20_000).select((F.col("id") % 5).alias("k"), F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit("data").alias("kind"), F.lit(0).alias("start"), F.lit(4).alias("end")).write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    bodies = edges.select("k", F.lit("b").alias("node"), F.lit("text").alias("body")).distinct()
    moved = evidence.transfers(bodies, bodies.withColumn("node", F.lit("a")), ["k"], once=True)
    stitched = evidence.stitched_graph(edges.distinct(), edges.distinct(), moved, ["k"])
    assert stitched.count() == 10
    sliced = graph.backward_slice(stitched, edges.select("k", F.lit("down:b").alias("node")), ["k"])
    assert sliced.count() == 10
    reached = []
    real = graph.materialize
    try:
        graph.materialize = lambda df, name: (reached.append(df), real(df, name))[1]
        graph.backward_slice(stitched, edges.select("k", F.lit("down:b").alias("node")), ["k"]).count()
    finally:
        graph.materialize = real
    for df in (moved, stitched, *reached):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_conflicts_of_single_objects_are_not_shuffled(spark):
    """Only pairs of requests with several objects can come twice."""
    one = spark.createDataFrame([(1, 0, 10, 0, 9), (2, 5, 12, 3, 20), (3, 11, 30, 0, 9)], "request int, born long, died long, low long, high long")
    got = joins.private_range_conflicts(one, 4, 4)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (2, 3)]
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_overlaps_compare_no_buckets(spark):
    """What meets in a bucket is compared by starts and ends alone, and mostly overlaps."""
    rows = spark.range(400).select(F.lit("k").alias("k"), "id", (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 100).alias("e"))
    got = joins.overlapping_pairs(rows, ["k"], "id", "s", "e", 100)
    assert got.count() == sum(min(9, 399 - k) for k in range(400))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "FLOOR" not in join.upper()


@pytest.mark.parametrize("repeats", [False, True])
def test_value_edges_shuffle_no_contexts(spark, repeats):
    """Calls that end before they begin, long values and repeated rows as by brute force; without repeats nothing is grouped by pairs."""
    rng = random.Random(11)
    tx = [(k, rng.randrange(2), rng.randrange(2), s := rng.randrange(60), s + rng.choice([-9, 0, 5, 20, 60])) for k in range(50)]
    nodes = [(4 * t + k, t, "request" if k < 2 else "response", "receive" if k % 2 else "send", c if k in (0, 3) else v, f"v{t % 2}" * (1 + 20 * (t % 3 == 0)), s if k < 2 else e, s if k < 2 else e) for t, c, v, s, e in tx for k in range(4)]
    of = {t[0]: t for t in tx}
    want = defaultdict(set)
    for a, b, c in itertools.product([n for n in nodes if n[3] == "receive"], [n for n in nodes if n[3] == "send"], tx):
        if a[4] == b[4] == c[2] and a[5] == b[5] and a[7] <= b[6]:
            sent = c[3] <= b[6] <= c[4] if b[2] == "request" else c[0] == b[1]
            came = c[0] == a[1] if a[2] == "request" else of[a[1]][1] == a[4] and c[3] <= of[a[1]][3] and a[7] <= c[4]
            if sent and came:
                want[a[0], b[0]].add(c[0])
    more = repeats * 7
    frames = spark.createDataFrame(nodes + nodes[:more], "node int, tx int, direction string, side string, service int, value string, start_us long, end_us long"), spark.createDataFrame(tx + tx[:more], "tx int, client int, server int, request_start_us long, response_end_us long")
    got = evidence.value_edges_in_context(*frames, 4)
    rows = got.collect()
    assert len(rows) == len(want) and {(r.source, r.target): r.contexts for r in rows} == {k: sorted(v) for k, v in want.items()}
    assert any(len(r.contexts) > 3 for r in rows)
    texts = evidence.value_edges_in_context(*frames, 4, separator="; ").collect()
    assert sorted(tuple(r) for r in texts) == sorted((r.source, r.target, "; ".join(map(str, r.contexts))) for r in rows)
    if not repeats:
        assert "hashpartitioning(source" not in got._jdf.queryExecution().executedPlan().toString()


def test_contexts_are_picked_among_open_requests():
    """Requests around that no call lies in are not looked at for each pair; batches of any size give the same pairs."""
    pairs = 200
    cell = lambda **of: pa.ListArray.from_arrays(pa.array([0, len(next(iter(of.values())))], pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in of.values()], names=list(of)))
    spent = {}
    for idle in (20, 8000):
        sources = cell(source=np.arange(pairs), source_at=np.full(pairs, 50), call_at=np.full(pairs, 40))
        targets = cell(target=np.arange(pairs)[::-1].copy(), target_at=(60 + np.arange(pairs))[::-1].copy())
        around = cell(tx=np.arange(idle + 3), from_us=np.r_[[0, 10, 40], np.full(idle, 45)], to_us=np.r_[[100, 500, 150], np.full(idle, 500)])
        batch = pa.RecordBatch.from_arrays([sources, targets, around], ["sources", "targets", "around"])
        runs = []
        for rows in (1_000_000, 1_000_000, 500):
            began = time.process_time()
            got = list(evidence._open_throughout([batch], ",", rows))
            runs.append(time.process_time() - began)
            texts = pa.Table.from_batches(got).to_pydict()
            want = {(s, t): "0,1,2" if t <= 40 else "1,2" if t <= 90 else "1" for s in range(pairs) for t in range(pairs)}
            assert len(texts["source"]) == len(want) and dict(zip(zip(texts["source"], texts["target"], strict=True), texts["contexts"], strict=True)) == want
        spent[idle] = min(runs[:2])
    assert spent[8000] < 10 * spent[20] + 0.1


def test_running_maxima(spark, monkeypatch):
    """Maxima are carried over pieces of a large group."""
    rows = [(k % 2, k, (k * 37) % 101 if k % 3 else None) for k in range(200)]
    monkeypatch.setattr(ranges, "PIECE_ROWS", 20)
    got = ranges.running(spark.createDataFrame(rows, "g int, at int, x int"), ["g"], ["at"], maxes={"most": F.col("x")}, small=False).collect()
    for r in got:
        assert r.most == max((x for g, at, x in rows if g == r.g and at <= r["at"] and x is not None), default=None)
