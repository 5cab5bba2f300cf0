"""Greedy matching against a version that looks at all pairs anew for each cost."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spanloom.operators import joins
from spanloom.operators.joins import greedy_levels


def brute(pairs):
    out, taken_c, taken_s = set(), set(), set()
    for cost in sorted({p[2] for p in pairs}):
        free = [p for p in pairs if p[2] == cost and p[0] not in taken_c and p[1] not in taken_s]
        out |= {(*p, any(q != p and (q[0] == p[0] or q[1] == p[1]) for q in free)) for p in free}
        taken_c |= {p[0] for p in free}
        taken_s |= {p[1] for p in free}
    return out


def test_greedy_levels():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 300):
        pairs = sorted({(int(c), int(s), int(k)) for c, s, k in rng.integers(0, 12 + n // 20, (n, 3))})
        df = pd.DataFrame(pairs, columns=["client", "server", "cost"], dtype="int64")
        got = greedy_levels(df)
        assert {(r.client, r.server, r.cost, r.tied) for r in got.itertuples()} == brute(pairs)
        assert len(got) == len(brute(pairs))


def test_many_costs():
    n = 100_000
    df = pd.DataFrame({"client": range(n), "server": range(n), "cost": range(n)})
    assert not greedy_levels(df)["tied"].any()


def test_calls(spark):
    """Matching calls in rounds gives what matching all pairs of a path at once gives."""
    rng = np.random.default_rng(5)
    calls = [(k, int(rng.integers(0, 400)), int(rng.integers(1, 30))) for k in range(120)]
    pairs = []
    for c, start, length in calls[:60]:
        for s, begin, size in calls[60:]:
            if begin >= start - 2 and begin + size <= start + length + 2:
                pairs.append((c, s, 1, "p" if c % 2 else "q", abs(begin - start) // 3, min(start, begin), max(start + length, begin + size)))
    pairs = [p for p in pairs if p[3] == ("p" if p[1] % 2 else "q")]
    df = spark.createDataFrame(pairs, "client long, server long, service int, path string, cost long, from_us long, to_us long")
    got = {(r.client, r.server, r.cost, r.tied) for r in joins.greedy_match(df, together=3).collect()}
    assert got == {x for path in "pq" for x in brute([(c, s, k) for c, s, _, p, k, *_ in pairs if p == path])}


def test_local_parents_in_pieces(spark):
    """The latest call around each one is found across pieces of a few rows; ties, repeated calls and slack included, and no pairs are made."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(240):
        start = int(rng.integers(0, 150))
        rows.append((k, int(rng.integers(0, 3)), "CLIENT" if k % 2 else "SERVER", start, start + int(rng.choice([0, 2, 9, 60, 300]))))
    rows += [(500, 0, "SERVER", -5, 10**9), (501, 0, "CLIENT", 400, 500), (502, 1, "SERVER", 7, 70), (503, 1, "SERVER", 7, 70), (504, 1, "CLIENT", 8, 70), (505, None, "CLIENT", 8, 9), (506, 2, "CLIENT", 9, None), (501, 0, "CLIENT", 401, 450)]
    df = spark.createDataFrame(rows, "event_id long, service int, kind string, start_us long, end_us long")
    whole = [r for r in rows if r[1] is not None and r[4] is not None]
    for slack in (0, 3):
        want = {}
        for child in {r[0] for r in whole if r[2] == "CLIENT"}:
            held = [(s[3], s[0]) for c in whole if c[0] == child and c[2] == "CLIENT" for s in whole if s[2] == "SERVER" and s[1] == c[1] and s[3] - slack <= c[3] and c[4] <= s[4] + slack]
            last = [p for at, p in held if at == max(held)[0]]
            if len(last) == 1:
                want[child] = last[0]
        for size in (7, 1000):
            assert {(r.child, r.parent) for r in joins.local_parents(df, slack, piece_rows=size).collect()} == set(want.items())
    inside = joins.local_parents(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in inside


def test_matching_in_bands(spark):
    """Bands of costs with few comparisons give what all candidates at once give, calls with equal times and repeated ids included."""
    rng = np.random.default_rng(13)
    rows = []
    for k in range(160):
        start = int(rng.integers(0, 900)) if k % 9 else 40
        length = int(rng.choice([0, 5, 60, 200])) if k % 9 else 70 - k % 2
        rows.append((k, int(rng.integers(0, 2)), int(rng.integers(0, 2)), "CLIENT" if k % 2 else "SERVER", "pq"[int(k % 5 == 0)], start, start + length))
    schema = "event_id long, service int, peer int, kind string, path string, start_us long, end_us long"
    for more in ([], [(1, 0, 0, "CLIENT", "p", 3, 300)]):
        obs = spark.createDataFrame(rows + more + [(900, None, None, "CLIENT", "p", 3, 300), (None, 0, 0, "SERVER", "p", 3, 300)], schema)
        pairs = [tuple(r) for r in joins.transport_candidates(obs, 3, 16).collect()]
        known = [p for p in pairs if p[0] is not None and p[1] is not None]
        want = {x for v in (0, 1) for path in "pq" for x in brute([(c, s, k) for c, s, w, p, k in known if (w, p) == (v, path)])}
        got = joins.match_calls(obs, 3, pairs=300, bucket_us=16).collect()
        assert {(r.client, r.server, r.cost, r.tied) for r in got} == want and len(got) == len(want)


def test_matching_of_copies_in_many_tasks(spark, monkeypatch):
    """Calls with many copies become pairs in tasks of a bounded number of rows, all copies of a server's clients among them."""
    monkeypatch.setattr(joins, "TASK_PAIRS", 500, raising=False)
    calls = [("CLIENT", 100, 400)] * 90 + [("SERVER", 110, 390)] * 80 + [("CLIENT", 1000, 1400)] * 7 + [("SERVER", 1010, 1390)] + [("CLIENT", 3000, 3400), ("SERVER", 3001, 3400)] + [("CLIENT", 5000, 5400)] + [("SERVER", 5002, 5400)] * 9
    obs = spark.createDataFrame([(k, 1, 1, kind, "p", a, b) for k, (kind, a, b) in enumerate(calls)], "event_id long, service int, peer int, kind string, path string, start_us long, end_us long")
    clients, servers = ([(k, a, b) for k, (kind, a, b) in enumerate(calls) if kind == of] for of in ("CLIENT", "SERVER"))
    want = brute([(c, s, abs(a - x) + abs(b - y)) for c, a, b in clients for s, x, y in servers if x >= a - 3 and y <= b + 3])
    got = joins.match_calls(obs, 3).withColumn("task", F.spark_partition_id())
    rows = got.collect()
    assert {(r.client, r.server, r.cost, r.tied) for r in rows} == want and len(rows) == len(want) == 90 * 80 + 7 + 1 + 9
    assert max(Counter(r.task for r in rows).values()) <= 80 * 90 // 2  # a server's ninety clients are five shares


def test_matching_ends_where_no_pair_fits(spark):
    """Calls that are compared but never fit take no endless bands."""
    rows = [(k, 1, 1, "CLIENT" if k % 2 else "SERVER", "p", 2 * k if k % 2 else 2 * k - 1000, 2 * k + 900) for k in range(60)]
    obs = spark.createDataFrame(rows, "event_id long, service int, peer int, kind string, path string, start_us long, end_us long")
    assert joins.transport_candidates(obs, 3, 10_000).isEmpty()
    assert joins.match_calls(obs, 3, pairs=5, bucket_us=10_000).isEmpty()
