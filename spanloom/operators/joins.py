"""Joins with exactly-one semantics, intervals, as-of reads and lineage-carrying tables."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .ranges import MOST_PIECES, level_of, levels_in, running


def unique_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows with ``status`` matched, missing or ambiguous; only matched rows carry the right columns. Counting comes before any comparison of values."""
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest) if rest else F.lit(1)).alias("__r"))
    joined = left.join(one, keys, "left")
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").otherwise("matched")
    return joined.select(*left.columns, status.alias("status"), *[F.when(F.col("__n") == 1, F.col(f"__r.{c}")).alias(c) for c in rest])


def _calls(obs: DataFrame) -> tuple[list[str], DataFrame, DataFrame]:
    """What a client and a server must share, and both sides of the calls."""
    method = ["method"] if "method" in obs.columns else []
    c = obs.where("kind = 'CLIENT'").select(F.col("event_id").alias("client"), F.col("peer").alias("service"), "path", *method, F.col("start_us").alias("cs"), F.col("end_us").alias("ce"))
    s = obs.where("kind = 'SERVER'").select(F.col("event_id").alias("server"), "service", "path", *method, F.col("start_us").alias("ss"), F.col("end_us").alias("se"))
    return ["service", "path", *method], c, s


def _in_buckets(obs: DataFrame, slack_us: int, bucket_us: int) -> tuple[list[str], DataFrame, DataFrame]:
    """Both sides in the buckets where all pairs that fit meet, and the columns to join on."""
    key, c, s = _calls(obs)
    c = c.withColumn("level", level_of(F.col("ce") - F.col("cs") + 2 * slack_us, bucket_us))
    levels = [r[0] for r in c.select("level").distinct().where("level is not null").collect()]  # some dozens at most: the lengths' powers of two
    size = F.expr(f"shiftleft(bigint({bucket_us}), level)")
    c = c.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("cs") - slack_us) / size), F.floor((F.col("ce") + slack_us) / size))))
    s = s.withColumn("level", F.explode(F.array(*[F.lit(k) for k in sorted(levels)]).cast("array<int>"))).withColumn("bucket", F.floor(F.col("ss") / size))
    return [*key, "level", "bucket"], c, s


def _near(obs: DataFrame, slack_us: int, most: int) -> tuple[list[str], DataFrame, DataFrame]:
    """Both sides in the cells of starts and ends where all pairs meet that cost no more than ``most``; a client call touches four."""
    key, c, s = _calls(obs)
    low, size = min(slack_us, most), 2 * most + 1
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
    c = c.where("cs is not null and ce is not null").withColumn("x", cells(F.col("cs") - low, F.col("cs") + most)).withColumn("y", cells(F.col("ce") - most, F.col("ce") + low))
    return [*key, "x", "y"], c, s.withColumns({"x": F.floor(F.col("ss") / size), "y": F.floor(F.col("se") / size)})


def _cost():
    return F.abs(F.col("ss") - F.col("cs")) + F.abs(F.col("se") - F.col("ce"))


def _fitting(at: list[str], c: DataFrame, s: DataFrame, slack_us: int) -> DataFrame:
    return c.join(s.hint("merge"), at).where((F.col("ss") >= F.col("cs") - slack_us) & (F.col("se") <= F.col("ce") + slack_us))


def transport_candidates(obs: DataFrame, slack_us: int, bucket_us: int = 3_600_000_000, with_times: bool = False) -> DataFrame:
    """Client and server pairs of the same service and path, and method if there is that column, whose intervals fit within the slack: client, server, service, path, cost.

    ``obs`` has event_id, service, peer, kind, path, start_us, end_us. A server joins the time buckets that a client's
    interval touches; a bucket's size is the power of two times ``bucket_us`` that follows the interval's length, so no
    interval touches more than a few. ``with_times`` adds the time that both calls span (from_us, to_us).
    """
    at, c, s = _in_buckets(obs, slack_us, bucket_us)
    times = [F.least("cs", "ss").alias("from_us"), F.greatest("ce", "se").alias("to_us")] if with_times else []
    return _fitting(at, c, s, slack_us).select("client", "server", *at[:-2], _cost().alias("cost"), *times)


#: Comparisons that all candidates, or those of one band of costs, may take: for each open call, and in any case.
BAND_PAIRS, LEAST_PAIRS = 16, 50_000_000


def match_calls(obs: DataFrame, slack_us: int, pairs: int | None = None, bucket_us: int = 3_600_000_000) -> DataFrame:
    """What ``greedy_match`` gives for ``transport_candidates``, where these are too many to be made.

    Matching goes by ascending cost, so the pairs of up to a cost can be settled without the dearer ones. Bands of costs are as wide
    as their comparisons allow (``pairs``); what a band uses up makes no pairs in later ones. Calls of one side that are alike in all
    but their id are one call in this, as all of them are used up together; in the end each stands for itself, tied with its like.
    """
    key = _calls(obs)[0]
    named = F.when(F.col("kind") == "CLIENT", F.col("peer")).otherwise(F.col("service"))
    method = key[2:]
    calls = obs.where("kind in ('CLIENT', 'SERVER')").select("event_id", "kind", named.alias("service"), named.alias("peer"), "path", *method, "start_us", "end_us").dropna()
    alike = Window.partitionBy("kind", *key, "start_us", "end_us")
    calls = materialize(calls.withColumns({"like": F.min("event_id").over(alike), "copies": F.count("*").over(alike)}), "calls")
    if not calls.groupBy("event_id").count().where("count > 1").isEmpty():  # an end that is several calls has candidates of all of them
        return greedy_match(transport_candidates(obs, slack_us, bucket_us))
    left = calls.where("event_id = like").drop("like", "copies")
    settled, least, whole, counted, before = None, -1, None, 1, 0
    while True:
        of = lambda kind, time: F.max(F.when(F.col("kind") == kind, F.expr(time)))
        n, longest, back = left.agg(F.count("*"), of("CLIENT", "end_us - start_us"), of("SERVER", "start_us - end_us")).first()
        longest, back = max(longest or 0, 0) + 2 * slack_us, max(back or 0, 0)
        if least >= 2 * (longest + back):  # no pair costs more
            break
        limit = pairs or max(LEAST_PAIRS, BAND_PAIRS * n)
        # all pairs are counted again where they may have become few enough
        if whole is None or whole * (n / counted) ** 2 <= 4 * limit or 10 * n > 9 * before:
            at, c, s = _in_buckets(left, slack_us, bucket_us)
            whole, counted = _comparisons(at, c, s), n
        last, before = whole <= limit, n
        if not last:
            most = _widest(left, slack_us, limit, max(2 * least + 1, 0), longest + 2 * slack_us, whole * (n / counted) ** 2)
            at, c, s = _near(left, slack_us, most)
        band = _fitting(at, c, s, slack_us).select("client", "server", "service", "path", _cost().alias("cost")).where(F.col("cost") > least)
        done = materialize(greedy_match(band if last else band.where(F.col("cost") <= most)), "band")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        used = done.select(F.explode(F.array("client", "server")).alias("event_id"))
        left, least = materialize(left.join(used.hint("merge"), "event_id", "left_anti"), "open"), most
    return _each_copy(settled, calls.where("copies > 1").select("event_id", "like", "copies"))


#: Pairs of copies that one task makes.
TASK_PAIRS = 1_000_000


def _each_copy(settled: DataFrame, twins: DataFrame) -> DataFrame:
    """Settled pairs with every call in the place of its like: twins (event_id, like, copies) are the calls that are not alone.

    A few settled pairs become as many rows as their copies multiplied, so tasks follow the rows that they make. The clients of one
    server, once each stands for itself, are dealt out to several shares, and its copies go to each of them.
    """
    if twins.isEmpty():
        return settled
    columns = settled.columns
    copies = lambda end: twins.where("event_id = like").select(F.col("like").alias(end), F.col("copies").alias(f"{end}_copies")).hint("merge")
    ends = settled.join(copies("client"), "client", "left").join(copies("server"), "server", "left").fillna(1, ["client_copies", "server_copies"])
    asked = F.sum("client_copies").over(Window.partitionBy("server"))
    shares = F.greatest(F.lit(1), F.least(F.ceil(asked * F.col("server_copies") / TASK_PAIRS), F.floor(asked / 16))).cast("int")
    ends = materialize(ends.withColumns({"shares": shares, "tied": F.expr("tied or client_copies > 1 or server_copies > 1")}), "ends")
    parts = max(1, min(MOST_PIECES, -(-(ends.agg(F.sum(F.col("client_copies") * F.col("server_copies"))).first()[0] or 0) // TASK_PAIRS)))
    of = lambda end: twins.select(F.col("like").alias(end), F.col("event_id").alias(f"{end}_id"))
    clients = ends.join(of("client").hint("merge"), "client", "left").withColumn("client", F.coalesce("client_id", "client")).withColumn("share", F.expr("pmod(xxhash64(client), shares)"))
    servers = of("server").join(ends.select("server", "shares").distinct().hint("merge"), "server").select("server", "server_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - F.lit(1).cast("long"))).alias("share"))
    every = clients.repartition(parts, "server", "share").join(servers.repartition(parts, "server", "share").hint("merge"), ["server", "share"], "left")
    return every.withColumn("server", F.coalesce("server_id", "server")).select(*columns)


def _widest(left: DataFrame, slack_us: int, limit: int, low: int, high: int, whole: float) -> int:
    """A width of a band with some ``limit`` comparisons, or less; ``low``, the next band's least width, at worst.

    Comparisons grow with a power of the width between 1, where all calls are as near, and 2, so each count tells where to look
    next; most bands need one. Before any, an eighth of ``high``, the most that a pair may cost, is taken to hold all of the ``whole``.
    """
    at, counted = high / 8, whole
    while True:
        at = int(at * (0.7 * limit / max(counted, 1)) ** (1 / 1.5))
        at = max(min(at, high - high // 8), low + low // 2 + 1)
        if at >= high or at <= low:
            return low
        counted = _comparisons(*_near(left, slack_us, at))
        if counted > limit:
            high = at
        elif 4 * counted >= limit or 2 * at >= high:
            return at
        else:
            low = at


def _comparisons(at: list[str], c: DataFrame, s: DataFrame) -> int:
    """How many pairs a join looks at."""
    both = c.groupBy(*at).agg(F.count("*").alias("c")).join(s.groupBy(*at).agg(F.count("*").alias("s")).hint("merge"), at)
    return both.agg(F.sum(F.col("c") * F.col("s"))).first()[0] or 0


def greedy_levels(pairs: pd.DataFrame) -> pd.DataFrame:
    """Cheapest pairs first; at one cost, pairs that share an end with another still possible one abstain and use up their ends."""
    pairs = pairs.dropna(subset=["cost"]).sort_values(["cost", "client", "server"]).reset_index(drop=True)
    used_c: set = set()
    used_s: set = set()
    at, tied = [], []
    rows = zip(range(len(pairs)), pairs["cost"].tolist(), pairs["client"].tolist(), pairs["server"].tolist(), strict=True)
    for _, level in groupby(rows, key=lambda r: r[1]):
        free = [(k, c, s) for k, _, c, s in level if c not in used_c and s not in used_s]
        clients, servers = Counter(c for _, c, _ in free), Counter(s for _, _, s in free)
        used_c.update(clients)
        used_s.update(servers)
        at += [k for k, _, _ in free]
        tied += [clients[c] > 1 or servers[s] > 1 for _, c, s in free]
    return pairs.iloc[at].assign(tied=np.array(tied, bool))


#: Pairs that are matched in one go, once no more are open.
TOGETHER = 200_000


def greedy_match(candidates: DataFrame, together: int = TOGETHER) -> DataFrame:
    """One-to-one matching by ascending cost: client, server, service, path, cost, and ``tied`` for pairs that abstained.

    Candidates never cross a service and path; pairs without an end or a cost are left out. A pair that no open pair at
    either end undercuts is settled, whatever happens elsewhere: it uses up both ends, and dearer pairs there are gone. Each
    round settles all such pairs at once, so the rounds follow the longest chain of ever dearer pairs that hang on each
    other, not the number of pairs; what is open when no more than ``together`` pairs are is matched path by path. Pairs
    settled at one end have one cost: if there are two, all of them are tied and abstain. A round shuffles the open pairs
    twice, by client and by server; what is cheapest at a server is found with what the round before has left there.
    """
    columns = ["client", "server", "service", "path", "cost"]
    by_client, by_server = (Window.partitionBy("service", "path", end) for end in ("client", "server"))
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    least = lambda kept, by: F.min(F.when(F.col(kept), F.col("cost"))).over(by)
    left = materialize(candidates.select(*columns).dropna().withColumn("low_server", F.min("cost").over(by_server)), "open")
    settled, rounds = None, 0
    add = lambda done, more: more if done is None else done.unionByName(more)
    while left.count() > together:
        marked = left.withColumn("free", (F.col("cost") == F.col("low_server")) & (F.col("cost") == F.min("cost").over(by_client))).withColumn("used_client", least("free", by_client)).withColumn("used_server", least("free", by_server))
        # at an end of a settled pair only pairs of its cost stay open: they may be free, and then tie
        marked = marked.withColumn("stays", F.expr("not free and coalesce(cost <= used_client, true) and coalesce(cost <= used_server, true)")).where("free or stays")
        marked = materialize(marked.withColumn("low_server", least("stays", by_server)).select(*columns, "low_server", "free"), "marked")
        settled, rounds = add(settled, marked.where("free").select(*columns)), rounds + 1
        if rounds % 16 == 0:  # one table again, so that plans don't grow with the rounds
            settled = materialize(settled, "settled")
        left = marked.where("not free").drop("free")
    last = left.select(*columns).groupBy("service", "path").applyInPandas(lambda pdf: greedy_levels(pdf)[columns], ", ".join(f"{c} {kinds[c]}" for c in columns))
    settled = add(settled, last).withColumns({"n_client": F.count("*").over(by_client), "n_server": F.count("*").over(by_server)})
    return settled.select(*columns, F.expr("n_client > 1 or n_server > 1").alias("tied"))


#: Rows of a piece of a service's time in ``local_parents``.
PIECE_ROWS = 250_000


def latest_holders(rows: pd.DataFrame) -> pd.DataFrame:
    """For each asking row of a piece, in order, the last begun row before it that ends no sooner: child, ss, n, parent.

    A row that has begun later and ends no sooner hides those before it, so the open rows form a stack with falling ends.
    """
    rows = rows.sort_values(["asks", "at"] if rows["far"].iloc[0] else ["at", "asks"], kind="stable")
    ends, stack, out = [], [], []
    columns = [rows[c].tolist() for c in ("asks", "at", "end", "second", "event_id", "ends_there")]
    for asks, at, end, second, ident, ends_there in zip(*columns, strict=True):
        if asks:
            k = bisect_right(ends, -end) - 1  # ends are kept negative, so that they rise
            if k >= 0:
                begun, parent, other, twice = stack[k]
                out.append((ident, begun, 2 if twice > 1 or other >= end else 1, parent))
        else:
            while ends and -ends[-1] <= end:
                ends.pop()
                stack.pop()
            ends.append(-end)
            stack.append((at, ident, second, ends_there))
    return pd.DataFrame(out, columns=["child", "ss", "n", "parent"])


def local_parents(obs: DataFrame, slack_us: int = 0, piece_rows: int | None = None) -> DataFrame:
    """Each client call's latest-begun containing server call of its service: child, parent; a tie on the start abstains.

    No pairs are made. Calls stand in the order of service and start, cut into pieces of some ``piece_rows`` rows. Of the server
    calls that begin together only the last end counts, and the one before it, for ties. A client call looks into its own piece and
    into the nearest piece before it in which something ends late enough; the later start of both answers counts.
    """
    known = obs.where("service is not null and start_us is not null and end_us is not null")
    s = known.where("kind = 'SERVER'").groupBy("service", "start_us", "end_us").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"))
    w = Window.partitionBy("service", "start_us").orderBy(F.desc("end_us"))
    s = s.withColumns({"place": F.row_number().over(w), "second": F.lead("end_us").over(w)}).where("place = 1")
    least = -(2**63)
    s = s.select("service", F.col("start_us").alias("at"), F.col("end_us").alias("end"), F.coalesce("second", F.lit(least)).alias("second"), F.col("event_id"), F.col("n").alias("ends_there"), F.lit(0).alias("asks"))
    c = known.where("kind = 'CLIENT'").select("service", (F.col("start_us") + slack_us).alias("at"), (F.col("end_us") - slack_us).alias("end"), F.lit(least).alias("second"), "event_id", F.lit(0).cast("long").alias("ends_there"), F.lit(1).alias("asks"))
    rows = materialize(s.unionByName(c), "calls")
    pieces = max(1, -(-rows.count() // (piece_rows or PIECE_ROWS)))
    # a written table, so that a row's piece never changes
    cut = materialize(rows.repartitionByRange(pieces, "service", "at", "asks", "end", "event_id").withColumn("piece", F.spark_partition_id()), "pieces")
    ends = cut.where("asks = 0").groupBy("service", "piece").agg(F.max("end").alias("most"))
    before = ends.groupBy("service").agg(F.array_sort(F.collect_list(F.struct("piece", "most"))).alias("before"))
    earlier = "element_at(filter(before, p -> p.piece < piece and p.most >= end), -1).piece"
    far = cut.where("asks = 1").join(F.broadcast(before), "service").withColumn("to", F.expr(f"if(exists(before, p -> p.piece < piece and p.most >= end), {earlier}, null)")).where("to is not null")
    far = far.select(*rows.columns, "piece", "to")
    # of a piece that others look into only what nothing later in it hides is needed, once for each piece that looks
    later = Window.partitionBy("service", "piece").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.where("asks = 0").withColumn("later", F.max("end").over(later)).where("later is null or end > later").drop("later").withColumnRenamed("piece", "to")
    seen = seen.join(F.broadcast(far.select("service", "to", "piece").distinct()), ["service", "to"])
    every = cut.withColumns({"to": F.col("piece"), "far": F.lit(0)}).unionByName(far.unionByName(seen).withColumn("far", F.lit(1)))
    kind = obs.schema["event_id"].dataType.simpleString()
    every = every.withColumn("event_id", F.col("event_id").cast("string"))  # null or not, a number of any size stays as it is
    found = every.groupBy("service", "to", "piece").applyInPandas(lambda pdf: latest_holders(pdf), "child string, ss long, n long, parent string")
    found = found.select(F.col("child").cast(kind).alias("child"), "ss", "n", F.col("parent").cast(kind).alias("parent"))
    best = found.repartition("child").groupBy("child", "ss").agg(F.sum("n").alias("n"), F.min("parent").alias("parent")).groupBy("child").agg(F.max(F.struct("ss", "n", "parent")).alias("b"))
    return best.where("b.n = 1").select("child", F.col("b.parent").alias("parent"))


def send_receive_coverage(sends: DataFrame, receives: DataFrame, key: list[str]) -> DataFrame:
    """How many keys are matched, sent only and received only."""
    joined = sends.select(*key).distinct().withColumn("s", F.lit(1)).join(receives.select(*key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    return joined.agg(F.count_if(F.col("s").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("r").isNull()).alias("unmatched_sends"), F.count_if(F.col("s").isNull()).alias("unmatched_receives"))


def alias_sources(targets: DataFrame, providers: DataFrame, coordinate: list[str], target: str, provider: str, seq: str, same: list[str] = ()) -> DataFrame:
    """Each target's only earlier provider of the same coordinate; several make it unknown, none missing.

    ``same`` names columns of both sides (the value, the reference) that must agree: if they don't, something wrote outside
    the counted writes, and the target is unknown. They are looked at after the count and never choose a provider.
    """
    p = providers.select(*coordinate, F.col(provider), F.col(seq).alias("__seq"), *[F.col(c).alias(f"__{c}") for c in same])
    joined = targets.join(p, coordinate, "left").withColumn("__ok", F.col("__seq") < F.col(seq))
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = joined.groupBy(target).agg(F.count_if("__ok").alias("n"), F.min(F.when(F.col("__ok"), F.col(provider))).alias("source"), F.count_if(F.col("__ok") & differs).alias("changed"))
    good = (F.col("n") == 1) & (F.col("changed") == 0)
    return found.select(target, F.when(good, F.col("source")).alias("source"), F.when(F.col("n") == 0, "missing").when(good, "matched").otherwise("unknown").alias("status"))


def last_write_asof(log: DataFrame, owner: list[str], seq: str, kind: str, event: str, version: str | None = None) -> DataFrame:
    """Each read's last earlier write of the same owner; null without one, after a barrier or abort, or where versions differ. An owner of any size is sorted by many tasks."""
    of = lambda known: F.struct(F.col(event).alias("event"), (F.col(version) if version else F.lit(0)).alias("version"), F.lit(known).alias("known"))
    # a barrier replaces the write before it by one that is not known
    carried = F.when(F.col(kind) == "write", of(True)).when(F.col(kind).isin("barrier", "abort"), of(False))
    rows = running(log, owner, [seq], lasts={"__last": carried}).where(F.col(kind) == "read")
    good = F.col("__last.known") & ((F.col("__last.version") == F.col(version)) if version else F.lit(True))
    return rows.select(F.col(event), F.when(good, F.col("__last.event")).alias("source"))


def property_bridge(writes: DataFrame, reads: DataFrame, key: list[str], service: str, value: str, direction: str | None = None, echo: str | None = None, message: str | None = None) -> DataFrame:
    """Reads joined to the one write of the same (message, direction, pointer) by another service, with ``status``: matched, missing, ambiguous, same_service or value_differs.

    With ``direction``, ``echo`` and ``message``, columns of the reads, a property that several read is ambiguous too, and a
    response must echo its message: if it names another or none, the status is echo_differs.
    """
    w = writes.select(*key, F.col(service).alias("from_service"), F.col(value).alias("sent"))
    out = unique_join(reads, w, key)
    status = F.when(F.col("status") != "matched", F.col("status"))
    if echo:
        readers = reads.groupBy(*key).agg(F.count("*").alias("__readers"))
        out = out.join(readers, key, "left")
        status = status.when(F.col("__readers") > 1, "ambiguous")
    status = status.when(F.col("from_service") == F.col(service), "same_service")
    if echo:
        status = status.when((F.col(direction) == "response") & ~F.col(echo).eqNullSafe(F.col(message)), "echo_differs")
    return out.withColumn("status", status.when(~F.col("sent").eqNullSafe(F.col(value)), "value_differs").otherwise("matched")).drop("__readers")


def repeated_transports(events: DataFrame, message: list[str], event: str) -> DataFrame:
    """Messages (by message, direction and phase) with more than one transport event, and how many: no property of theirs is bridged."""
    return events.groupBy(*message).agg(F.count_distinct(event).alias("events")).where("events > 1")


def overlapping_pairs(intervals: DataFrame, key: list[str], ident: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs (a, b), a before b by id, of the same key with max(start) < min(end).

    Two intervals overlap if the later one starts inside the earlier. An interval stands in the buckets that it touches, five at
    most: their size follows its length, however long it is. A start stands in one bucket of each size, so most of what meets
    overlaps, and nothing more than starts and ends is compared; ``bucket`` is the smallest length that is told apart.
    """
    bucket = max(1, bucket // 16)
    rows = intervals.select(*key, F.col(ident).alias("id"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s < e").withColumn("level", level_of((F.col("e") - F.col("s")) / 4, bucket))
    size = f"shiftleft(bigint({bucket}), level)"
    held = rows.withColumn("cell", F.explode(F.sequence(F.expr(f"floor(s / {size})"), F.expr(f"floor((e - 1) / {size})"))))
    starts = rows.withColumn("level", F.explode(levels_in(rows, "level"))).select(*key, "level", F.expr(f"floor(s / {size})").alias("cell"), F.col("id").alias("id2"), F.col("s").alias("s2"))
    return held.join(starts.hint("merge"), [*key, "level", "cell"]).where("s2 < e and (s < s2 or s = s2 and id < id2) and id != id2").select(*key, F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def offsets_to_fields(offsets: DataFrame, spans: DataFrame, case: list[str]) -> DataFrame:
    """Each offset's field span (begin <= offset < finish) of its case; offsets in none are kept as ``$nonvalue-byte:offset``.

    A sweep over a case's begins and offsets finds the field: where spans don't overlap, the last one that began is the only
    one that may hold the offset. ``overlap`` says that a span which began before still runs; then the least name counts.
    """
    begun = spans.where("begin < finish").select(*case, F.col("begin").alias("offset"), F.lit(0).alias("kind"), "finish", "field")
    asked = offsets.select(*case, "offset", F.lit(1).alias("kind"), F.lit(None).cast(spans.schema["finish"].dataType).alias("finish"), F.lit(None).cast("string").alias("field"))
    w = Window.partitionBy(*case).orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = begun.unionByName(asked).withColumns({"last": F.last("field", True).over(w), "ends": F.last("finish", True).over(w), "most": F.max("finish").over(w), "begun": F.count("finish").over(w)})
    # how many spans have ended by an offset: the others that began still run
    ended = spans.where("begin < finish").select(*case, F.col("finish").alias("offset"), F.lit(-1).alias("kind"))
    v = Window.partitionBy(*case).orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = ended.unionByName(offsets.select(*case, "offset", F.lit(1).alias("kind"))).withColumn("gone", F.count_if(F.col("kind") == -1).over(v)).where("kind = 1").select(*case, "offset", "gone")
    rows = far.where("kind = 1").join(gone, [*case, "offset"]).withColumn("open", F.col("begun") - F.col("gone"))
    one = rows.where("open <= 1").select(*case, "offset", F.when((F.col("open") == 1) & (F.col("ends") > F.col("offset")), F.col("last")).alias("field"), "open")
    # rare: where spans overlap, or the last one to begin has ended and an earlier one runs on, look at all of the case's spans
    hard = rows.where("open > 1").select(*case, "offset", "open").unionByName(one.where("open = 1 and field is null").select(*case, "offset", "open"))
    looked = hard.join(spans, case).where("begin <= offset and offset < finish").groupBy(*case, "offset", "open").agg(F.min("field").alias("field"))
    out = one.where("open = 0 or field is not null").unionByName(looked.select(*case, "offset", "field", "open"))
    return out.select(*case, "offset", F.coalesce("field", F.concat(F.lit("$nonvalue-byte:"), F.col("offset").cast("string"))).alias("field"), (F.col("open") > 1).alias("overlap"))


def decode_tokens(answers: DataFrame, index: DataFrame, token: str) -> DataFrame:
    """Answers' tokens as source coordinates where exactly one has the token, else ``unknown-token``."""
    out = unique_join(answers, index, [token])
    return out.withColumn("source", F.when(F.col("status") == "matched", F.col("source")).otherwise(F.lit("unknown-token"))).drop("status")


def cell(value, file, record, field):
    """A value with the place that it came from."""
    return F.struct(value.alias("value"), F.lit(file).alias("file"), record.alias("record"), F.lit(field).alias("field"))


def with_cells(table: DataFrame, file: int, record: str) -> DataFrame:
    """Every column, but the record number, as a cell of that file."""
    return table.select(F.col(record), *[cell(F.col(c), file, F.col(record), k) for k, c in enumerate(table.columns) if c != record]).toDF(record, *[c for c in table.columns if c != record])


def cell_project(cells: DataFrame, columns: list[str], complement: bool = False) -> DataFrame:
    """Chosen columns, or all others, with their cells' places."""
    return cells.select(*([c for c in cells.columns if c not in columns] if complement else columns))


def cut_lines(lines: DataFrame, file: int, record: str, line: str, delimiter: str, fields: list[int], complement: bool = False, only_delimited: bool = False) -> DataFrame:
    """Chosen fields (numbered from 0), or all others, of delimited lines: record, ``cells`` in field order, ``whole``.

    A line without the delimiter passes as one cell, ``whole``, or is left out if ``only_delimited``. Delimiters have no source.
    """
    parts = F.transform(F.split(F.col(line), F.lit(f"\\Q{delimiter}\\E"), -1), lambda v, k: F.struct(v.alias("value"), F.lit(file).alias("file"), F.col(record).alias("record"), k.alias("field")))
    has = F.contains(F.col(line), F.lit(delimiter))
    chosen = F.filter(parts, lambda c: ~c["field"].isin(fields) if complement else c["field"].isin(fields))
    rows = lines.where(has) if only_delimited else lines
    return rows.where(F.col(line).isNotNull()).select(record, F.when(has, chosen).otherwise(parts).alias("cells"), (~has).alias("whole"))


def cell_join(left: DataFrame, right: DataFrame, key: str, output: list[str], how: str = "inner", fill: str | None = None) -> DataFrame:
    """Join on the cells' values; output cells keep their places, fills have none, and keys used to match alone are no sources."""
    joined = left.join(right.withColumnRenamed(key, "__key"), left[key]["value"] == F.col("__key.value"), how)
    if fill is None:
        return joined.select(*output)
    blank = lambda c: F.struct(F.lit(fill).alias("value"), F.lit(None).cast("int").alias("file"), F.lit(None).cast("long").alias("record"), F.lit(None).cast("int").alias("field"))
    return joined.select(*[F.coalesce(F.col(c), blank(c)).alias(c) if c in right.columns and c != key else F.col(c) for c in output])


def reduction_lineage(members: DataFrame, results: DataFrame, result: str, tolerance: float = 1e-6) -> DataFrame:
    """Each result's ``status`` (matched, missing, membership, total, unknown) from members (member, quantity, unit_price, source) and declared size and total."""
    sums = members.groupBy(result).agg(F.count("*").alias("n"), F.count_distinct("member").alias("distinct_n"), F.sum(F.col("quantity") * F.col("unit_price")).alias("computed"), F.count_if(F.col("source").isNull()).alias("unresolved"))
    joined = results.join(sums, result, "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("unresolved") > 0, "unknown").when((F.col("n") != F.col("declared")) | (F.col("distinct_n") != F.col("n")), "membership").when(F.abs(F.col("computed") - F.col("total")) > tolerance * F.greatest(F.lit(1.0), F.abs("total")), "total").otherwise("matched")
    return joined.select(result, status.alias("status"))


def reduction_sources(members: DataFrame, statuses: DataFrame, result: str) -> DataFrame:
    """The sources (result, source) of every matched total: the distinct coordinates of its members' quantity and price."""
    good = statuses.where("status = 'matched'").select(result)
    return members.join(good, result, "left_semi").select(result, "source").where("source is not null").distinct()


def private_range_conflicts(objects: DataFrame, bucket: int, width: int = 1) -> DataFrame:
    """Pairs of different requests whose objects overlap in lifetime (born, died) and in address (low, high).

    A grid of two dimensions, whose cells follow the objects' own extents: levels of time and of address, each a power of two
    times ``bucket`` and ``width``, so an object touches two cells of its level in each dimension. Two objects meet in the
    grid of the longer lifetime and the wider range, in the one cell where the later begins and the higher starts. In a grid
    an object is native in a dimension if its level there is the grid's; only pairs with a native in each dimension meet.

    Two objects meet once, so only requests with several objects can give a pair twice; other pairs are not shuffled.
    """
    rows = objects.where("born < died and low < high").select("request", *[F.col(c).cast("long").alias(c) for c in ("born", "died", "low", "high")])
    rows = rows.withColumns({"time": level_of(F.col("died") - F.col("born"), bucket), "space": level_of(F.col("high") - F.col("low"), width)})
    repeated = materialize(rows.groupBy("request").count().where("count > 1").select("request"), "repeated")
    rows = rows.withColumn("many", F.lit(False)) if repeated.isEmpty() else rows.join(repeated.withColumn("many", F.lit(True)), "request", "left").fillna(False, ["many"])
    above = lambda own, level: F.explode(F.filter(levels_in(rows, own), lambda k: k >= F.col(own))).alias(level)
    span = lambda lo, hi, size, level: F.explode(F.sequence(F.expr(f"floor({lo} / shiftleft(bigint({size}), {level}))"), F.expr(f"floor(({hi} - 1) / shiftleft(bigint({size}), {level}))")))
    grid = rows.select("*", above("time", "grid_time")).select("*", above("space", "grid_space"))
    grid = grid.select("*", span("born", "died", bucket, "grid_time").alias("cell_time")).select("*", span("low", "high", width, "grid_space").alias("cell_space"))
    at = ["grid_time", "grid_space", "cell_time", "cell_space"]
    values = ["request", "born", "died", "low", "high", "many"]
    natives = F.expr("time = grid_time"), F.expr("space = grid_space")
    side = lambda where, name: grid.where(where).select(*at, *[F.col(c).alias(f"{c}{name}") for c in values], *([(natives[0] & natives[1]).alias("both2")] if name else []))
    meet = f"""request != request2 and greatest(born, born2) < least(died, died2) and greatest(low, low2) < least(high, high2)
        and floor(greatest(born, born2) / shiftleft(bigint({bucket}), grid_time)) = cell_time and floor(greatest(low, low2) / shiftleft(bigint({width}), grid_space)) = cell_space"""
    whole = side(natives[0] & natives[1], "").join(side(F.lit(True), "2").hint("merge"), at).where(f"{meet} and (not both2 or request < request2)")
    crossed = side(natives[0] & ~natives[1], "").join(side(~natives[0] & natives[1], "2").hint("merge"), at).where(meet)
    met = whole.unionByName(crossed)
    pair = [F.least("request", "request2").alias("first"), F.greatest("request", "request2").alias("second")]
    if repeated.isEmpty():
        return met.select(*pair)
    return met.where("not (many or many2)").select(*pair).unionByName(met.where("many or many2").select(*pair).distinct())
