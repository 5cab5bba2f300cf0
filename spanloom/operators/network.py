"""Connections, byte streams and HTTP exchanges from packets."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A longer stream becomes an issue row.
MAX_STREAM = 8 << 20
TURN = 1 << 32


def assign_connections(packets: DataFrame, servers: DataFrame) -> DataFrame:
    """Packets with ``side`` (request towards the server, else response) and ``connection`` (count of new initial numbers on the endpoints so far).

    ``packets`` has number, src, dst, seq, syn, fin, data; ``servers`` has endpoint. Packets between unknown endpoints are left
    out of no count: they get a null side.
    """
    known = servers.select("endpoint").distinct()
    rows = packets.join(known.select(F.col("endpoint").alias("dst"), F.lit(True).alias("to_server")), "dst", "left").join(known.select(F.col("endpoint").alias("src"), F.lit(True).alias("from_server")), "src", "left")
    rows = rows.withColumn("side", F.when(F.col("to_server"), "request").when(F.col("from_server"), "response"))
    rows = rows.withColumn("client", F.when(F.col("side") == "request", F.col("src")).otherwise(F.col("dst"))).withColumn("server", F.when(F.col("side") == "request", F.col("dst")).otherwise(F.col("src")))
    w = Window.partitionBy("client", "server").orderBy("number")
    opening = F.when(F.col("syn") & (F.col("side") == "request"), F.col("seq"))
    before = F.last(opening, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.coalesce((opening.isNotNull() & ~opening.eqNullSafe(before)).cast("int"), F.lit(0)))
    return rows.withColumn("connection", F.sum("__new").over(w)).drop("__new", "to_server", "from_server")


def assemble(pdf: pd.DataFrame) -> tuple[bytes | None, str | None, list[dict]]:
    """The bytes of one side, or why there are none, and which packet gave which bytes first.

    Order is by offset from the opening number, which may wrap; packets at one offset count in order of time.
    """
    first = set(pdf.seq[pdf.syn])
    if len(first) != 1:
        return None, "missing_syn" if not first else "many_syn", []
    start = first.pop() + 1
    # an opening packet takes one number itself, so data that it carries begins where the stream does
    stamps = zip(pdf.time_us, pdf.number, strict=True) if "time_us" in pdf else ((0, 0) for _ in pdf.seq)
    parts = sorted(((int(s) + bool(syn) - start) % TURN, *stamp, d) for s, syn, d, stamp in zip(pdf.seq, pdf.syn, pdf.data, stamps, strict=True) if d)
    out, pieces = bytearray(), []
    for at, time_us, packet, data in parts:
        if at > len(out):
            return None, "gap", []
        if at + len(data) > MAX_STREAM:
            return None, "too_long", []
        shared = len(out) - at
        if out[at : at + len(data)] != data[:shared]:
            return None, "conflict", []
        if shared < len(data):
            pieces.append({"start": len(out), "end": at + len(data), "time_us": int(time_us), "packet": int(packet)})
        out += data[shared:]
    ends = {(int(s) + len(d or b"") - start) % TURN for s, d in zip(pdf.seq[pdf.fin], pdf.data[pdf.fin], strict=True)}
    return (None, "fin_mismatch", []) if ends - {len(out)} else (bytes(out), None, pieces)


def join_segments(pdf: pd.DataFrame) -> tuple[bytes | None, str | None]:
    """The bytes of one side, or why there are none."""
    return assemble(pdf)[:2]


PIECES = "array<struct<start: bigint, end: bigint, time_us: bigint, packet: bigint>>"


def reassemble(packets: DataFrame, connection: list[str]) -> DataFrame:
    """Byte streams of each connection and side: connection, ``stream``, ``issue``; never part of a stream.

    Where packets have ``time_us`` and ``number``, ``pieces`` says which bytes of the stream came when, by which packet.
    """
    kinds = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
    timed = ["time_us", "number"] if {"time_us", "number"} <= kinds.keys() else []

    def one(key, pdf):
        stream, issue, pieces = assemble(pdf)
        return pd.DataFrame([[*key, stream, issue, *([pieces] if timed else [])]], columns=[*connection, "stream", "issue", *(["pieces"] if timed else [])])

    return packets.select(*connection, "seq", "syn", "fin", "data", *timed).groupBy(*connection).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in connection) + ", stream binary, issue string" + (f", pieces {PIECES}" if timed else ""))


METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS")


class Framing(ValueError):
    """Why a message's bounds are not known; never a guess."""


def length_of(text: str, base: int = 10) -> int:
    """A size of digits alone, up to the bound of streams."""
    size = int(text, base) if text and all(c in "0123456789abcdefABCDEF"[: 10 if base == 10 else 22] for c in text) else -1
    if not 0 <= size <= MAX_STREAM:
        raise Framing("bad size")
    return size


def take(raw: bytes, at: int, size: int) -> tuple[bytes, int]:
    if at + size > len(raw):
        raise Framing("truncated")
    return raw[at : at + size], at + size


def until(raw: bytes, at: int, mark: bytes) -> tuple[bytes, int]:
    """What stands before the next mark, and the place behind it."""
    stop = raw.find(mark, at)
    if stop < 0:
        raise Framing("truncated")
    return raw[at:stop], stop + len(mark)


def chunks_of(raw: bytes, at: int) -> tuple[bytes, int]:
    """The body of a chunked message; each chunk must end in a line end, the last may have trailers."""
    parts, total = [], 0
    while True:
        line, at = until(raw, at, b"\r\n")
        size = length_of(line.split(b";")[0].strip().decode("latin-1"), 16)
        if not size:
            while line:
                line, at = until(raw, at, b"\r\n")
            return b"".join(parts), at
        part, at = take(raw, at, size)
        end, at = take(raw, at, 2)
        total += size
        if end != b"\r\n" or total > MAX_STREAM:
            raise Framing("bad chunk")
        parts.append(part)


def headers_of(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        name = name.lower()
        if not colon or (name in out and name in ("content-length", "transfer-encoding")):
            raise Framing("bad header")
        out[name] = value.strip()
    if "content-length" in out and "transfer-encoding" in out:
        raise Framing("two lengths")
    return out


def status_of(first: str) -> int:
    version, _, rest = first.partition(" ")
    code = rest[:3]
    if not version.startswith("HTTP/1.") or not code.isdigit() or len(code) != 3:
        raise Framing("bad status line")
    return int(code)


def check_request(first: str) -> None:
    words = first.split(" ")
    if len(words) != 3 or words[0] not in METHODS or not words[2].startswith("HTTP/1."):
        raise Framing("bad request line")


def unpacked(body: bytes, coding: str) -> bytes:
    """The body without its content coding, up to the bound."""
    if not body or coding == "identity":
        return body
    if coding != "gzip":
        raise Framing("unknown coding")
    inflate = zlib.decompressobj(31)
    out = inflate.decompress(body, MAX_STREAM + 1)
    if len(out) > MAX_STREAM or not inflate.eof:
        raise Framing("bad gzip body")
    return out


def read_message(raw: bytes, at: int, response: bool) -> tuple[str, bytes, int]:
    """First line, body and end of the message at a place; where its bounds are not plain, Framing is raised."""
    head, at = until(raw, at, b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    named = headers_of(lines)
    status = status_of(first) if response else check_request(first)
    coding = named.get("transfer-encoding")
    if response and (status < 200 or status in (204, 304)):
        body = b""
    elif coding is not None:
        if coding.lower() != "chunked":
            raise Framing("unknown coding")
        body, at = chunks_of(raw, at)
    elif "content-length" in named:
        body, at = take(raw, at, length_of(named["content-length"]))
    elif response:
        raise Framing("ends with the connection")
    else:
        body = b""
    return first, unpacked(body, named.get("content-encoding", "identity").lower()), at


def framed(raw: bytes, response: bool) -> list[tuple[str, bytes, int, int]]:
    """First lines, bodies, begins and ends of a stream's messages, interim answers left out."""
    out, at = [], 0
    while at < len(raw):
        begin = at
        first, body, at = read_message(raw, at, response)
        if not (response and status_of(first) < 200):
            out.append((first, body, begin, at))
    return out


def messages(raw: bytes, response: bool) -> list[tuple[str, bytes]]:
    """First lines and bodies of a stream, interim answers left out."""
    return [m[:2] for m in framed(raw, response)]


def seen(pieces: list, begin: int, end: int) -> list:
    """When the packets that gave the bytes from begin to end came first and last, and their numbers."""
    held = [p for p in pieces[bisect_right([p["end"] for p in pieces], begin) :] if p["start"] < end]
    if not held:
        raise Framing("no packet")
    return [min(p["time_us"] for p in held), max(p["time_us"] for p in held), sorted({p["packet"] for p in held})]


def http_transactions(streams: DataFrame, connection: list[str]) -> DataFrame:
    """Requests and responses paired in order: connection, position, request, request_body, response, response_body, issue.

    ``streams`` has connection, request_stream and response_stream. Streams that can't be framed, or with unequal counts, give one row with an issue.

    With ``request_pieces`` and ``response_pieces`` (``reassemble``), each message has start_us, end_us and packets, with its
    side as a prefix. A response that ends before its request begins is an issue row (response_before_request); pairs after it
    in the connection are not given.
    """
    kinds = {f.name: f.dataType.simpleString() for f in streams.schema.fields}
    sides = ("request", "response")
    timed = [f"{s}_pieces" for s in sides] if "request_pieces" in kinds else []
    times = {f"{s}_{c}": kind for s in sides for c, kind in (("start_us", "long"), ("end_us", "long"), ("packets", "array<bigint>"))} if timed else {}
    columns = [*connection, "position", "request", "request_body", "response", "response_body", "issue", *times]

    def pairs(r: dict) -> list[list]:
        key, blank = [r[c] for c in connection], [None] * len(times)
        issue = lambda name, at=None: [*key, at, None, None, None, None, name, *blank]
        try:
            asked, told = framed(r["request_stream"] or b"", False), framed(r["response_stream"] or b"", True)
            when = [[seen(r[c], *m[2:]) for m in side] for c, side in zip(timed, (asked, told), strict=True)] if timed else []
        except (ValueError, zlib.error):
            return [issue("broken_message")]
        if len(asked) != len(told):
            return [issue("unequal_counts")]
        rows = []
        for k, (a, b) in enumerate(zip(asked, told, strict=True)):
            if timed and when[1][k][1] < when[0][k][0]:
                return [*rows, issue("response_before_request", k)]
            rows.append([*key, k, *a[:2], *b[:2], None, *(when[0][k] + when[1][k] if timed else [])])
        return rows

    def part(batches):
        for pdf in batches:
            kept = pd.DataFrame([row for r in pdf.to_dict("records") for row in pairs(r)], columns=columns)
            yield kept.astype({"position": "Int32"} | {c: "Int64" for c, kind in times.items() if kind == "long"})

    schema = ", ".join(f"{c} {kinds[c]}" for c in connection) + ", position int, request string, request_body binary, response string, response_body binary, issue string" + "".join(f", {c} {kind}" for c, kind in times.items())
    return streams.select(*connection, "request_stream", "response_stream", *timed).mapInPandas(part, schema)
