"""Packets, streams and HTTP framing on small hand-made captures."""

import gzip
import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.operators import network
from spanloom.sources.packets import read_pcap


def frame(src, dst, seq, data=b"", flags=16, fragment=0, version=4):
    """A frame from 192.0.2.7 to 198.51.100.9, field by field."""
    fields = [(2, src), (2, dst), (4, seq), (4, 77), (1, 0x50), (1, flags), (2, 512), (2, 0), (2, 0)]
    segment = b"".join(value.to_bytes(size, "big") for size, value in fields) + data
    fields = [(1, version * 16 + 5), (1, 0), (2, 20 + len(segment)), (2, 9), (2, fragment), (1, 60), (1, 6), (2, 0)]
    packet = b"".join(value.to_bytes(size, "big") for size, value in fields) + bytes([192, 0, 2, 7, 198, 51, 100, 9]) + segment
    return bytes(range(12)) + (0x0800).to_bytes(2, "big") + packet


def opening(magic=0xA1B2C3D4, major=2, minor=4, zone=0, most=262_144, link=1):
    return struct.pack("<IHHIIII", magic, major, minor, zone, 0, most, link)


def capture(frames):
    return opening() + b"".join(struct.pack("<IIII", k, 5, len(f), len(f)) + f for k, f in enumerate(frames))


def test_pcap(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([frame(1000, 80, 7, flags=2), frame(1000, 80, 8, b"GET"), b"\0" * 12 + b"\x08\x06" + b"arp", b"x", frame(1, 2, 3, fragment=0x2000), frame(1, 2, 3, fragment=5), frame(1, 2, 3, fragment=0x4000), frame(1, 2, 3, version=6)]))
    (tmp_path / "b.pcap").write_bytes(b"other")
    (tmp_path / "c.pcap").write_bytes(capture([frame(1, 2, 3)])[:-3])
    rows = sorted(read_pcap(spark, str(tmp_path)).collect(), key=lambda r: (r.file, r.number or 0))
    assert [(r.number, r.issue) for r in rows] == [(0, None), (1, None), (3, "short_frame"), (4, "fragment"), (5, "fragment"), (6, None), (None, "not_a_capture"), (0, "truncated")]
    assert (rows[1].src, rows[1].dst, rows[1].seq, bytes(rows[1].data), rows[1].time_us) == ("192.0.2.7:1000", "198.51.100.9:80", 8, b"GET", 1_000_005)
    assert rows[0].syn and not rows[1].syn


def test_refused_captures(spark, tmp_path):
    """Headers that are not the one form, cut packets and sizes beyond belief are rows, and what stands before them is read."""
    heads = {"link": opening(link=113), "version": opening(minor=3), "zone": opening(zone=1), "size": opening(most=1 << 20), "order": opening()[:4][::-1] + opening()[4:], "short": opening()[:20], "none": opening()}
    for name, head in heads.items():
        (tmp_path / f"{name}.pcap").write_bytes(head)
    good, cut = frame(1, 2, 3), frame(1, 2, 3, b"abc")
    record = lambda f, original, size=None: struct.pack("<IIII", 1, 2, len(f) if size is None else size, original) + f
    (tmp_path / "cut.pcap").write_bytes(opening() + record(good, len(good)) + record(cut[:-1], len(cut)) + record(good, len(good)))
    (tmp_path / "large.pcap").write_bytes(opening() + record(good, len(good)) + record(good, 1 << 20, 1 << 20))
    (tmp_path / "tail.pcap").write_bytes(opening() + record(good, len(good)) + b"\0" * 9)
    got = {(r.file.rsplit("/", 1)[1][:-5], r.number, r.issue) for r in read_pcap(spark, str(tmp_path)).collect()}
    assert got == {("link", None, "bad_link_type"), ("version", None, "bad_version"), ("zone", None, "bad_version"), ("size", None, "bad_packet_size"), ("order", None, "not_a_capture"), ("short", None, "not_a_capture"),
                   ("cut", 0, None), ("cut", 1, "cut_packet"), ("cut", 2, None), ("large", 0, None), ("large", 1, "oversized"), ("tail", 0, None), ("tail", 1, "truncated")}


def test_one_capture_in_many_tasks(spark, tmp_path):
    frames = [frame(1000, 80, 7 + k, b"x" * (k % 50)) for k in range(400)]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    rows = read_pcap(spark, str(tmp_path), split_bytes=3000).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.number, r.seq, len(r.data), r.time_us) for r in rows) == [(k, 7 + k, k % 50, k * 1_000_000 + 5) for k in range(400)]
    assert len({r.task for r in rows}) > 3


def test_times_of_messages(spark):
    """Retransmitted bytes count when they came first; a response that ends before its request begins is refused."""
    asked, told = b"GET /a HTTP/1.1\r\n\r\nGET /b HTTP/1.1\r\n\r\n", b"HTTP/1.1 204 x\r\n\r\n" * 2
    half, part = len(asked) // 2, len(told) // 2

    def packets(c, side, data, cut, times):
        rows = [(c, side, 100, True, False, b"", 0, 0), (c, side, 101, False, False, data[:cut], times[0], 1), (c, side, 101, False, False, data[:cut], times[0] + 1000, 2), (c, side, 101 + cut, False, False, data[cut:], times[1], 3)]
        return rows

    rows = packets(1, "request", asked, half, (10, 30)) + packets(1, "response", told, part, (20, 40)) + packets(2, "request", asked, half, (10, 30)) + packets(2, "response", told, part, (20, 25)) + packets(3, "request", asked, half + 5, (10, 30)) + packets(3, "response", told, part, (35, 40))
    df = spark.createDataFrame(rows, "c int, side string, seq long, syn boolean, fin boolean, data binary, time_us long, number long")
    streams = network.reassemble(df, ["c", "side"])
    sides = [streams.where(f"side = '{s}'").selectExpr("c", f"stream as {s}_stream", f"pieces as {s}_pieces") for s in ("request", "response")]
    got = network.http_transactions(sides[0].join(sides[1], "c"), ["c"]).collect()
    facts = {(r.c, r.position): (r.issue, r.request_start_us, r.request_end_us, r.response_start_us, r.response_end_us, r.request_packets) for r in got}
    assert facts == {(1, 0): (None, 10, 10, 20, 20, [1]), (1, 1): (None, 30, 30, 40, 40, [3]), (2, 0): (None, 10, 10, 20, 20, [1]), (2, 1): ("response_before_request", None, None, None, None, None),
                     (3, 0): (None, 10, 10, 35, 35, [1]), (3, 1): (None, 10, 30, 40, 40, [1, 3])}


def stream(*parts, isn=2**32 - 3, fin=()):
    rows = [(isn, True, False, b"")] + [((isn + 1 + at) % 2**32, False, at in fin, data) for at, data in parts]
    return network.join_segments(pd.DataFrame(rows, columns=["seq", "syn", "fin", "data"]))


def test_segments():
    assert stream((4, b"efgh"), (0, b"abcd"), (2, b"cdef")) == (b"abcdefgh", None)
    assert stream((0, b"abcdef"), (1, b"bc")) == (b"abcdef", None)
    assert stream((0, b"abcd"), (2, b"xx"))[1] == "conflict"
    assert stream((0, b"abcd"), (5, b"x"))[1] == "gap"
    assert stream((0, b"abcd"), (2, b"cd"), fin={2}) == (b"abcd", None)
    assert stream((0, b"abcd"), (1, b"b"), fin={1})[1] == "fin_mismatch"
    assert stream() == (b"", None)
    opening = pd.DataFrame([(9, True, False, b"ab"), (12, False, True, b"cd")], columns=["seq", "syn", "fin", "data"])
    assert network.join_segments(opening) == (b"abcd", None)  # data on the opening packet is the stream's begin


def test_http(spark):
    asked = b"POST /a HTTP/1.1\r\ncontent-length: 2\r\n\r\nhiGET /b HTTP/1.1\r\n\r\n"
    body = gzip.compress(b"packed")
    told = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\nHTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Length: %d\r\n\r\n%b" % (len(body), body)
    df = spark.createDataFrame([(1, asked, told), (2, asked, told[:-1]), (3, asked, None), (4, None, None)], "c int, request_stream binary, response_stream binary")
    rows = sorted(network.http_transactions(df, ["c"]).collect(), key=lambda r: (r.c, r.position or 0))
    assert [(r.c, r.position, r.issue) for r in rows] == [(1, 0, None), (1, 1, None), (2, None, "broken_message"), (3, None, "unequal_counts")]
    assert [bytes(r.response_body) for r in rows[:2]] == [b"abcde", b"packed"] and bytes(rows[0].request_body) == b"hi"


OK = b"HTTP/1.1 200 OK\r\n"
BROKEN = [
    OK + b"Content-Length: -39\r\n\r\n", OK + b"Content-Length: +1\r\n\r\nx", OK + b"Content-Length: 9000000000\r\n\r\n", OK + b"Content-Length: 5\r\n\r\nabc",
    OK + b"Content-Length: 1\r\nContent-Length: 1\r\n\r\nx", OK + b"Content-Length: 1\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nx\r\n0\r\n\r\n",
    OK + b"\r\nabc", OK + b"no colon\r\n\r\n", OK + b"Transfer-Encoding: gzip\r\n\r\n", OK + b"Transfer-Encoding: chunked\r\n\r\n-1\r\nx\r\n0\r\n\r\n",
    OK + b"Transfer-Encoding: chunked\r\n\r\n3\r\nabcXX0\r\n\r\n", OK + b"Transfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n", OK + b"Content-Encoding: br\r\nContent-Length: 1\r\n\r\nx",
    OK + b"Content-Encoding: gzip\r\nContent-Length: 1\r\n\r\nx", b"HTTP/2 200 OK\r\nContent-Length: 0\r\n\r\n", b"HTTP/1.1 abc\r\nContent-Length: 0\r\n\r\n",
]


def test_framing():
    """Bounds that are not plain are refused, never guessed, and no message keeps the reader in place."""
    for raw in BROKEN:
        with pytest.raises((ValueError, zlib.error)):
            network.messages(raw, True)
    for raw in (b"HEAD /a HTTP/1.1\r\n\r\n", b"GET /a\r\n\r\n", b"GET /a HTTP/2\r\n\r\n", b"GET /a HTTP/1.1\r\nContent-Length: 3\r\n\r\nab"):
        with pytest.raises(ValueError):
            network.messages(raw, False)
    good = b"HTTP/1.1 204 None\r\nContent-Length: 7\r\n\r\nHTTP/1.1 304 Same\r\n\r\nHTTP/1.0 100 Go\r\n\r\n" + OK + b"Transfer-Encoding: Chunked\r\n\r\n2;a=b\r\nhi\r\n0\r\nX: y\r\nZ: z\r\n\r\n"
    assert [b for _, b in network.messages(good, True)] == [b"", b"", b"hi"]
    packed = gzip.compress(b"x" * (network.MAX_STREAM + 1))
    with pytest.raises(ValueError):
        network.messages(OK + b"Content-Encoding: gzip\r\nContent-Length: %d\r\n\r\n%b" % (len(packed), packed), True)
