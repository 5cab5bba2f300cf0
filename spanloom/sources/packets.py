"""Packets of capture files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..scratch import materialize

SCHEMA = "file string, number long, time_us long, src string, dst string, seq long, ack long, syn boolean, fin boolean, data binary, issue string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


#: Fixed parts of the three headers, field by field in network order.
ETHERNET = np.dtype([("to", "V6"), ("from", "V6"), ("kind", ">u2")])
IPV4 = np.dtype([("version_words", "u1"), ("service", "u1"), ("total", ">u2"), ("ident", ">u2"), ("fragment", ">u2"), ("hops", "u1"), ("protocol", "u1"), ("sum", ">u2"), ("src", "u1", 4), ("dst", "u1", 4)])
TCP = np.dtype([("src", ">u2"), ("dst", ">u2"), ("seq", ">u4"), ("ack", ">u4"), ("words", "u1"), ("flags", "u1"), ("window", ">u2"), ("sum", ">u2"), ("urgent", ">u2")])
IPV4_KIND, TCP_PROTOCOL, FIN, SYN = 0x0800, 6, 1, 2
#: The bits of ``fragment`` that say that more parts follow, or where this one belongs.
FRAGMENT_BITS = 0x3FFF


def header(kind: np.dtype, raw: bytes, name: str) -> np.void:
    if len(raw) < kind.itemsize:
        raise ValueError(f"short {name}")
    return np.frombuffer(raw, kind, 1)[0]


def payload(raw: bytes, words: int, least: int, end: int, name: str) -> bytes:
    """What stands behind a header of so many four-byte words, up to ``end``."""
    if not least <= 4 * words <= end <= len(raw):
        raise ValueError(f"bad {name} length")
    return raw[4 * words : end]


def endpoint(address: np.ndarray, port: int) -> str:
    return ".".join(map(str, address.tolist())) + f":{port}"


def tcp_fields(frame: bytes) -> list | None:
    """src, dst, seq, ack, syn, fin, data of an IPv4 TCP frame; None for other traffic, ValueError for a broken one or a fragment."""
    link = header(ETHERNET, frame, "frame")
    if link["kind"] != IPV4_KIND:
        return None
    packet = frame[ETHERNET.itemsize :]
    net = header(IPV4, packet, "packet")
    version, words = divmod(int(net["version_words"]), 16)
    if version != 4 or net["protocol"] != TCP_PROTOCOL:
        return None
    if net["fragment"] & FRAGMENT_BITS:
        raise ValueError("fragment")
    segment = payload(packet, words, IPV4.itemsize, int(net["total"]), "packet")
    tcp = header(TCP, segment, "segment")
    data = payload(segment, int(tcp["words"]) >> 4, TCP.itemsize, len(segment), "segment")
    return [endpoint(net["src"], tcp["src"]), endpoint(net["dst"], tcp["dst"]), int(tcp["seq"]), int(tcp["ack"]), bool(tcp["flags"] & SYN), bool(tcp["flags"] & FIN), data]


#: The file header: little-endian, microseconds, version 2.4, no zone or accuracy, Ethernet.
FILE_HEADER = np.dtype([("magic", "<u4"), ("major", "<u2"), ("minor", "<u2"), ("zone", "<u4"), ("accuracy", "<u4"), ("most", "<u4"), ("link", "<u4")])
RECORD = struct.Struct("<IIII")
MAGIC, ETHERNET_LINK = 0xA1B2C3D4, 1
#: Bytes of a record that are believed; a larger size is no record.
MOST_BYTES = 262_144
#: Bytes of a capture that one task decodes.
SPLIT_BYTES = 32 << 20


def header_issue(raw: bytes) -> str | None:
    """Why a file with this header is not read."""
    if len(raw) < FILE_HEADER.itemsize:
        return "not_a_capture"
    head = np.frombuffer(raw, FILE_HEADER, 1)[0]
    if head["magic"] != MAGIC:
        return "not_a_capture"
    if (head["major"], head["minor"]) != (2, 4) or head["zone"] or head["accuracy"]:
        return "bad_version"
    if head["link"] != ETHERNET_LINK:
        return "bad_link_type"
    return None if 0 < head["most"] <= MOST_BYTES else "bad_packet_size"


def open_file(path: str):
    """A file for reading at any place; in stores that pyarrow's file systems reach."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(inner)


def splits_of(path: str, split_bytes: int) -> Iterator[list]:
    """(file, begin, end, number, issue): parts of a capture that begin at records, each with the number of its first one.

    Only the records' sizes are looked at. Where no further record can be found the last part has an issue.
    """
    with open_file(path) as file:
        size = file.size()
        issue = header_issue(file.read(FILE_HEADER.itemsize))
        if issue:
            yield [path, 0, 0, None, issue]
            return
        at = begin = FILE_HEADER.itemsize
        number = first = 0
        block, block_at = b"", at
        while at < size:
            if at + RECORD.size > block_at + len(block):
                file.seek(at)
                block, block_at = file.read(1 << 20), at
            if at + RECORD.size > size:
                issue = "truncated"
                break
            length = RECORD.unpack_from(block, at - block_at)[2]
            if length > MOST_BYTES:
                issue = "oversized"
                break
            if at - begin >= split_bytes:
                yield [path, begin, at, first, None]
                begin, first = at, number
            if at + RECORD.size + length > size:
                issue = "truncated"
                break
            at, number = at + RECORD.size + length, number + 1
        if at > begin:
            yield [path, begin, at, first, None]
        if issue:
            yield [path, at, at, number, issue]


def packets_of(path: str, begin: int, end: int, number: int) -> Iterator[list]:
    """Rows of the records of one part; broken packets, and such as were cut when captured, are rows with an issue."""
    nothing = [None] * 7
    with open_file(path) as file:
        file.seek(begin)
        while begin < end:
            sec, micro, size, original = RECORD.unpack(file.read(RECORD.size))
            frame = file.read(size)
            begin += RECORD.size + size
            time_us = sec * 1_000_000 + micro
            try:
                if size != original:
                    raise ValueError("cut packet")
                fields = tcp_fields(frame)
                if fields:
                    yield [path, number, time_us, *fields, None]
            except ValueError as error:
                yield [path, number, time_us, *nothing, str(error).replace(" ", "_")]
            number += 1


def read_pcap(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row a TCP packet of the capture files below ``path``; ``number`` counts a file's records from 0.

    A task for each file walks the records' headers and cuts the file into parts of some ``split_bytes``; the parts are decoded
    by as many tasks, each reading no more than its part. Files and records that can't be read are rows with an ``issue``.
    """

    def walk(batches):
        for pdf in batches:
            for name in pdf.path:
                yield pd.DataFrame(splits_of(name, split_bytes), columns=["file", "begin", "end", "number", "issue"]).astype({"number": "Int64"})

    def decode(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                if r["issue"] is not None:
                    found = iter([[r["file"], None if pd.isna(r["number"]) else r["number"], None, *[None] * 7, r["issue"]]])
                else:
                    found = packets_of(r["file"], int(r["begin"]), int(r["end"]), int(r["number"]))
                while rows := list(islice(found, 10_000)):
                    yield pd.DataFrame(rows, columns=COLUMNS).astype({"number": "Int64", "time_us": "Int64", "seq": "Int64", "ack": "Int64", "syn": "boolean", "fin": "boolean"})

    files = spark.read.format("binaryFile").load(path).select("path")  # names alone; contents are not read here
    parts = materialize(files.repartition("path").mapInPandas(walk, "file string, begin long, end long, number long, issue string"), "parts")
    return parts.repartition(max(1, parts.count()), "file", "begin").mapInPandas(decode, SCHEMA)
