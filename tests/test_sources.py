"""Readers and writers on files made here."""

import hashlib
import json

from spanloom import scratch
from spanloom.sources import files

SPAN = {"traceId": "t", "id": "a", "parentId": None, "name": "n", "kind": "SERVER", "localEndpoint": {"serviceName": "s"}, "timestamp": 5, "duration": 7, "tags": {"http.method": "get"}}


def test_read_spans(spark, tmp_path):
    (tmp_path / "spans.json").write_text(json.dumps([SPAN]))
    assert [tuple(r)[:8] for r in files.read_spans(spark, str(tmp_path)).collect()] == [("t", "a", None, "n", "SERVER", "s", 5, 7)]
    (tmp_path / "spans-final.json").write_text(json.dumps([SPAN | {"id": "b"}, SPAN | {"id": "c", "localEndpoint": None}]))
    rows = files.read_spans(spark, str(tmp_path)).collect()
    assert sorted((r.span, r.service, r.tags["http.method"]) for r in rows) == [("b", "s", "get"), ("c", None, "get")]


def test_events_digests_reports(spark, tmp_path):
    (tmp_path / "front.jsonl").write_text('{"seq": 1, "kind": "x"}\n{"seq": 2}\n')
    (tmp_path / "back.jsonl").write_text('{"seq": 1, "kind": "y"}\n')
    rows = files.read_events(spark, str(tmp_path / "*.jsonl"), "seq long, kind string").collect()
    assert sorted((r.role, r.seq, r.kind or "") for r in rows) == [("back", 1, "y"), ("front", 1, "x"), ("front", 2, "")]
    digests = files.file_digests(spark, str(tmp_path))
    want = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("front.jsonl", "back.jsonl")}
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in digests.collect()} == want
    path = {r.path.rsplit("/", 1)[1]: r.path for r in digests.collect()}
    expected = spark.createDataFrame([(path["front.jsonl"], "0"), ("gone", "1")], "path string, sha256 string")
    assert {tuple(r) for r in files.verify_manifest(digests, expected).collect()} == {(path["front.jsonl"], "changed"), ("gone", "missing"), (path["back.jsonl"], "extra")}
    for kind in ("parquet", "json", "csv"):
        files.write_report(spark.range(4).selectExpr("id", "id % 2 as half"), str(tmp_path / kind), kind, ["half"])
        reader = spark.read.option("header", "true") if kind == "csv" else spark.read
        assert sorted(int(r.id) for r in reader.format(kind).load(str(tmp_path / kind)).where("half = 1").collect()) == [1, 3]


def test_scratch_tables_are_cleared(spark):
    import os

    scratch.materialize(spark.range(3), "some")
    table = scratch.materialize_bucketed(spark.range(3), "id", 2, "some")
    paths = [p.removeprefix("file://") for p in scratch._PATHS]
    assert table.count() == 3 and all(map(os.path.isdir, paths[-2:]))
    scratch.clear(spark)
    assert not any(map(os.path.exists, paths)) and not scratch._PATHS
