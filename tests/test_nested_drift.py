"""Nested records and drifting schemas on small written fixtures."""

import json
from datetime import datetime

from meshwright.operators import drift, nested

T = [datetime(2020, 1, k + 1) for k in range(5)]


def flat(spark, rows):
    df = spark.createDataFrame([(i, t, p, "clash", 1) for i, t, p in rows], "record_id long, delivered_at timestamp, payload string, entity string, items int")
    return {(r["record_id"], r["entity"], r["position"], r["parent"]) for r in nested.flatten(df).collect()}


def test_ways_of_writing_lists(spark):
    stage = {"stage": "a", "elapsed": 1.0}
    record = {
        "attempts": {
            "0": {"stage_seconds": json.dumps([stage, None, {"stage": "b", "parts": {"1": stage, "0": stage}}]), "diagnosis": {"failure_class": "H1", "margins": {"vertex": 3}}},
            "2": {"stage_seconds": {"stage": "c", "parts": [None, stage]}, "diagnosis": json.dumps({"margins": [None, {"vertex": 1}]})},
        },
        "metadata": {"selection": json.dumps({"candidates": [{"epoch": 1}, None, {"epoch": 3}]})},
    }
    want = {
        (1, "record", "", None), (1, "candidate", "0", ""), (1, "candidate", "2", ""), (1, "attempt", "0", ""), (1, "attempt", "2", ""),
        (1, "stage", "0/0", "0"), (1, "stage", "0/2", "0"), (1, "stage", "0/2/0", "0/2"), (1, "stage", "0/2/1", "0/2"), (1, "stage", "2/0", "2"), (1, "stage", "2/0/1", "2/0"),
        (1, "margin", "0/0", "0"), (1, "margin", "2/1", "2"),
    }
    assert flat(spark, [(1, T[0], json.dumps(record)), (1, T[1], json.dumps(json.dumps(record)))]) == want


def test_last_readable_delivery(spark):
    one, two = json.dumps({"attempts": [{}]}), json.dumps({"attempts": [{}, {}]})
    rows = [(1, T[2], one[:-3]), (1, T[1], two), (1, T[0], one), (2, T[0], None), (3, T[0], "[1]"), (4, None, two), (4, T[0], one), (5, T[0], "{}"), (5, T[0], "{}"), (6, T[0], "")]
    got = flat(spark, rows)
    assert {p for i, e, p, _ in got if i == 1 and e == "attempt"} == {"0", "1"}
    assert {i for i, *_ in got} == {1, 4, 5}
    assert {p for i, e, p, _ in got if i == 4 and e == "attempt"} == {"0"}
    assert flat(spark, []) == set()


def test_deep_and_long_records(spark):
    deep = {"stage": "x"}
    for _ in range(60):
        deep = {"stage": "x", "parts": [deep]}
    got = flat(spark, [(1, T[0], json.dumps({"attempts": [{"stage_seconds": [deep], "note": "z" * 200_000}]}))])
    assert max(p.count("/") for _, e, p, _ in got if e == "stage") == 61


def test_typed_tables_and_tagged_write(spark, tmp_path):
    df = spark.createDataFrame([(1, T[0], json.dumps({"job_id": "j", "attempts": [{"status": "OK", "peak_tree_rss_bytes": "many"}], "metadata": {"selection": "rule"}}))], "record_id long, delivered_at timestamp, payload string")
    f = nested.flatten(df)
    assert nested.entity_table(f, "attempt").first().asDict() == {"record_id": 1, "position": "0", "parent": "", "status": "OK", "peak_tree_rss_bytes": None, "schema_version": None, "failure_class": None}
    assert nested.entity_table(f, "record").first()["selection"] == "rule"
    nested.write_entities(f, str(tmp_path / "e"))
    assert nested.entity_table(spark.read.parquet(str(tmp_path / "e")), "attempt").count() == 1


def changes(spark, files):
    """``files``: per stream a list of files, each a list of records or raw lines."""
    fs, lines, at = [], [], 0
    for s, seq in files.items():
        for k, rows in enumerate(seq):
            at += 1
            fs.append((at, s, k + 1, 9))
            lines += [(at, i, r if isinstance(r, (str, type(None))) else json.dumps(r), "clash") for i, r in enumerate(rows)]
    f = spark.createDataFrame(fs, "file_id long, stream string, seq_no int, value int")
    ln = spark.createDataFrame(lines, "file_id long, line_no int, payload string, path string")
    return f, ln, {tuple(r) for r in drift.changes(f, ln).collect()}


def test_changes(spark):
    first = [{"record_id": i, "a": {"x": i, "y": f"v{i}"}, "b": True, "c": i * 2, "old": [i]} for i in range(6)]
    again = [{"record_id": i, "a": {"z": i, "y": f"v{i}"}, "b": "true", "c": i * 2, "new": i} for i in range(4, 9)]
    case = [{"record_id": i, "a": {"Z": i, "y": None}, "b": "true", "c": i * 2, "new": i} for i in range(7, 12)]
    f, ln, got = changes(spark, {"s": [first, again + ["# note", "", None, '{"cut": '], case, []], "t": [[{"record_id": 1, "q": 1}], [{"record_id": 2, "q": 1, "p": 2.5}]]})
    assert got == {
        (2, "renamed", "a.x", "a.z"), (2, "retyped", "b", "b"), (2, "removed", "old", ""), (2, "added", "", "new"),
        (3, "renamed", "a.z", "a.Z"), (3, "removed", "a.y", ""),
        (4, "removed", "record_id", ""), (4, "removed", "a.Z", ""), (4, "removed", "b", ""), (4, "removed", "c", ""), (4, "removed", "new", ""),
        (6, "added", "", "p"),
    }
    rows = drift.unified(f, ln, drift.changes(f, ln)).where("file_id = 3").first()
    assert rows["fields"]["a.x"] == str(rows["record_id"]) and "a.Z" not in rows["fields"]


def test_matching_picks_the_likelier_of_equal_values(spark):
    old = [{"record_id": i, "run_time": i, "other": i} for i in range(4)]
    new = [{"record_id": i, "runTime": i, "else": i} for i in range(4)]
    _, _, got = changes(spark, {"s": [old, new]})
    assert got == {(2, "renamed", "run_time", "runTime"), (2, "renamed", "other", "else")}


def test_values_that_change_are_no_rename(spark):
    old = [{"record_id": i, "x": i} for i in range(4)]
    new = [{"record_id": i, "y": i if i else 9} for i in range(4)]
    assert changes(spark, {"s": [old, new]})[2] == {(2, "removed", "x", ""), (2, "added", "", "y")}


def test_no_files(spark):
    f = spark.createDataFrame([], "file_id long, stream string, seq_no int")
    assert drift.changes(f, spark.createDataFrame([], "file_id long, payload string")).count() == 0
