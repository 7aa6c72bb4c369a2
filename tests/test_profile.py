"""Load profiles over written Parquet files, against a plain computation."""

import random

import numpy as np
import pytest

from meshwright.operators import chunks, footers, profile

SCHEMA = "load_id long, status string, onmi double, peak_tree_rss_bytes long, number string, n int"
GOOD = 2.0**30


def write(spark, tmp_path, loads):
    """One file a load, but loads 0 and 1 share one."""
    path = str(tmp_path / "runs.parquet")
    for k, rows in loads.items():
        df = spark.createDataFrame([(k, *r, "clash", 1) for r in rows], SCHEMA).coalesce(1)
        df.write.mode("append").parquet(path)
    return path


def expected(loads, prior):
    out = set()
    for k, rows in loads.items():
        for c, col in enumerate(("status", "onmi", "peak_tree_rss_bytes")):
            v = [r[c] for r in rows]
            nn = [x for x in v if x is not None]
            ok = (lambda x: x in profile.STATUSES) if c == 0 else (lambda x: 0 <= x <= 1) if c == 1 else (lambda x: 2**20 <= x <= 2**40)
            if sum(not ok(x) for x in nn) * 50 > len(nn):
                out.add((k, col, "invalid"))
            p = prior.get(k)
            if p not in loads or not loads[p]:
                continue
            w = [r[c] for r in loads[p]]
            wn = [x for x in w if x is not None]
            if abs((len(v) - len(nn)) * len(w) - (len(w) - len(wn)) * len(v)) * 100 > 15 * len(v) * len(w):
                out.add((k, col, "nulls"))
            a, b = (len({"nan" if x != x else x for x in z}) for z in (nn, wn))
            if a > 5 * b or 5 * a < b:
                out.add((k, col, "distinct"))
            nn, wn = ([x for x in z if x == x] for z in (nn, wn))
            if not nn or not wn:
                continue
            if c == 0:
                gap = sum(abs(nn.count(x) / len(nn) - wn.count(x) / len(wn)) for x in set(nn) | set(wn)) / 2
            else:
                s, t, xs = np.sort(nn), np.sort(wn), np.array(nn + wn)
                gap = np.abs(np.searchsorted(s, xs, "right") / len(s) - np.searchsorted(t, xs, "right") / len(t)).max()
            if gap > 0.35 + 1e-12:
                out.add((k, col, "values"))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_findings(spark, tmp_path, seed):
    rng = random.Random(seed)

    def rows(n, shift=0.0, nulls=0.1, words=profile.STATUSES[:3], nan=0.0):
        return [
            (None if rng.random() < nulls else rng.choice(words), None if rng.random() < nulls else float("nan") if rng.random() < nan else rng.random() * 0.5 + shift, None if rng.random() < nulls else int(GOOD * (1 + rng.random() + shift)))
            for _ in range(n)
        ]

    loads = {
        1: rows(80), 2: rows(60, 0.3), 3: rows(60, nulls=0.6), 4: rows(50, words=("completed", "COMPLETED")), 5: [("ERROR", 0.25, 2**31)] * 30, 6: [(None, None, None)] * 20,
        7: rows(40, nan=0.2), 8: rows(70, 2.0), 9: [("TIMEOUT", float("inf"), -5), ("TIMEOUT", -float("inf"), 0)] * 5, 10: rows(20), 11: [("COMPLETED", 0.0, 2**20), ("COMPLETED", -0.0, 2**40)] * 7,
    }
    prior = {k: k - 1 for k in range(2, 12)} | {12: 3, 1: 99}
    path = write(spark, tmp_path, loads)
    table = spark.createDataFrame([(k, p, 1) for k, p in prior.items()] + [(2, 1, 5)], "load_id long, prior_load_id long, column int")
    got = {tuple(r) for r in profile.findings(spark, path, table, profile.RUN_RULES).collect()}
    assert got == expected(loads, prior)


class Watched:
    """A Parquet file that notes which columns of which row group are read."""

    def __init__(self, f):
        self.f, self.metadata, self.read = f, f.metadata, []

    def iter_batches(self, batch_size, row_groups, columns):
        self.read.append((row_groups, columns))
        return self.f.iter_batches(batch_size=batch_size, row_groups=row_groups, columns=columns)


def test_settled_chunks_are_not_read(spark, tmp_path):
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    t = pa.table(
        {
            "load_id": pa.array([5, 5, 6, 6, 7, 8], pa.int64()), "status": pa.array(["A", "B", None, None, "A", "A"]),
            "onmi": pa.array([None] * 4 + [0.5, 0.5], pa.float64()), "peak": pa.array([9, 9, None, None, 4, 4], pa.int64()),
        }
    )
    pq.write_table(t, str(tmp_path / "t.parquet"), row_group_size=2)
    cols = [chunks.Column("status", False), chunks.Column("onmi", True), chunks.Column("peak", True, 5, 10)]
    got = []
    with footers.open_parquet(f"file:{tmp_path}/t.parquet", ["status"]) as f:
        w = Watched(f)
        for g in range(3):
            for rows in chunks.profile_group(w, g, "load_id", cols, chunks._exact):
                got += [(int(k), rows["at"], None if rows["number"] is None else rows["number"][i], None if rows["text"] is None else rows["text"][i], int(rows["n"][i])) for i, k in enumerate(rows["key"])]
        assert w.read == [([0], ["status"]), ([2], ["load_id", "status", "onmi"])]
        w.read.clear()
        assert not list(chunks.profile_group(w, 0, "load_id", cols, chunks._exact, np.array([6]))) and not w.read
    assert sorted(got, key=str) == sorted(
        [(5, 0, None, "A", 1), (5, 0, None, "B", 1), (5, 1, None, None, 2), (5, 2, 9.0, None, 2), (6, 0, None, None, 2), (6, 1, None, None, 2), (6, 2, None, None, 2),
         (7, 0, None, "A", 1), (7, 1, 0.5, None, 1), (7, 2, 4.0, None, 1), (8, 0, None, "A", 1), (8, 1, 0.5, None, 1), (8, 2, 4.0, None, 1)], key=str,
    )
    b = {(r["key"], r["at"]): (r["n"], r["nulls"], r["invalid"], r["low"], r["high"]) for r in chunks.bounds(spark, str(tmp_path), "load_id", cols).where("bucket IS NULL AND text IS NULL").collect()}
    assert b[5, 2] == (2, 0, 0, 1, 1) and b[7, 2] == (1, 0, 1, 1, 1) and b[6, 0] == (2, 2, 0, 0, 0) and b[5, 0] == (2, 0, 0, 2, 2)


def test_dictionaries_and_footers(spark, tmp_path):
    path = write(spark, tmp_path, {5: [("ERROR", 0.25, 2**31)] * 30, 6: [(None, None, None)] * 20})
    assert [r["value"] for r in footers.dictionary_values(spark, path, "status").collect()] == ["ERROR"]
    p = {r["column_name"]: r for r in profile.column_profile(spark, path).collect()}
    assert p["status"]["nulls"] == 20 and p["load_id"]["n_rows"] == 50


def test_large_integers_and_instants_by_chunks(spark, tmp_path):
    """What tasks count agrees with Spark's own scan, value by value."""
    from datetime import datetime, timezone

    path = str(tmp_path / "t.parquet")
    rows = [(i % 3 if i % 7 else None, 2**60 + i % 5, datetime(2020, 1, 1, 0, 0, i, 17, tzinfo=timezone.utc) if i % 4 else None, bool(i % 2), [0.0, -0.0, float("nan"), float("inf"), None][i % 5], f"w{i % 4}") for i in range(40)]
    spark.createDataFrame(rows, "load_id long, big long, t timestamp, b boolean, f double, s string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    rules = profile.every_rule(df.schema, [])
    want = profile._unpivot(df.where("load_id IS NOT NULL"), "load_id", rules).groupBy("load_id", "column", "number", "text").count().collect()
    got = profile.histogram(spark, path, "load_id", rules).select("load_id", "column", "number", "text", "n").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) > 30


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    loads = spark.createDataFrame([(2, 1)], "load_id long, prior_load_id long")
    assert profile.findings(spark, path, loads, profile.RUN_RULES).count() == 0


def test_order_bucket_never_falls(spark):
    xs = sorted([-(10.0**k) for k in range(-3, 12)] + [0.0, -0.0, float("inf"), -float("inf"), 1e300] + [k / 1000 for k in range(1000)])
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", profile.order_bucket(__import__("pyspark").sql.functions.col("x")).alias("b"))
    b = [r["b"] for r in sorted(df.collect(), key=lambda r: r["x"])]
    assert b == sorted(b)


def test_every_column_per_load(spark, tmp_path):
    """A load whose unchecked column goes bad is seen; the rules for three columns alone miss it."""
    path = str(tmp_path / "runs.parquet")
    schema = "load_id long, pipeline_seconds double, method string, big long"
    rows = [(k, float(i) * (1 if k == 1 else -1), "a" if k == 1 else f"m{i}", 2**60 + i) for k in (1, 2) for i in range(20)] + [(2, float("nan"), None, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    rules = profile.every_rule(spark.read.parquet(path).schema, [profile.Rule("pipeline_seconds", high=1e300)])
    stats = profile.load_statistics(profile.histogram(spark, path, "load_id", rules), "load_id", rules)
    got = {(r["load_id"], r["column"]): tuple(r[c] for c in ("total", "nulls", "distinct", "invalid", "low", "high", "low_text", "high_text")) for r in stats.collect()}
    assert got[1, "pipeline_seconds"] == (20, 0, 20, 0, 0.0, 19.0, None, None)
    assert got[2, "pipeline_seconds"] == (21, 0, 21, 20, -19.0, 0.0, None, None)
    assert got[2, "method"] == (21, 1, 20, 0, None, None, "m0", "m9")
    assert got[2, "big"][:4] == (21, 1, 20, 0) and got[2, "load_id"][:4] == (21, 0, 1, 0)
    loads = spark.createDataFrame([(2, 1)], "load_id long, prior_load_id long")
    found = {tuple(r)[1:] for r in profile.findings(spark, path, loads, rules).collect()}
    assert found == {("pipeline_seconds", "invalid"), ("pipeline_seconds", "values"), ("method", "distinct"), ("method", "values"), ("load_id", "values")}


def test_column_profile_scans_what_footers_leave_open(spark, tmp_path):
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    t = pa.table({"a": pa.array([1, None, 3], pa.int64()), "s": pa.array(["x", None, None]), "f": pa.array([float("nan"), 2.0, None])})
    for name, kept in (("p.parquet", True), ("q.parquet", False)):
        pq.write_table(t, str(tmp_path / name), write_statistics=kept)
    got = {r["column_name"]: tuple(r)[1:] for r in profile.column_profile(spark, str(tmp_path)).collect()}
    assert got == {"a": (6, 2, "1", "3"), "s": (6, 4, "x", "x"), "f": (6, 2, "2.0", "2.0")}
