"""Graph operators against brute force on small random graphs, and invariants."""

import gzip
import json
import random
import zipfile
from fractions import Fraction as Fr
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import cuts, diffuse, exact
from meshwright.functions.compose import compose
from meshwright.functions.region import Region
from meshwright.operators import bank, cover, hyper, iterative, jobs, metrics, ordered, pipelines, regions, reports
from meshwright.operators.graph import Graph, asymmetries, fingerprint
from meshwright.sources import generators, graph_files
from meshwright.streaming import windows
from tests.test_kernels import graph


def frame(spark, rows):
    return Graph(spark.createDataFrame([(u, v, w) for u in rows for v, w in rows[u].items() if u < v], "u long, v long, w long"))


def brute_components(rows):
    label = {}
    for s in sorted(rows):
        if s in label:
            continue
        stack, label[s] = [s], s
        while stack:
            for v in rows[stack.pop()]:
                if v not in label:
                    label[v] = s
                    stack.append(v)
    return label


@pytest.mark.parametrize("seed,p", [(0, 0.02), (1, 0.05), (2, 0.1)])
def test_components(spark, seed, p):
    rng = random.Random(seed)
    n = 60
    rows = {u: {} for u in range(n)}
    for u, v in combinations(range(n), 2):
        if rng.random() < p:
            rows[u][v] = rows[v][u] = 1
    g = frame(spark, rows)
    got = {r["u"]: r["c"] for r in iterative.components(g.edges, spark.range(n).withColumnRenamed("id", "u")).collect()}
    assert got == brute_components(rows)
    chain = spark.range(199).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["c"] for r in iterative.components(chain).collect()} == {0}
    assert iterative.components(chain.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_contraction_keeps_an_optimum(spark, seed):
    rows, degree, m = graph(seed + 40, 7, 0.35)
    member, log = iterative.recursive_contraction(frame(spark, rows))
    group = {r["u"]: r["g"] for r in member.collect()}
    value = {(u, v): exact.affinity(rows, degree, m, Fr(1), u, v) for u, v in combinations(range(7), 2)}
    best, _, _ = exact.best_partition(7, value)
    kept = max(sum(x for (i, j), x in value.items() if lab[i] == lab[j]) for lab in exact.partitions(7) if all(lab[i] == lab[j] for i, j in value if group[i] == group[j]))
    assert kept == best and log.count() >= 3


def test_quotient_lift_and_conservation(spark):
    rows, degree, m = graph(3, 8)
    g = frame(spark, rows)
    lab = spark.createDataFrame([(u, u % 3) for u in range(8)], "u long, l long")
    q = metrics.quotient(g, lab)
    assert q.agg(F.sum("w")).first()[0] == m == g.volume
    assert metrics.quotient_mismatches(g, lab, q).count() == 0 and asymmetries(g.adj).count() == 0
    a = metrics.modularity(g, lab, [(1, 1)]).first()
    shifted = Graph(g.edges.select((F.col("u") + 100).alias("u"), (F.col("v") + 100).alias("v"), "w"))
    b = metrics.modularity(shifted, lab.select((F.col("u") + 100).alias("u"), "l"), [(1, 1)]).first()
    assert (a["num"], a["den"]) == (b["num"], b["den"])
    assert fingerprint(g.edges).first() == fingerprint(g.edges.orderBy(F.desc("w"))).first() != fingerprint(shifted.edges).first()


@pytest.mark.parametrize("seed", range(3))
def test_sweeps_and_margins(spark, seed):
    rows, degree, m = graph(seed, 9)
    g = frame(spark, rows)
    x = {u: float(random.Random(seed * 7 + u).randint(0, 4)) for u in range(9)}
    x[0] = 2.0
    scores = spark.createDataFrame([(1, u, h) for u, h in x.items()], "query_id int, u long, x double")
    got = ordered.level_sweep(g, scores, spark.createDataFrame([(1, 0)], "query_id int, seed long")).first()
    s, z = diffuse.sweep(Region.of(rows, degree), m, np.array([x[u] for u in sorted(rows)]), 0)
    assert got["size"] == len(s) and Fr(got["z_num"], got["z_den"]) == z
    one = ordered.vertex_sweep(g, scores).first()
    s, phi = diffuse.sweep(Region.of(rows, degree), m, np.array([x[u] for u in sorted(rows)]), None, "phi", ties=False)
    assert one["size"] == len(s) and Fr(one["cut"], one["den"]) == phi
    t = {0, 1, 2}
    for r in bank.truth_margins(g, spark.createDataFrame([("t", u) for u in t], "set_id string, u long")).collect():
        moved = t | {r["u"]} if r["operation"] == "add" else t - {r["u"]}
        assert Fr(r["z_num"], r["z_den"]) == cuts.quality(Region.of(rows, degree), m, moved)
    for r in bank.pair_margins(g).collect():
        p, margin = exact.pair_copy(rows, degree, m, r["u"], r["v"], Fr(1))
        assert abs(r["margin"] - float(margin)) < 1e-9 and abs(r["share"] - float(p)) < 1e-9


def test_surrogate_is_tight(spark):
    rows, degree, m = graph(5, 9)
    g = frame(spark, rows)

    def q(us):
        return spark.createDataFrame([(1, u) for u in us], "query_id int, u long")

    r = ordered.surrogate(g, q(range(9)), q([0, 1, 2]), spark.createDataFrame([(1, 0)], "query_id int, seed long"), spark.createDataFrame([(1, u, 1.0) for u in range(9)], "query_id int, u long, x double")).collect()
    total = sum(Fr(x["num"], x["den"]) for x in r if x["u"] in (0, 1, 2))
    assert total + Region.of(rows, degree).numbers({0, 1, 2})[1] == 0


@pytest.mark.parametrize("seed", [3, 8])
def test_pipeline_arms_keep_an_optimum(spark, seed):
    rows, degree, m = graph(seed + 60, 6, 0.5)
    g = frame(spark, rows)
    bank_rows = [(k, u) for k, c in enumerate(c for n in (2, 3) for c in combinations(range(6), n)) for u in c]
    blocks = spark.createDataFrame(bank_rows, "block_id long, u long")
    value = {(u, v): exact.affinity(rows, degree, m, Fr(1), u, v) for u, v in combinations(range(6), 2)}
    best, _, _ = exact.best_partition(6, value)
    events = []
    for name in pipelines.ARMS:
        group = {r["u"]: r["g"] for r in pipelines.arm(g, blocks, name, progress=events.append).collect()}
        assert set(group) == set(range(6)) and (name != "U" or group == {u: u for u in range(6)})
        assert max(sum(x for (i, j), x in value.items() if p[i] == p[j]) for p in exact.partitions(6) if all(p[u] == p[group[u]] for u in group)) == best, name
    assert events and events[0]["round"] == 1
    with pytest.raises(ValueError):
        pipelines.arm(g, blocks, "X")


def test_images_drop_equal_and_large_ones(spark):
    blocks = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (2, 3), (3, 1), (3, 2), (4, 0), (4, 4), (4, 5)], "block_id long, u long")
    member = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 3), (4, 4), (5, 5)], "u long, g long")
    assert {tuple(r) for r in pipelines.images(blocks, member, 2).collect()} == {(2, 2), (2, 3), (3, 0), (3, 2)}


def test_compositions_by_part(spark):
    rows, degree, m = graph(5, 8, 0.5)
    g = frame(spark, rows)
    parts = spark.createDataFrame([("a", u) for u in range(5)] + [("b", u) for u in range(5, 8)], "part string, u long")
    none = spark.createDataFrame([], "part string, block_id long, u long")
    got = {}
    for r in regions.compositions(g, parts, none, "S").collect():
        got.setdefault(r["part"], {})[r["u"]] = r["g"]
    for part, us in (("a", range(5)), ("b", range(5, 8))):
        inner = {u: {v: w for v, w in rows[u].items() if v in us} for u in us if any(v in us for v in rows[u])}
        d = {u: sum(r.values()) for u, r in inner.items()}
        groups, _ = compose(inner, d, sum(d.values()))
        assert got.get(part, {}) == {u: gr[0] for gr in groups for u in gr}
    assert regions.compositions(g, parts, none, "S", limit=1).where("u IS NULL").count() >= 1


def test_suites(spark):
    cases = spark.createDataFrame([(1, '{"blocks":[{"n":2,"x":"a"},null,{"n":3}],"total":5}'), (2, '{"blocks":[],"total":1}'), (3, "no json"), (4, None), (5, '{"blocks":[{"n":1}],"total":2}')], "case_id long, payload string")
    rows = reports.suite_table(cases, "blocks", "n:int,x:string")
    assert {tuple(r) for r in rows.collect()} == {(1, 0, 2, "a"), (1, 2, 3, None), (5, 0, 1, None)}
    got = {tuple(r) for r in reports.suite_mismatches(cases, rows, "total", F.sum("n")).collect()}
    assert got == {(2, 1.0, None), (5, 2.0, 1.0)}


def test_regions_match_kernels(spark):
    rows, degree, m = graph(2, 10, 0.3)
    g = frame(spark, rows)
    q = spark.createDataFrame([(7, 0)], "query_id int, seed long")
    got = regions.retrieve(g, q).first()
    region = Region.of(rows, degree)
    want = diffuse.retrieve(region, m, 0)
    assert list(got["vertices"]) == region.ids[want["places"]].tolist() and abs(got["lower_bound"] - want["lower_bound"]) < 1e-12
    panel = regions.block_panel(g, spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), *(("c", u) for u in range(10))], "block_id string, u long"), sorted(regions.CRITERIA), limit=12).collect()
    assert {r["status"] for r in panel if r["block_id"] == "b"} == {"too_small"} and {r["status"] for r in panel if r["block_id"] == "c"} == {"size_limit"}
    assert {(r["method"], r["status"]) for r in panel if r["block_id"] == "a"} == {(k, f(region.within([0, 1]), m)) for k, f in regions.CRITERIA.items()}
    assert bank.invalid_queries(g, spark.createDataFrame([(1, 0), (2, 99), (3, None)], "query_id int, seed long")).count() == 2


def test_push_rounds_keep_mass_and_settle(spark):
    rows, degree, _ = graph(4, 8)
    r = iterative.push_rounds(frame(spark, rows), spark.createDataFrame([(1, 0)], "query_id int, seed long"), 0.3, 1e-2, 12).collect()
    assert abs(sum(x["rank"] + x["residual"] for x in r) - 1) < 1e-9
    assert all(x["residual"] <= 1e-2 * degree[x["u"]] + 1e-12 for x in r)


def covers(spark, truth, pred):
    def one(groups):
        return spark.createDataFrame([(i, v) for i, g in enumerate(groups) for v in g], "cid int, node long")

    return one(truth), one(pred)


@pytest.mark.parametrize(
    "truth,pred,f1",
    [([[0, 1, 2], [2, 3, 4]], [[2, 3, 4], [0, 1, 2]], 1.0), ([[0, 1]], [[0, 1], [0, 1]], 2 / 3), ([[0, 1], [2, 3]], [[0, 1]], 2 / 3)],
)
def test_cover_scores(spark, truth, pred, f1):
    assert abs(cover.macro_scores(*covers(spark, truth, pred)).first()["macro_f1"] - f1) < 1e-12


def test_onmi(spark):
    a, b = covers(spark, [[0, 1, 2], [2, 3, 4]], [[2, 3, 4], [0, 1, 2]])
    assert abs(cover.overlapping_nmi(a, b, 6).first()["onmi"] - 1) < 1e-9
    a, b = covers(spark, [[0, 1, 2]], [[3, 4, 5]])
    assert abs(cover.overlapping_nmi(a, b, 6).first()["onmi"]) < 1e-9
    assert cover.overlapping_nmi(a, b.where("false"), 6).first()["status"] == "UNDEFINED_EMPTY_COVER"
    a, b = covers(spark, [[0, 1, 2]], [[0, 1, 2]])
    assert cover.overlapping_nmi(a, b, 3).first()["status"] == "UNDEFINED_ZERO_ENTROPY"


def test_onmi_random_against_dense(spark):
    def h(c, n):
        return -c * np.log2(c / n) if c else 0.0

    for seed in range(3):
        rng, n = random.Random(seed), 12
        truth = [rng.sample(range(n), rng.randint(1, 11)) for _ in range(4)]
        pred = [rng.sample(range(n), rng.randint(1, 11)) for _ in range(5)]

        def given(x, y):
            return sum(
                min(
                    (h(n - len(a) - len(b) + d, n) + h(len(b) - d, n) + h(len(a) - d, n) + h(d, n) - h(len(b), n) - h(n - len(b), n))
                    if h(n - len(a) - len(b) + d, n) + h(d, n) >= h(len(b) - d, n) + h(len(a) - d, n)
                    else h(len(a), n) + h(n - len(a), n)
                    for b in y
                    for d in [len(set(a) & set(b))]
                )
                for a in x
            )

        hx, hy = (sum(h(len(a), n) + h(n - len(a), n) for a in c) for c in (truth, pred))
        want = 0.5 * (hx + hy - given(truth, pred) - given(pred, truth)) / max(hx, hy)
        assert abs(cover.overlapping_nmi(*covers(spark, truth, pred), n).first()["onmi"] - want) < 1e-9


def test_ego_splitting_of_two_cliques(spark):
    g = generators.hub_cliques(spark, 2, 4)
    groups = {}
    for r in iterative.ego_splitting(g, 2).collect():
        groups.setdefault(r["cid"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [0, 4, 5, 6]]
    ego = {(r["ego"], r["u"]): r["c"] for r in iterative.ego_components(g).collect()}
    assert len({c for (e, _), c in ego.items() if e == 0}) == 2 and len({c for (e, _), c in ego.items() if e == 1}) == 1


def test_hypergraph_brute_force(spark):
    rng = random.Random(2)
    edges = {e: rng.sample(range(6), rng.randint(2, 4)) for e in range(7)}
    inc = spark.createDataFrame([(e, u, len(m)) for e, m in edges.items() for u in m], "e long, u long, r long")
    m = sum(map(len, edges.values()))
    degree = {u: sum(u in e for e in edges.values()) for u in range(6)}
    for kind in ("all_or_nothing", "cardinality_min"):
        sets = [(f"{k}", u) for k in range(1, 63) for u in range(6) if k >> u & 1]
        got = {r["set_id"]: r for r in hyper.set_quality(inc, spark.createDataFrame(sets, "set_id string, u long"), kind).collect()}
        ranks = {}
        for e in edges.values():
            ranks[len(e)] = ranks.get(len(e), 0) + 1
        poly = hyper.null_polynomial(ranks, m, kind)
        for k in range(1, 63):
            s = {u for u in range(6) if k >> u & 1}
            z = diffuse.hyper_quality([(e, 1) for e in edges.values()], degree, m, s, kind) if any(degree[u] for u in s) else None
            r = got[str(k)]
            if z is not None:
                vol = sum(degree[u] for u in s)
                assert Fr(r["cut"], vol) + Fr(vol, m) == z
                assert abs(r["z"] - float((r["cut"] + exact.horner(poly, Fr(vol))) / vol)) < 1e-9
    with pytest.raises(ValueError):
        hyper.profile("unknown", F.lit(1), F.lit(2))
    assert hyper.concave([0, 1, 1, 0]) and not hyper.concave([0, 1, 3, 1, 0]) and not hyper.concave([0, 1, 0, 1])
    for w in ([0, 1, 2, 2, 1, 0], [0, 3, 4, 3, 0]):
        parts = hyper.capped_minima(w)
        assert all(sum(c * min(j, len(w) - 1 - j, k) for k, c in parts) == w[j] for j in range(len(w)))
    r = diffuse.hyper_retrieve([(e, 1) for e in edges.values()], degree, m, edges[0][0], masses=3)
    assert edges[0][0] in r["vertices"]


def test_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"n": 4, "edges": [[0, 1], [1, 2, 5], [1, 2], [2, 2], [2, 1, -1], [0, 9]]}))
    g, bad = graph_files.read_graph_json(spark, str(tmp_path / "g.json"))
    assert {tuple(r) for r in g.edges.collect()} == {(0, 1, 1), (1, 2, 6), (0, 9, 1)} and g.degrees.where("u = 3").first()["d"] == 0
    assert {r["reason"]: r["n"] for r in bad.collect()} == {"loop": 1, "reversed": 1, "weight": 1, "duplicate": 1, "unknown_vertex": 1}
    (tmp_path / "c.json").write_text(json.dumps({"communities": [[1, 2, 2], [], [1, 2]], "labels_complete": True}))
    c, audit = graph_files.read_cover_json(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in c.collect()} == {(0, 1), (0, 2), (2, 1), (2, 2)} and tuple(audit.first()) == (3, 1, 1)
    with gzip.open(tmp_path / "e.txt.gz", "wt") as f:
        f.write("# a comment\n30\t10\n10\t30\n10\t20\n40\t40\n")
    g, ids, counts = graph_files.read_edge_text(spark, str(tmp_path / "e.txt.gz"))
    assert {tuple(r)[:2] for r in g.edges.collect()} == {(0, 2), (0, 1)} and tuple(counts.first()) == (4, 1, 1) and ids.count() == 4
    (tmp_path / "network.dat").write_text("1 2\n2 1\n2 3\n3 2\n")
    (tmp_path / "community.dat").write_text("1 1\n2 1 2\n3 2\n")
    g, member, faults = graph_files.read_benchmark_text(spark, str(tmp_path / "network.dat"), str(tmp_path / "community.dat"))
    assert g.edges.count() == 2 and faults.count() == 0 and member.groupBy("node").count().where("count > 1").count() == 1
    (tmp_path / "h.txt").write_text("1,2,3\n4\n2,2\n\n2,5\n")
    inc, left = graph_files.read_hyperedges(spark, str(tmp_path / "h.txt"))
    assert inc.count() == 5 and {tuple(r) for r in left.collect()} == {("rank", 1), ("repeated", 1)}
    np.save(tmp_path / "indptr.npy", np.array([0, 1, 3, 4]))
    np.save(tmp_path / "indices.npy", np.array([1, 0, 2, 1]))
    np.save(tmp_path / "weights.npy", np.array([2, 2, 3, 3]))
    assert {tuple(r) for r in graph_files.read_csr(spark, str(tmp_path), 2).edges.collect()} == {(0, 1, 2), (1, 2, 3)}
    (tmp_path / "r.json").write_text('{"job_id": "a", "status": "COMPLETED", "pipeline_seconds": 1.5}\n{"job_id": "b", "status": "COMPLETED"}\n')
    (tmp_path / "f.json").write_text('{"job_id": "b", "status": "TIMEOUT"}\n')
    planned = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    got = {r["job_id"]: r["status"] for r in graph_files.read_run_results(spark, planned, str(tmp_path / "r.json"), str(tmp_path / "f.json")).collect()}
    assert got == {"a": "COMPLETED", "b": "TIMEOUT", "c": "NOT_RUN"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.txt", "hello")
    assert graph_files.read_archives(spark, str(tmp_path / "z.zip")).first()["content"] == "hello"
    graph_files.write_table(planned.withColumn("l", F.array(F.lit(1))), str(tmp_path / "out"), "csv")
    with pytest.raises(Exception):
        graph_files.write_table(planned, str(tmp_path / "out"), "csv")
    graph_files.write_proposal(spark, {0: np.eye(2)}, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert graph_files.union_all(planned, spark.createDataFrame([(1,)], "x int")).columns == ["job_id", "x"]


def test_jobs(spark, tmp_path):
    out = jobs.run_jobs(spark, {"ok": lambda: spark.range(3), "bad": lambda: spark.range(3).select(F.raise_error(F.lit("no"))), "done": lambda: spark.range(1)}, 60, str(tmp_path), {"done"})
    assert [(n, s) for n, s, _ in out] == [("ok", "COMPLETED"), ("bad", "ERROR")]
    assert sorted(jobs.shuffled(list(range(20)), 3)) == list(range(20)) and jobs.shuffled([1, 2, 3], 5) == jobs.shuffled([1, 2, 3], 5)


def test_random_families_repeat(spark):
    a, lab = generators.planted(spark, 120, 3, 0.4, 0.02, 5)
    b, _ = generators.planted(spark, 120, 3, 0.4, 0.02, 5)
    assert fingerprint(a.edges).first() == fingerprint(b.edges.repartition(7)).first()
    within = a.edges.join(lab, "u").join(lab.select(F.col("u").alias("v"), F.col("l").alias("k")), "v").where("l = k").count()
    assert within > 0.7 * a.edges.count()
    h = generators.planted_hypergraph(spark, 30, 3, 5, 4, 3, 1)
    assert h.count() == 57 and generators.grid(spark, ["a", "b"], [1, 2], [(1, 2), (1, 1)]).count() == 8


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, 60 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    live = windows.event_stream(spark, str(tmp_path / "e"))
    n = {r["start"]: r["n"] for r in windows.drain(windows.tumbling(live, "10 minutes"), "mw_tumbling").collect()}
    assert sum(n.values()) == 40 and set(n.values()) == {10}
    assert windows.sliding(df, "10 minutes", "5 minutes").agg(F.sum("n")).first()[0] == 80
    assert windows.sessions(df, "5 minutes").count() == 3
    total = windows.drain(windows.running_totals(live), "mw_totals", "update").groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert total == 40
