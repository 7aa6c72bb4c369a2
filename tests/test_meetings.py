"""Common neighbours, triangles and ego networks against enumeration."""

import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa

from meshwright.functions import exact
from meshwright.functions.grouping import connected
from meshwright.operators import bank, criteria, graph, iterative, meetings, ordered
from meshwright.operators.graph import Graph, co_occurrence


def _graph(spark, seed, n=24, p=0.35):
    rng = random.Random(seed)
    w = {(u * 7, v * 7): rng.randint(1, 9) for u, v in combinations(range(n), 2) if rng.random() < p or u == 0}
    near = {}
    for (u, v), x in w.items():
        near.setdefault(u, {})[v] = x
        near.setdefault(v, {})[u] = x
    return Graph(spark.createDataFrame([(*k, x) for k, x in w.items()], "u long, v long, w long")), near


def test_triangles_and_common_neighbours(spark):
    g, near = _graph(spark, 1)
    t = [tuple(r) for r in meetings.triangles(g, 4).collect()]
    assert all(near[a][b] == ab and near[a][x] == ax and near[b][x] == bx for a, b, x, ab, ax, bx in t)
    want = {frozenset(c) for c in combinations(near, 3) if all(v in near[u] for u, v in combinations(c, 2))}
    assert len(t) == len(want) and {frozenset(r[:3]) for r in t} == want
    pairs = [(u, v) for u in near for v in near if u != v and (u + v) % 3 == 0]
    got = {tuple(r) for r in meetings.common(g, spark.createDataFrame(pairs, "u long, v long"), 4).collect()}
    assert got == {(u, v, x, near[u][x], near[v][x]) for u, v in pairs for x in near[u] if x in near[v]}


def test_no_rows_meet_nobody(spark):
    g = Graph(spark.createDataFrame([], "u long, v long, w long"))
    assert meetings.triangles(g).isEmpty() and iterative.ego_components(g).isEmpty() and iterative.ego_splitting(g).isEmpty()


def test_ego_networks(spark, monkeypatch):
    """Links beyond what a task gathers at once are reduced, not lost."""
    monkeypatch.setattr(meetings, "LINKS", 5)
    g, near = _graph(spark, 2, 20, 0.15)
    got = {(r["ego"], r["u"]): r["c"] for r in iterative.ego_components(g).collect()}
    want = {(e, u): min(part) for e, r in near.items() for part in connected(near, set(r)) for u in part}
    assert got == want
    names, edges = iterative.personas(g)
    assert {(r["u"], r["c"], r["persona"]) for r in names.collect()} == {(e, c, f"{e}/{c}") for (e, _), c in want.items()}
    links = {(f"{u}/{want[u, v]}", f"{v}/{want[v, u]}", w) for u, r in near.items() for v, w in r.items() if u < v}
    assert {tuple(r) for r in edges.collect()} == links
    ends = {}
    for p, q, _ in links:
        ends.setdefault(p, {})[q] = ends.setdefault(q, {})[p] = 1
    groups = {(min(c), int(p.split("/")[0])) for c in connected(ends, set(ends)) for p in c}
    assert {tuple(r) for r in iterative.ego_splitting(g).collect()} == groups


def test_wedges_are_looked_at_in_parts(monkeypatch):
    monkeypatch.setattr(meetings, "WEDGES", 3)
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(0, 12, (60, 2)), axis=0)
    block = (rows[:, 0], rows[:, 1], np.arange(len(rows)))
    parts = list(meetings._met(block, block, block))
    got = {(block[0][i], block[1][i], x, wa, wb) for part in parts for i, x, wa, wb in zip(*part)}
    w = {(a, b): k for k, (a, b) in enumerate(rows.tolist())}
    assert len(parts) > 3 and got == {(a, b, x, w[a, x], w[b, x]) for a, b in w for x in range(12) if (a, x) in w and (b, x) in w}


def test_profile_penalties(spark):
    g, near = _graph(spark, 4)
    d = {u: sum(r.values()) for u, r in near.items()}
    pairs = [(u, v) for u in near for v in near if (u * v) % 5 == 0] + [(0, 1)]  # 1 isn't in the graph
    want = {}
    for u, v in pairs[:-1]:
        cells = [abs(d[v] * near[u].get(x, 0) - d[u] * near[v].get(x, 0)) for x in near if x not in (u, v)]
        want[u, v] = (sum(cells), d[u] + d[v])
    got = criteria.profile_penalty(g, spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {(r["u"], r["v"]): (r["num"], r["den"]) for r in got} == want and len(got) == len(want)


def test_worst_triangles_need_no_full_listing(spark):
    """Only the legs that can reach the report are joined, and the report is the same."""
    rng = random.Random(5)
    x = {(i, j): float(rng.randint(0, 99)) for i, j in combinations(range(40), 2)}
    at = lambda i, j: x[min(i, j), max(i, j)]
    every = sorted((-(v - at(i, k) - at(j, k)), i, j, k) for (i, j), v in x.items() for k in range(40) if k not in (i, j) and v > at(i, k) + at(j, k))
    pairs = spark.createDataFrame([(*k, v) for k, v in x.items()], "i long, j long, x double")
    for limit in (20, 10**6):
        got = [tuple(r) for r in ordered.violated_triangles(pairs, limit).collect()]
        assert got == [(i, j, k, -v) for v, i, j, k in every[:limit]]
    assert ordered.violated_triangles(pairs.where("false"), 5).isEmpty()


def test_pairs_at_a_hub(spark):
    """Neighbours alike in degree and weight are one root, so a star's pairs have a few each."""
    edges = [(0, v, 1) for v in range(1, 61)] + [(v, v + 1, 2) for v in range(1, 31, 2)]
    g = Graph(spark.createDataFrame(edges, "u long, v long, w long"))
    rows = {}
    for u, v, w in edges:
        rows.setdefault(u, {})[v] = w
        rows.setdefault(v, {})[u] = w
    degree = {u: sum(r.values()) for u, r in rows.items()}
    got = bank.pair_margins(g).collect()
    assert len(got) > 15
    for r in got:
        share, margin = exact.pair_copy(rows, degree, sum(degree.values()), r["u"], r["v"], Fraction(1))
        assert abs(r["margin"] - float(margin)) < 1e-9 and abs(r["share"] - float(share)) < 1e-9


def test_ego_parts_shuffle_no_links(spark, monkeypatch, tmp_path):
    """Links between an ego's neighbours used to be shuffled; now a task finds and unites those of its egos."""
    g, near = _graph(spark, 3, 22, 0.2)
    plan = iterative.persona_ids(g)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    want = {(e, u): min(part) for e, r in near.items() for part in connected(near, set(r)) for u in part}
    assert {(r["u"], r["c"]) for r in iterative.persona_ids(g).collect()} == {(e, c) for (e, _), c in want.items()}
    for limit, step in (("WEDGES", 7), ("LINKS", 3)):
        monkeypatch.setattr(meetings, limit, step)
    files, got = g.edge_files(), {}
    for k in range(3):
        for e, u, c in zip(*(x.tolist() for x in meetings._ego_parts(files, k, 3))):
            assert (e, u) not in got
            got[e, u] = c
    assert got == want


def test_places_of_sparse_and_dense_ids():
    for ids in ([3, 4, 9], [-5, 10**15, 10**16]):
        assert meetings._Places(np.array(ids))(np.array([ids[2], ids[0], 5, -(10**17), 10**17, ids[1]])).tolist() == [2, 0, -1, -1, -1, 1]
    assert meetings._Places(np.zeros(0, np.int64))(np.array([1])).tolist() == [-1]


def test_pairs_of_groups_over_several_batches(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(g, rng.randint(0, 9)) for g in ("a", "b", "c", "d", "") for _ in range(rng.randint(1, 12))] + [("h", u) for u in range(40)] + [(None, 1), (None, 2), ("a", None)]
    sets = {}
    for g, u in rows:
        if g is not None and u is not None:
            sets.setdefault(g, set()).add(u)
    want = Counter(c for s in sets.values() for c in combinations(sorted(s), 2))
    g = co_occurrence(spark.createDataFrame(rows, "g string, u int"), "g", "u")
    assert {(r["u"], r["v"]): r["w"] for r in g.edges.collect()} == want
    monkeypatch.setattr(graph, "_PAIRS", 3)
    clean = sorted((g, u) for g, u in rows if g is not None and u is not None)
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_pylist([{"g": g, "u": u} for g, u in clean[k : k + size]], pa.schema([("g", pa.string()), ("u", pa.int64())])) for k in range(0, len(clean), size)]
        got = Counter(p for b in graph._pairs_by_group(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        assert got == want
