"""Queries that once ran over a part of their table, against a plain computation over all of it."""

import os

import numpy as np
import pytest

from meshwright.operators import bank, iterative
from meshwright.operators.graph import Graph
from meshwright.plans import registry
from meshwright.session import table
from tests.conftest import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_block_union_takes_all_lines(spark):
    rows = table(spark, SF, "lineitem").select("l_orderkey", "l_partkey").collect()
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for o, p in rows:
        if p is not None:
            a, b = root(("o", o)) if o is not None else root(("p", p)), root(("p", p))
            up[a] = b
    least = {}
    for _, p in rows:
        if p is not None:
            r = root(("p", p))
            least[r] = min(least.get(r, p), p)
    want = {(p, least[root(("p", p))]) for _, p in rows if p is not None}
    assert {tuple(r) for r in registry.queries()["block_union"](spark, SF).select("u", "g").collect()} == want


def test_mechanism_takes_all_days(spark):
    b = table(spark, SF, "lineitem").selectExpr("l_orderkey AS block_id", "l_partkey AS u")
    got = registry.queries()["mechanism_ranks"](spark, SF)
    want = bank.mechanism(b)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_push_goes_on_until_settled(spark):
    """Ranks of a settled push against the lazy walk's exact distribution, on a path longer than any fixed few rounds."""
    n, alpha, rho = 12, 0.15, 1e-4
    edges = [(i, i + 1, 1 + i % 3) for i in range(n - 1)]
    g = Graph(spark.createDataFrame(edges, "u long, v long, w long"))
    r = {x["u"]: (x["rank"], x["residual"]) for x in iterative.push_rounds(g, spark.createDataFrame([(1, 0)], "query_id int, seed long"), alpha, rho).collect()}
    a = np.zeros((n, n))
    for u, v, w in edges:
        a[u, v] = a[v, u] = w
    d = a.sum(1)
    walk = (np.eye(n) + a / d) / 2
    start = np.zeros(n)
    start[0] = 1
    exact = alpha * np.linalg.solve(np.eye(n) - (1 - alpha) * walk, start)
    assert abs(sum(x + y for x, y in r.values()) - 1) < 1e-12
    assert all(y <= rho * d[u] for u, (_, y) in r.items())
    # an unpushed residual of at most rho d leaves at most rho d of rank missing at any vertex
    assert all(-1e-12 <= exact[u] - r.get(u, (0.0, 0.0))[0] <= rho * d[u] + 1e-12 for u in range(n))
    assert len(r) > 5
