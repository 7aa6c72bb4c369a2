"""Kernels against enumeration on small random graphs."""

import random
import tracemalloc
from fractions import Fraction as Fr
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwright.functions import cuts, diffuse, exact, field61, grouping
from meshwright.functions.assign import assign
from meshwright.functions.compose import Quotient, _pair, compose
from meshwright.functions.region import Region


def graph(seed, n=7, p=0.5, w=4):
    rng = random.Random(seed)
    rows = {u: {} for u in range(n)}
    for u, v in combinations(range(n), 2):
        if rng.random() < p:
            rows[u][v] = rows[v][u] = rng.randint(1, w)
    for u in range(n - 1):
        if not rows[u]:
            rows[u][n - 1] = rows[n - 1][u] = 1
    degree = {u: sum(r.values()) for u, r in rows.items()}
    return rows, degree, sum(degree.values())


def subsets(n, seed):
    others = [u for u in range(n) if u != seed]
    for k in range(n):
        for c in combinations(others, k):
            yield {seed, *c}


@pytest.mark.parametrize("seed", range(8))
def test_seeded_cut_hull_and_refine(seed):
    rows, degree, m = graph(seed)
    region = Region.of(rows, degree)
    unary = {u: Fr(random.Random(seed * 9 + u).randint(-6, 4), 3) for u in rows}
    got, value = cuts.seeded_cut(region, 0, unary)
    every = [(region.numbers(s)[1] + sum(unary[u] for u in s), len(s), s) for s in subsets(7, 0)]
    assert value == min(e[0] for e in every)
    least = set.intersection(*(e[2] for e in every if e[0] == value))
    assert got == least
    h = cuts.hull(region, 0)
    for k, (v, c) in enumerate(zip(h.vols, h.cuts)):
        assert region.numbers(h.members(k)) == (v, c)
    for s in subsets(7, 0):
        v, c = region.numbers(s)
        for (v0, c0), (v1, c1) in zip(zip(h.vols, h.cuts), zip(h.vols[1:], h.cuts[1:])):
            if v0 <= v <= v1:
                assert c >= c0 + Fr((c1 - c0) * (v - v0), v1 - v0)
    bound, best, _ = cuts.regional_bound(region, m, 0)
    optimum = min(cuts.quality(region, m, s) for s in subsets(7, 0))
    assert Fr(bound) <= optimum
    s, _ = cuts.refine(region, m, 0, {0})
    assert cuts.quality(region, m, s) <= cuts.quality(region, m, {0})


@pytest.mark.parametrize("seed", range(12))
def test_hull_of_a_part_of_a_graph(seed):
    """A region with a rim: its edges to the rim always count."""
    rows, degree, m = graph(seed + 70, 9, 0.45, 6)
    region = Region.of(rows, degree).within(range(6))
    assert region.n == 6 and region.ids.tolist() == list(range(6))
    h = cuts.hull(region, 2)
    points = list(zip(h.vols, h.cuts))
    slopes = [Fr(c1 - c0, v1 - v0) for (v0, c0), (v1, c1) in zip(points, points[1:])]
    assert slopes == sorted(set(slopes))
    every = [region.numbers(s) for s in subsets(6, 2)]
    assert set(points) <= set(every)
    for s in subsets(6, 2):
        v, c = sum(degree[u] for u in s), sum(w for u in s for x, w in rows[u].items() if x not in s)
        assert region.numbers(s) == (v, c)
        for (v0, c0), (v1, c1) in zip(points, points[1:]):
            assert not v0 <= v <= v1 or c >= c0 + Fr((c1 - c0) * (v - v0), v1 - v0)


def test_larger_cuts_settle_the_same():
    """Peeling and flow against a flow over everything."""
    rng = random.Random(5)
    for seed in range(6):
        rows, degree, _ = graph(seed + 90, 40, 0.12, 9)
        region = Region.of(rows, degree)
        c = cuts.Cutter(region)
        cost = {u: rng.randint(-30, 30) for u in range(40)}
        got = c.least(cost, 3)
        f = cuts.Flow(42)
        for u, x in cost.items():
            f.arc(40, u, max(0, -x))
            f.arc(u, 41, max(0, x))
        for u in rows:
            for v, w in rows[u].items():
                if u < v:
                    f.arc(u, v, 3 * w, 3 * w)
        f.run(40, 41)
        assert got == f.side(40) - {40}


@pytest.mark.parametrize("kind", ["all_or_nothing", "cardinality_min"])
@pytest.mark.parametrize("seed", range(4))
def test_hyper_seeded_cut(seed, kind):
    rng = random.Random(seed)
    edges = [(sorted(rng.sample(range(7), rng.randint(2, 5))), rng.randint(1, 3)) for _ in range(6)]
    region = {0, 1, 2, 3, 4}
    unary = {u: Fr(rng.randint(-5, 3), 2) for u in region}

    def cost(s):
        total = sum(unary[u] for u in s)
        for e, w in edges:
            j = len(set(e) & s)
            total += w * ((0 < j < len(e)) if kind == "all_or_nothing" else min(j, len(e) - j))
        return total

    _, value = cuts.hyper_seeded_cut(edges, region, 0, unary, kind)
    assert value == min(cost(s) for s in subsets(5, 0))


@pytest.mark.parametrize("seed", range(6))
def test_global_cut(seed):
    rows, _, _ = graph(seed, 6)
    got = cuts.global_cut(6, {(u, v): w for u in rows for v, w in rows[u].items() if u < v})
    region = Region.of(rows, {u: sum(r.values()) for u, r in rows.items()})
    assert got == min(region.numbers(s)[1] for s in subsets(6, 0) if len(s) < 6)


@pytest.mark.parametrize("seed", range(30))
def test_certificates_keep_an_optimum(seed):
    rows, degree, m = graph(seed, 6, 0.6)
    value = {(u, v): exact.affinity(rows, degree, m, Fr(1), u, v) for u, v in combinations(range(6), 2)}
    best, _, _ = exact.best_partition(6, value)

    def merged(block):
        return max(sum(x for (i, j), x in value.items() if lab[i] == lab[j]) for lab in exact.partitions(6) if len({lab[u] for u in block}) == 1)

    for k in (2, 3):
        for block in map(list, combinations(range(6), k)):
            b = Region.of(rows, degree).within(block)
            for status in (exact.block_certificate(b, m, Fr(1)), exact.contrast_certificate(b, m, Fr(1)), exact.almost_clique(b, m, 1, 1)[0], exact.closure_block(b, m, 1, 1)[0]):
                if status.startswith("verified"):
                    assert merged(block) == best, (block, status)
    for u, v in value:
        if value[u, v] >= 0 and exact.pair_copy(rows, degree, m, u, v, Fr(1))[1] >= 0:
            assert merged([u, v]) == best


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("mode", ["S", "D", "SD", "SW"])
def test_composition_keeps_an_optimum(seed, mode):
    rows, degree, m = graph(seed + 200, 6, 0.6)
    value = {(u, v): exact.affinity(rows, degree, m, Fr(1), u, v) for u, v in combinations(range(6), 2)}
    best, _, _ = exact.best_partition(6, value)
    bank = [list(c) for k in (2, 3, 4) for c in combinations(range(6), k)]
    events = []
    groups, log = compose(rows, degree, m, bank, mode=mode, progress=events.append)
    assert sorted(u for g in groups for u in g) == list(range(6)) and events == log and len(groups) == 6 - sum(x["size"] - 1 for x in log)
    assert max(sum(x for (i, j), x in value.items() if p[i] == p[j]) for p in exact.partitions(6) if all(p[u] == p[g[0]] for g in groups for u in g)) == best
    # forgetting what failed before changes nothing
    q = Quotient(rows, degree, m)
    for step in log:
        assert q.rows.keys() >= set(step["block"])
        q.merge(step["block"])
    assert sorted(sorted(g) for g in q.members.values()) == groups
    if mode == "S":
        assert _pair(q, Fr(1), set()) is None


@pytest.mark.parametrize("seed", range(10))
def test_weighted_copies(seed):
    """Centres and full pairs against their definitions in fractions; a certified block keeps an optimum."""
    rows, degree, m = graph(seed + 300, 6, 0.7)
    value = {(u, v): exact.affinity(rows, degree, m, Fr(1), u, v) for u, v in combinations(range(6), 2)}
    best, _, _ = exact.best_partition(6, value)
    for block in map(list, combinations(range(6), 3)):
        b = Region.of(rows, degree).within(block)
        out = [x for x in rows if x not in block]
        share = {u: {x: Fr(rows[u].get(x, 0), degree[u]) for x in out} for u in block}
        for centre, middle in (("zero", dict.fromkeys(out, Fr(0))), ("anchor", share[block[0]])):
            delta, unit = exact.deviation(b, centre)
            assert [Fr(x, unit) for x in delta] == [sum(abs(share[u][x] - middle[x]) for x in out) for u in block]
        vol = sum(degree[u] for u in block)
        lap = [[Fr(0)] * 3 for _ in block]
        for i, j in combinations(range(3), 2):
            u, v = block[i], block[j]
            c = value[u, v] - sum(abs(degree[v] * rows[u].get(x, 0) - degree[u] * rows[v].get(x, 0)) for x in out) / Fr(vol)
            lap[i][j] = lap[j][i] = -c
            lap[i][i] += c
            lap[j][j] += c
        kind = exact.definiteness([[lap[i][j] - Fr(degree[block[i]], degree[block[0]]) * lap[0][j] - Fr(degree[block[j]], degree[block[0]]) * lap[i][0] + Fr(degree[block[i]] * degree[block[j]], degree[block[0]] ** 2) * lap[0][0] for j in (1, 2)] for i in (1, 2)])
        got = exact.pairs_certificate(b, m, Fr(1))
        assert got == ("failed_exact_psd" if kind == "indefinite" else f"verified_positive_{kind}")
        for status in (got, exact.block_certificate(b, m, Fr(1), "zero"), exact.block_certificate(b, m, Fr(1), "anchor")):
            if status.startswith("verified"):
                assert max(sum(x for (i, j), x in value.items() if lab[i] == lab[j]) for lab in exact.partitions(6) if len({lab[u] for u in block}) == 1) == best


def test_known_matrices():
    kinds = [exact.definiteness([[Fr(x) for x in r] for r in m]) for m in ([[1, 1], [1, 1]], [[0, 0], [0, 1]], [[2, 1], [1, 2]], [[0, 1], [1, 0]], [[1, 2], [2, 1]])]
    assert kinds == ["semidefinite", "semidefinite", "definite", "indefinite", "indefinite"]
    rows, degree = {0: {1: 1}, 1: {0: 1}}, {0: 1, 1: 1}
    assert [exact.block_certificate(Region.of(rows, degree), 2, Fr(g, 2)) for g in (3, 4, 5)] == ["verified_positive_definite", "verified_positive_semidefinite", "failed_exact_psd"]
    assert exact.block_certificate(Region.of({0: {}, 1: {2: 1}, 2: {1: 1}}, {0: 0, 1: 1, 2: 1}).within([0, 1]), 2, Fr(1)) == "zero_degree_excluded"
    assert exact.padded_median([Fr(1, 2)], 2) == Fr(1, 4) and exact.padded_median([Fr(1)], 3) == 0
    assert len(list(exact.partitions(5))) == 52


@pytest.mark.parametrize("seed", range(5))
def test_diffusion_push_and_retrieval(seed):
    rows, degree, m = graph(seed, 9, 0.4)
    region = Region.of(rows, degree)
    mass = 4.0 * degree[0]
    x, settled = diffuse.diffuse(region, 0, mass)
    assert settled and diffuse.residual(region, x, 0, mass) < 1e-8
    assert np.allclose(x, diffuse.settle(region, 0, mass), atol=1e-7)
    first = diffuse.activation_mass(region, 0)
    assert (diffuse.diffuse(region, 0, first * 0.999)[0] > 0).sum() == 1 and (diffuse.diffuse(region, 0, first * 1.01)[0] > 0).sum() > 1
    rank, rest = diffuse.push(region, 0, 0.15, 1e-4)
    assert abs(rank.sum() + rest.sum() - 1) < 1e-9 and all(r <= 1e-4 * degree[u] + 1e-15 for u, r in enumerate(rest))
    for name, how in diffuse.VARIANTS.items():
        r = diffuse.retrieve(region, m, 0, how)
        assert 0 in r["places"] and r["lower_bound"] <= r["z"], name
    s, phi = diffuse.conductance_control(region, m, 0)
    assert 0 < len(s) <= 9 and phi > 0
    small = region.within([0, *list(rows[0])[:1]])
    x = diffuse.settle(small, 0, 50.0 * degree[0])
    assert small.n == 2 and diffuse.raised(small, x).any()
    with pytest.raises(diffuse.RimRaised):
        diffuse.retrieve(small, 100 * m, 0)


def test_large_diffusions_are_settled(monkeypatch):
    """Conjugate gradients and direct solutions agree, from cold and warm starts."""
    rows, degree, m = graph(11, 400, 0.02, 3)
    region = Region.of(rows, degree)
    for share in (0.1, 0.5, 1.5):
        x = diffuse.settle(region, 0, share * m)
        assert diffuse.residual(region, x, 0, share * m) < 1e-8
        monkeypatch.setattr(diffuse, "DIRECT", 0)
        y = diffuse.settle(region, 0, share * m)
        z = diffuse.settle(region, 0, share * m, warm=diffuse.settle(region, 0, share * m / 2))
        monkeypatch.undo()
        assert np.allclose(x, y, rtol=1e-7, atol=1e-9) and np.allclose(x, z, rtol=1e-7, atol=1e-9)


def test_sweep_is_the_best_prefix():
    for seed in range(6):
        rows, degree, m = graph(seed, 8)
        region = Region.of(rows, degree)
        rng = random.Random(seed)
        x = np.array([float(rng.randint(0, 4)) for _ in rows])
        for ties, seeded in ((True, None), (False, None), (True, 3)):
            order = sorted((u for u in rows if x[u] > 0), key=lambda u: (-x[u], u))
            prefixes = [set(order[: i + 1]) for i in range(len(order)) if not ties or i + 1 == len(order) or x[order[i + 1]] < x[order[i]]]
            prefixes = [s for s in prefixes if seeded is None or seeded in s]
            got = diffuse.sweep(region, m, x, seeded, ties=ties)
            if not prefixes:
                assert got is None
                continue
            z = [cuts.quality(region, m, s) for s in prefixes]
            assert got == (prefixes[z.index(min(z))], min(z))


@pytest.mark.parametrize("n", [13, 20, 40])
def test_definiteness_of_large_matrices(n):
    """What doubles prove agrees with elimination over whole numbers."""
    rng = np.random.default_rng(n)
    a = rng.integers(-9, 10, (n, n))
    full, thin = a @ a.T + np.eye(n, dtype=np.int64), a[:, : n // 2] @ a[:, : n // 2].T
    for matrix, kind in ((full, "definite"), (thin, "semidefinite"), (thin - np.diag([0] * (n - 1) + [1]), "indefinite"), (full - 40 * n * np.eye(n, dtype=np.int64), "indefinite")):
        rows = matrix.tolist()
        assert exact._eliminated(rows) == kind == exact.definiteness(rows)
        assert exact.definiteness([[Fr(x, 7) for x in r] for r in rows]) == kind
    assert exact._judged(full.tolist()) == "definite" and exact._judged((full - 40 * n * np.eye(n, dtype=np.int64)).tolist()) == "indefinite"


def test_deviation_is_the_medians():
    for seed in range(8):
        rows, degree, _ = graph(seed + 20, 9, 0.5, 5)
        block = [0, 2, 5, 7][: 3 + seed % 2]
        region = Region.of(rows, degree).within(block)
        delta, unit = exact.deviation(region)
        out = [v for v in rows if v not in block]
        centre = {v: exact.padded_median([Fr(rows[u][v], degree[u]) for u in block if v in rows[u]], len(block)) for v in out}
        want = [sum(abs(Fr(rows[u].get(v, 0), degree[u]) - centre[v]) for v in out) for u in block]
        assert [Fr(x, unit) for x in delta] == want


def test_least_mixture():
    rng = random.Random(3)
    for _ in range(40):
        pulls = [(rng.randint(-9, 9), rng.randint(-9, 9)) for _ in range(rng.randint(1, 6))]
        p, loss = exact.least_mixture(pulls)

        def cost(x):
            return sum(abs(x * (a + b) - a) for a, b in pulls)

        candidates = {Fr(0), Fr(1), *(Fr(a, a + b) for a, b in pulls if a + b and 0 < Fr(a, a + b) < 1)}
        best = min(cost(x) for x in candidates)
        assert loss == best == cost(p) and p == min(x for x in candidates if cost(x) == best)


def test_enclosure_needs_no_convexity():
    points = [(Fr(1), Fr(3)), (Fr(9), Fr(4))]
    null = [Fr(0), Fr(1, 2), Fr(-3, 10), Fr(1, 20)]
    status, low, high = exact.enclose(points, null)
    grid = []
    for (v0, c0), (v1, c1) in zip(points, points[1:]):
        grid += [(c0 + (c1 - c0) * (v - v0) / (v1 - v0) + exact.horner(null, v)) / v for v in (v0 + (v1 - v0) * Fr(i, 300) for i in range(301))]
    assert status == "target_met" and low <= min(grid) and high <= min(grid) + Fr(1, 10**4)
    assert exact.enclose(points, null, pieces=3)[0] == "budget" and exact.enclose(points, null, pieces=3)[1] <= low
    assert exact.horner(null, Fr(3)) == exact.bernstein(null, Fr(1), Fr(3))[-1]


@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_assignment(n, k, seed):
    from itertools import permutations

    w = np.random.default_rng(seed).integers(0, 9, size=(n, k)).astype(float)
    got = sum(w[i, j] for i, j in assign(w))
    a = w if n <= k else w.T
    assert got == max(sum(a[i, p] for i, p in enumerate(q)) for q in permutations(range(a.shape[1]), a.shape[0]))


@given(st.lists(st.integers(0, field61.P - 1), min_size=2, max_size=40))
@settings(max_examples=80, deadline=None)
def test_field(values):
    a, b = np.array(values, dtype=np.uint64), np.array(values[::-1], dtype=np.uint64)
    assert [int(x) for x in field61.mul(a, b)] == [x * y % field61.P for x, y in zip(values, values[::-1])]
    want = 1
    for v in values:
        want = want * v % field61.P
    assert int(field61.segment_products(a[:, None], np.array([0]))[0, 0]) == want


def test_rational_tools():
    x = Fr(1, 3)
    lo, hi = exact.interval(x)
    assert Fr(lo) <= x <= Fr(hi) and lo < hi
    a, b = exact.root_interval(Fr(2))
    assert Fr(a) ** 2 < 2 < Fr(b) ** 2
    assert exact.to_grid(Fr(3, 2), 0) == 2 and exact.to_grid(Fr(1, 2), 0) == 0
    assert exact.convex_on_unit([Fr(0), Fr(0), Fr(1)]) and not exact.convex_on_unit([Fr(0), Fr(0), Fr(-1)])
    status, low, high = exact.enclose([(Fr(2), Fr(4)), (Fr(6), Fr(5)), (Fr(10), Fr(3))], [Fr(0), Fr(0), Fr(1, 10)])
    assert status == "target_met" and high - low <= Fr(1, 10**8)
    good = [[Fr(1), Fr(1), Fr(0)], [Fr(1), Fr(1), Fr(0)], [Fr(0), Fr(0), Fr(1)]]
    assert exact.verify_primal(good) == "feasible"
    bad = [[Fr(1), Fr(9, 10), Fr(9, 10)], [Fr(9, 10), Fr(1), Fr(0)], [Fr(9, 10), Fr(0), Fr(1)]]
    assert exact.verify_primal(bad) == "failed_triangle" and exact.verify_primal(exact.repair_primal(bad)) == "feasible"
    b = [[Fr(0), Fr(2), Fr(1)], [Fr(2), Fr(0), Fr(-3)], [Fr(1), Fr(-3), Fr(0)]]
    best = exact.best_partition(3, {(i, j): b[i][j] for i, j in combinations(range(3), 2)})[0]
    for y in (Fr(0), Fr(1, 2), Fr(1)):
        assert exact.dual_bound(b, {(1, 2, 0): y}) >= best


def test_grouping():
    rows = {u: {} for u in range(8)}
    for block in (range(4), range(4, 8)):
        for u, v in combinations(block, 2):
            rows[u][v] = rows[v][u] = 1
    rows[3][4] = rows[4][3] = 1
    lab = grouping.louvain(rows)
    assert len({lab[u] for u in range(4)}) == 1 and len(set(lab.values())) == 2
    degree = {u: sum(r.values()) for u, r in rows.items()}
    assert sorted(grouping.bisection_order(rows, degree, list(range(8)))[:4]) in ([0, 1, 2, 3], [4, 5, 6, 7])
    bank = grouping.forest(rows, degree, [list(range(8))])
    assert [0, 1, 2, 3] in bank and [4, 5, 6, 7] in bank
    assert grouping.degree_cover(rows) == [3, 5] or len(grouping.degree_cover(rows)) == 2
    b = grouping.nested_bootstrap({"a": [1.0, 2.0], "b": [3.0]}, 200)
    assert b["mean"] == 2.0 and b["mean_low"] <= 2.0 <= b["mean_high"]
    mean, lo, hi = grouping.paired_bootstrap({"a": [1.0, 3.0], "b": [2.0]}, 200)
    assert mean == 2.0 and lo <= 2.0 <= hi
    q = grouping.query_sample([[1, 2, 3], [4, 5], [6]], 2, 2, 7)
    assert len({c for c, _ in q}) == 2


@pytest.mark.parametrize("certificate", [exact.contrast_certificate, exact.pairs_certificate])
def test_certificates_spread_out_no_surroundings(certificate):
    """A block of 200 with 20,000 outside neighbours takes what its edges take; members by neighbours were 32 MB and more."""
    n, far = 200, 20_000
    rng = np.random.default_rng(1)
    ring = np.arange(n)
    u = np.concatenate([ring, (ring + 1) % n, np.repeat(ring, 100)])
    v = np.concatenate([(ring + 1) % n, ring, n + rng.permuted(np.tile(np.arange(far), (n, 1)), axis=1)[:, :100].ravel()])
    degree = np.concatenate([np.full(n, 102), np.full(far, 3)])
    block = Region.build(u, v, np.ones(len(u), np.int64), degree[u], degree[v])
    tracemalloc.start()
    status = certificate(block, int(degree.sum()), Fr(1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert status == "failed_exact_psd" and peak < 16e6
