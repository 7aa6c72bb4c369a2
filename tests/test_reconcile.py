"""Set reconciliation and manifests against a plain comparison."""

import random
from datetime import datetime

import pytest

from meshwright.functions import field61 as gf
from meshwright.operators import manifests, reconcile

SCHEMA = "release_id string, path string, bytes long, sha256 string, origin string, recorded_at timestamp, side string, bucket int, element string"
T = [datetime(2020, 1, k + 1) for k in range(5)]


def table(spark, rows):
    return spark.createDataFrame([(r, p, b, s, "o", t, "x", 1, "y") for r, p, b, s, t in rows], SCHEMA)


def found(spark, a, b, **how):
    return {tuple(r) for r in manifests.manifest_differences(table(spark, a), table(spark, b), **how).collect()}


def test_forms_nulls_ties_and_repeats(spark):
    a = [
        ("r", " ./a//b.txt ", 1, "SHA256:AB", T[0]), ("r", "é.txt", 2, "cd", T[0]), ("r", "c", None, None, T[0]), ("r", "d", None, "aa", T[0]),
        ("r", "e", 5, "aa", T[0]), ("r", "e", 6, "aa", T[1]), ("r", "f", 1, "aa", T[1]), ("r", "f", 2, "aa", T[1]), ("r", "g\\h", 1, "a", None), ("r", "A", 1, "a", T[0]),
        ("r", "x/../y", 1, "0x1f", T[0]), ("r", "only", 1, "a", T[0]), (None, "n", 1, "a", T[0]), ("r", None, 1, "a", T[0]), ("r", "dup", 1, "a", T[0]), ("r", "dup", 1, "a", T[0]),
    ]
    b = [
        ("r", "a/b.txt", 1, "ab", T[3]), ("r", "é.txt", 2, "cd ", T[0]), ("r", "c", None, "", T[0]), ("r", "d", 1, None, T[0]),
        ("r", "e", 6, "sha256:aa", T[0]), ("r", "f", 2, "AA", T[4]), ("r", "g/h", 1, "a", T[0]), ("r", "a", 1, "a", T[0]),
        ("r", "y", 1, "1F", T[0]), (None, "n", 2, "a", T[0]), ("r", None, 1, "a", T[0]), ("r", "dup", 1, "a", T[0]),
    ]
    assert found(spark, a, b) == {
        ("r", "d", "bytes"), ("r", "d", "sha256"), ("r", "A", "missing_in_mirror"), ("r", "a", "missing_in_primary"), ("r", "only", "missing_in_mirror"), (None, "n", "bytes"),
    }


def test_empty_sides(spark):
    one = [("r", "a", 1, "x", T[0])]
    assert found(spark, [], []) == set()
    assert found(spark, one, []) == {("r", "a", "missing_in_mirror")}
    assert found(spark, [], one) == {("r", "a", "missing_in_primary")}


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.6])
def test_random_tables_and_doubling(spark, rate):
    """Few buckets and a low first bound: the bound is doubled up to all rows of a bucket."""
    rng = random.Random(int(rate * 100))
    a = [("hot" if i % 3 else f"r{i % 7}", f"p{i}", i, f"{i:x}", T[0]) for i in range(400)]
    b, want = [], set()
    for r, p, n, s, t in a:
        x = rng.random()
        if x < rate / 3:
            want.add((r, p, "missing_in_mirror"))
        elif x < 2 * rate / 3:
            b.append((r, p, n + 1, s, t))
            want.add((r, p, "bytes"))
        elif x < rate:
            b.append((r, p, n, s + "f", t))
            want.add((r, p, "sha256"))
        else:
            b.append((r, p, n, s, t))
    b.append(("new", "p", 1, "a", T[0]))
    want.add(("new", "p", "missing_in_primary"))
    assert found(spark, a, b, rows_per_bucket=40, degree=2) == want


@pytest.mark.parametrize("na,nb", [(0, 0), (3, 0), (0, 2), (5, 5), (9, 4)])
def test_interpolation(na, nb):
    rng = random.Random(na * 10 + nb)
    common = [rng.randrange(reconcile._BASE) for _ in range(20)]
    left, right = ([rng.randrange(reconcile._BASE) for _ in range(n)] for n in (na, nb))

    def values(s, d):
        out = []
        for z in reconcile.points(d + 2):
            v = 1
            for x in s:
                v = v * (z - x) % gf.P
            out.append(v)
        return out

    d = max(2, na + nb)
    p, q = reconcile.interpolate(20 + na, 20 + nb, values(common + left, d), values(common + right, d), d)
    assert (len(p) - 1, len(q) - 1) == (na, nb)
    for c, roots in ((p, left), (q, right)):
        for x in roots:
            r = 0
            for k in c:
                r = (r * x + k) % gf.P
            assert r == 0
    if na + nb > 3:
        assert reconcile.interpolate(20 + na, 20 + nb, values(common + left, 2), values(common + right, 2), 2) is None


def test_paths_that_leave_the_root_stay_apart(spark):
    from pyspark.sql import functions as F

    from meshwright.operators.manifests import clean_path

    cases = {"../a": "../a", "a": "a", "x/../../a": "../a", "../../a/../b": "../../b", "./x//y/../z": "x/z", "..": "..", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", clean_path(F.col("p")).alias("q")).collect()
    assert {r["p"]: r["q"] for r in rows} == cases
