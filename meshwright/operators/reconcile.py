"""Differences between two copies of a table by set reconciliation.

Each side turns its rows into elements of a prime field and keeps, per bucket of
keys, only the values of the characteristic polynomial of its set at a few
agreed points. The quotient of both sides' values is a rational function whose
numerator and denominator have exactly the differing rows as roots; its degree
is bounded by the number of differences, not by the number of rows. A bucket
whose interpolation does not pass at spare points is tried again with twice the
degree bound. Only the rows found to differ are then compared field by field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import field61 as gf
from meshwright.session import materialize

#: Points lie above every row's element, so no polynomial is zero at one.
_BASE = 1 << 60
_SPARE = 2
_POLY = "bucket long, degree int, done boolean, p array<long>, q array<long>"


def points(n: int) -> list[int]:
    """The first ``n`` agreed evaluation points."""
    return [_BASE + (0x9E3779B97F4A7C15 * (k + 1)) % (_BASE - 2) for k in range(n)]


def latest(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row per key: that of the latest ``order``.

    Rows of the same ``order`` tie; the greatest field values are kept, so the
    result does not depend on partitioning. A null ``order`` is the earliest.
    The aggregation combines on the map side, so a hot key costs one row a task.
    """
    best = F.max(F.struct(order, *fields)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{f}").alias(f) for f in fields))


def _hash(columns: list[str], seed: int) -> Column:
    # xxhash64 passes nulls over; a marker keeps null apart from every string
    text = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.xxhash64(F.lit(seed), *text)


def keyed(df: DataFrame, keys: list[str], fields: list[str], side: int, buckets: int) -> DataFrame:
    """``df`` with its side, bucket and field element of 60 bits."""
    return df.select(
        F.lit(side).alias("side"),
        F.pmod(_hash(keys, 7), F.lit(buckets)).alias("bucket"),
        _hash([*keys, *fields], 11).bitwiseAND(F.lit(_BASE - 1)).alias("element"),
        *keys,
        *fields,
    )


def _sketches(batches: Iterator[pd.DataFrame], degree: int) -> Iterator[pd.DataFrame]:
    """Partial products of (z - element) per side and bucket of a task's rows."""
    z = np.array(points(degree + _SPARE), dtype=np.uint64)
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf.sort_values(["bucket", "side"], kind="stable")
        b, s = pdf["bucket"].to_numpy(), pdf["side"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (s[1:] != s[:-1])])
        x = gf.sub(z[None, :], pdf["element"].to_numpy().astype(np.uint64)[:, None])
        prod = gf.segment_products(x, starts).astype(np.int64)
        n = np.diff(np.append(starts, len(b)))
        yield pd.DataFrame({"bucket": b[starts], "side": s[starts], "n": n, "values": list(prod)})


def interpolate(na: int, nb: int, va: list[int], vb: list[int], degree: int) -> tuple[list[int], list[int]] | None:
    """Monic polynomials (p, q) with p / q equal to the quotient of the two sets' polynomials.

    None if the sets differ in more than ``degree`` elements as far as the spare
    points tell; coefficients run from the leading one down.
    """
    delta = na - nb
    if abs(delta) > degree:
        return None
    dp, dq = (degree + delta) // 2, (degree - delta) // 2
    z = points(degree + _SPARE)
    f = [a * pow(b, gf.P - 2, gf.P) % gf.P for a, b in zip(va, vb)]
    rows = []
    for k in range(dp + dq):
        row, power = [], 1
        for _ in range(dp):
            row.append(power)
            power = power * z[k] % gf.P
        lead_p, power = power, 1
        for _ in range(dq):
            row.append(-f[k] * power % gf.P)
            power = power * z[k] % gf.P
        row.append((f[k] * power - lead_p) % gf.P)
        rows.append(row)
    found = gf.solve(rows, dp + dq)
    if found is None:
        return None
    p, q = [1, *found[:dp][::-1]], [1, *found[dp:][::-1]]
    common = gf.poly_gcd(p, q)
    if len(common) > 1:
        p, q = gf.poly_divmod(p, common)[0], gf.poly_divmod(q, common)[0]

    def at(c: list[int], x: int) -> int:
        r = 0
        for v in c:
            r = (r * x + v) % gf.P
        return r

    if all(at(p, x) == y * at(q, x) % gf.P for x, y in zip(z, f)):
        return p, q
    return None


def _solver(degree: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, values = [0, 0], [np.ones(degree + _SPARE, dtype=np.uint64) for _ in (0, 1)]
        for side, count, v in zip(pdf["side"], pdf["n"], pdf["values"]):
            n[side] += int(count)
            values[side] = gf.mul(values[side], np.asarray(v, dtype=np.uint64))
        got = interpolate(*n, *([int(x) for x in v] for v in values), degree)
        p, q = got or ([1], [1])
        row = (int(pdf["bucket"].iloc[0]), degree, got is not None, p, q)
        return pd.DataFrame([row], columns=["bucket", "degree", "done", "p", "q"])

    return run


def _roots(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows whose element is a root of their side's polynomial."""
    for pdf in batches:
        if pdf.empty:
            continue
        hit = np.zeros(len(pdf), dtype=bool)
        x = pdf["element"].to_numpy().astype(np.uint64)
        lengths = pdf["poly"].map(len).to_numpy()
        for d in np.unique(lengths[lengths > 1]):
            at = np.flatnonzero(lengths == d)
            c = np.array(pdf["poly"].iloc[at].tolist(), dtype=np.int64).astype(np.uint64)
            hit[at] = gf.poly_eval(c, x[at]) == 0
        if hit.any():
            yield pdf.loc[hit, columns]


def differing_rows(
    left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], rows: int, rows_per_bucket: int = 64, degree: int = 8
) -> DataFrame:
    """The rows (side, keys, fields) of each side that the other doesn't have alike.

    ``left`` (side 0) and ``right`` (side 1) have one row a key. ``rows`` is about
    how many rows the larger side has; it sets only the number of buckets, which
    grow in number with the data while their size stays. ``degree`` is the first
    bound, doubled for the buckets in which it doesn't hold: a bound of all rows of
    a bucket always holds, so the doubling ends.
    """
    buckets = max(16, rows // rows_per_bucket)
    both = materialize(keyed(left, keys, fields, 0, buckets).unionByName(keyed(right, keys, fields, 1, buckets)), "recon")
    todo, solved = None, []
    while True:
        source = both.select("bucket", "side", "element")
        if todo is not None:
            source = source.join(todo, "bucket", "left_semi")
        d = degree
        sketches = source.mapInPandas(lambda it, d=d: _sketches(it, d), "bucket long, side int, n long, values array<long>")
        polys = materialize(sketches.groupBy("bucket").applyInPandas(_solver(d), _POLY), "recon-poly")
        solved.append(polys.where("done"))
        todo = polys.where(~F.col("done")).select("bucket")
        if todo.isEmpty():
            break
        degree *= 2
    polys = solved[0]
    for more in solved[1:]:
        polys = polys.unionByName(more)
    polys = polys.where((F.size("p") > 1) | (F.size("q") > 1)).select("bucket", "p", "q")
    columns = ["side", *keys, *fields]
    held = both.join(polys, "bucket").select(*columns, "element", F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q")).alias("poly"))
    return held.mapInPandas(lambda it: _roots(it, columns), both.select(*columns).schema)


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], rows: int, names: tuple[str, str], **how) -> DataFrame:
    """(keys, difference): ``missing_in_<side>``, or the name of each field that differs.

    Null differs from any value and equals null. Empty sides are allowed: every
    row of the other is then missing.
    """
    found = differing_rows(left, right, keys, fields, rows, **how)
    sides = found.groupBy(*keys).agg(
        *(F.max(F.col("side") == s).alias(f"_has{s}") for s in (0, 1)),
        *(F.max(F.when(F.col("side") == s, F.col(f))).alias(f"_{s}_{f}") for s in (0, 1) for f in fields),
    )
    missing = F.when(~F.col("_has1"), F.array(F.lit(f"missing_in_{names[1]}"))).when(~F.col("_has0"), F.array(F.lit(f"missing_in_{names[0]}")))
    unlike = [F.when(~F.col(f"_0_{f}").eqNullSafe(F.col(f"_1_{f}")), F.lit(f)) for f in fields]
    return sides.select(*keys, F.explode(F.coalesce(missing, F.array_compact(F.array(*unlike)))).alias("difference"))
