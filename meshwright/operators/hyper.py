"""Hypergraphs as incidence tables ``inc(e, u)`` with ``hedge(e, r, theta)``.

A splitting profile w gives an edge's cut by how many of its members j lie inside:
all-or-nothing is 1 for 0 < j < r, cardinality is min(j, r - j).
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.operators.graph import held
from meshwright.session import materialize, table


def profile(kind: str, j: Column, r: Column) -> Column:
    """The splitting value of j of r members; unknown kinds are rejected."""
    if kind == "all_or_nothing":
        return F.when((j > 0) & (j < r), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    if kind == "cardinality_min":
        return F.least(j, r - j).cast("bigint")
    raise ValueError(f"unknown splitting {kind!r}")


def concave(values: list[Fraction | int]) -> bool:
    """Whether a profile is symmetric, zero at both ends, not negative and concave."""
    w = [Fraction(v) for v in values]
    steps = [b - a for a, b in zip(w, w[1:])]
    return len(w) > 2 and w[0] == 0 and w == w[::-1] and min(w) >= 0 and all(a >= b for a, b in zip(steps, steps[1:]))


def capped_minima(values: list[int]) -> list[tuple[int, Fraction]]:
    """(k, weight) with w(j) = sum of weight * min(j, r - j, k): second differences of a concave profile."""
    r = len(values) - 1
    half = r // 2
    w = [Fraction(v) for v in values[: half + 1]]
    steps = [w[k + 1] - w[k] for k in range(half)]
    out = [(k, steps[k - 1] - (steps[k] if k < half else 0)) for k in range(1, half + 1)]
    return [(k, c) for k, c in out if c]


def h_order(spark: SparkSession, d: str) -> DataFrame:
    """inc(e, u): orders are hyperedges over their distinct parts; those of one part are left out."""

    def make() -> DataFrame:
        pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_partkey").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
        wide = pairs.groupBy("u").agg(F.count("*").alias("w")).where("w > 1")
        return pairs.join(wide, "u").select("u", "v", "w")

    e = held(spark, d, "h_order", make).edges
    return e.select(F.col("u").alias("e"), F.col("v").alias("u"), F.col("w").alias("r"))


def degrees(inc: DataFrame) -> DataFrame:
    """(u, d): how many hyperedges hold each vertex, all of weight 1."""
    return inc.groupBy("u").agg(F.count("*").alias("d"))


def volume(inc: DataFrame) -> int:
    return inc.count()


def set_cut(inc: DataFrame, sets: DataFrame, kind: str, key: str = "set_id") -> DataFrame:
    """(key, size, vol, cut) of sets (key, u): the cut sums the splitting value over hyperedges touched."""
    s = sets.select(key, "u").distinct()
    d = degrees(inc)
    vol = s.join(d, "u", "left").groupBy(key).agg(F.count("*").alias("size"), F.coalesce(F.sum("d"), F.lit(0)).alias("vol"))
    j = inc.join(s, "u").groupBy(key, "e", "r").agg(F.count("*").alias("j"))
    cut = j.groupBy(key).agg(F.sum(profile(kind, F.col("j"), F.col("r"))).alias("cut"))
    return vol.join(cut, key, "left").select(key, "size", "vol", F.coalesce("cut", F.lit(0)).alias("cut"))


def null_polynomial(ranks: dict[int, int], m: int, kind: str = "all_or_nothing") -> list[Fraction]:
    """Coefficients of G(v) = v - sum over ranks of count * E[w(Binomial(r, v / m))], constant first.

    ``ranks`` maps a rank to how many hyperedges have it: a few rows, whatever the
    data. The expectation is the polynomial in v / m with control values w(0), ...,
    w(r), so its k-th coefficient is C(r, k) times their k-th difference at 0.
    """
    out = [Fraction(0)] * (max(ranks) + 1)
    out[1] = Fraction(1)
    for r, count in ranks.items():
        differences = [int(0 < j < r) if kind == "all_or_nothing" else min(j, r - j) for j in range(r + 1)]
        for k in range(r + 1):
            out[k] -= Fraction(count * comb(r, k) * differences[0], m**k)
            differences = [b - a for a, b in zip(differences, differences[1:])]
    return out


def set_quality(inc: DataFrame, sets: DataFrame, kind: str = "all_or_nothing", key: str = "set_id") -> DataFrame:
    """(key, size, vol, cut, g, z): z = (cut + G(vol)) / vol in doubles; null for sets without volume."""
    s = set_cut(inc, sets, kind, key)
    ranks = {int(x["r"]): int(x["n"]) for x in inc.select("e", "r").distinct().groupBy("r").agg(F.count("*").alias("n")).collect()}
    m = volume(inc)
    if not ranks:
        return s.withColumn("g", F.lit(0.0)).withColumn("z", F.lit(None).cast("double"))
    # Horner in v / m keeps the doubles near 1
    scaled = [float(c * Fraction(m) ** k) for k, c in enumerate(null_polynomial(ranks, m, kind))]
    x = F.col("vol") / F.lit(float(m))
    g = F.lit(0.0)
    for c in reversed(scaled):
        g = g * x + F.lit(c)
    s = s.withColumn("g", g)
    return s.withColumn("z", F.when(F.col("vol") > 0, (F.col("cut") + F.col("g")) / F.col("vol")))


def sweep_steps(inc: DataFrame, scores: DataFrame, kind: str, key: str = "query_id") -> DataFrame:
    """(key, x, size, vol, cut) of every level set of positive scores (key, u, x); equal scores enter together.

    Within a hyperedge members enter by falling score; when the j-th has come in the
    cut changes by w(j) - w(j - 1), booked at that member's score.
    """
    from meshwright.operators.ordered import running

    s = scores.where(F.col("x") > 0).select(key, "u", "x")
    rows = inc.join(s, "u")
    w = Window.partitionBy(key, "e").orderBy(F.desc("x"), "u")
    rows = rows.withColumn("j", F.row_number().over(w))
    step = profile(kind, F.col("j"), F.col("r")) - profile(kind, F.col("j") - 1, F.col("r"))
    per = rows.groupBy(key, F.col("x")).agg(F.count("*").alias("vol"), F.sum(step).alias("cut"))
    size = s.groupBy(key, "x").agg(F.count("*").alias("size"))
    per = size.join(per, [key, "x"], "left").select(key, (-F.col("x")).alias("y"), "size", F.coalesce("vol", F.lit(0)).alias("vol"), F.coalesce("cut", F.lit(0)).alias("cut"))
    run = running(per, "y", ["size", "vol", "cut"], [key])
    return run.select(key, (-F.col("y")).alias("x"), F.col("c_size").alias("size"), F.col("c_vol").alias("vol"), F.col("c_cut").alias("cut"))


def clique_expansion(inc: DataFrame) -> DataFrame:
    """(u, v, weight): each hyperedge gives 1 / (r - 1) to every pair of its members, so degrees stay."""
    a = inc.select("e", "u", "r")
    b = inc.select("e", F.col("u").alias("v"))
    return a.join(b, "e").where(F.col("u") < F.col("v")).groupBy("u", "v").agg(F.sum(1.0 / (F.col("r") - 1)).alias("weight"))


def gradient_ends(inc: DataFrame, heights: DataFrame) -> DataFrame:
    """(e, first_u, last_u, fall): each hyperedge's highest and lowest member and their difference in height.

    Under the all-or-nothing profile the first maximum and the last minimum in the
    order of falling height, then id, carry the hyperedge's pull. Members without a
    height have 0.
    """
    h = inc.join(heights.select("u", "x"), "u", "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    first = F.min(F.struct((-F.col("x")).alias("y"), "u"))
    last = F.max(F.struct((-F.col("x")).alias("y"), "u"))
    ends = h.groupBy("e").agg(first.alias("a"), last.alias("b"))
    return ends.select("e", F.col("a.u").alias("first_u"), F.col("b.u").alias("last_u"), (F.col("b.y") - F.col("a.y")).alias("fall"))


def top_l_epochs(inc: DataFrame, seed: int, mass: float, epochs: int, eta: float = 0.5, sigma: float = 1e-4, k: int = 50) -> DataFrame:
    """(u, x) after some epochs of projected dual ascent on a hypergraph with the all-or-nothing profile.

    Each epoch all active heights move at once; of the others, touched through a
    hyperedge, the ``k`` with the greatest push come in (ties by id).
    """
    d = materialize(degrees(inc), "hdeg")
    x = materialize(d.where(F.col("u") == seed).select("u", F.lit(0.0).alias("x")), "heights")
    for _ in range(epochs):
        touched = inc.join(x.select("u"), "u", "left_semi").select("e").distinct()
        local = inc.join(touched, "e", "left_semi")
        ends = gradient_ends(local, x)
        pull = ends.select(F.col("first_u").alias("u"), F.col("fall").alias("g")).unionByName(ends.select(F.col("last_u").alias("u"), (-F.col("fall")).alias("g")))
        pull = pull.groupBy("u").agg(F.sum("g").alias("g"))
        near = local.select("u").distinct().unionByName(x.select("u")).distinct().join(d, "u").join(x, "u", "left").join(pull, "u", "left")
        h = F.coalesce("x", F.lit(0.0))
        grad = F.col("d") * (1 + sigma * h) + F.coalesce("g", F.lit(0.0)) - F.when(F.col("u") == seed, mass).otherwise(0.0)
        moved = near.select("u", F.col("x").isNotNull().alias("active"), F.greatest(h - eta * grad / F.col("d"), F.lit(0.0)).alias("y"))
        grown = moved.where(~F.col("active") & (F.col("y") > 0)).orderBy(F.desc("y"), "u").limit(k)
        x = materialize(moved.where("active").unionByName(grown).where((F.col("y") > 0) | (F.col("u") == seed)).select("u", F.col("y").alias("x")), "heights")
    return x
