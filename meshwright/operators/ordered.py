"""Sweeps, prefixes and other operators over an order of vertices or rows.

A prefix' cut is its volume less twice the weight of the edges whose later end is
in it; so a sweep is a rank, one aggregate of edges by their later end's rank, and
running sums. Ranks and running sums over a whole column go in two steps - per
bucket of scores, then across buckets - so that no single task holds all vertices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators.graph import Graph
from meshwright.session import materialize


def running(df: DataFrame, order: str | list[str], sums: list[str], by: list[str], buckets: int = 256) -> DataFrame:
    """(by, order, c_<x>): running sums of the columns ``sums`` per group ``by`` along ``order``.

    Rows of equal ``order`` share their sums (ties are not split). Buckets of its
    first, numeric column are found from approximate quantiles over all groups; a
    bucket is summed by itself and starts from the total of the ones before it.
    """
    along = [order] if isinstance(order, str) else order
    per = df.groupBy(*by, *along).agg(*(F.sum(x).alias(f"_s_{x}") for x in sums))
    per = materialize(per, "steps")
    cuts = sorted(set(per.approxQuantile(along[0], [i / buckets for i in range(1, buckets)], 0.002))) if buckets > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(along[0]))) if cuts else F.lit(0)
    per = per.withColumn("_b", bucket)
    whole = per.groupBy(*by, "_b").agg(*(F.sum(f"_s_{x}").alias(f"_t_{x}") for x in sums))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*by, "_b", *(F.coalesce(F.sum(f"_t_{x}").over(before), F.lit(0)).alias(f"_o_{x}") for x in sums))
    inside = Window.partitionBy(*by, "_b").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    per = per.select(*by, *along, "_b", *(F.sum(f"_s_{x}").over(inside).alias(f"_i_{x}") for x in sums))
    # keys may be null, so the few bucket totals are joined null-safely
    a, b = per.alias("a"), whole.alias("b")
    on = F.col("a._b") == F.col("b._b")
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select(*(F.col(f"a.{k}").alias(k) for k in [*by, *along]), *((F.col(f"a._i_{x}") + F.col(f"b._o_{x}")).alias(f"c_{x}") for x in sums))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, p_0, p_1, ...): exact percentiles with linear interpolation; null values don't count.

    Built on how often each value occurs and running counts, so no task holds a
    group's values, however large the group is. Groups without values are left out.
    """
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).withColumn("_one", F.lit(1).cast("bigint"))
    run = materialize(running(v, "_v", ["_one"], by), "ranks")
    n = run.groupBy(*by).agg(F.max("c__one").alias("n"))
    a, b = run.alias("a"), n.alias("b")
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = a.join(b, on).select(*(F.col(f"a.{k}").alias(k) for k in by), F.col("a._v").alias("_v"), F.col("a.c__one").alias("_c"), "b.n")
    picks = []
    for i, p in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(p)
        picks += [F.min(F.when(F.col("_c") > F.floor(at), F.col("_v"))).alias(f"_l{i}"), F.min(F.when(F.col("_c") > F.ceil(at), F.col("_v"))).alias(f"_h{i}")]
    got = j.groupBy(*by, "n").agg(*picks)

    def between(i: int, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(p)
        return (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (at - F.floor(at))).alias(f"p_{i}")

    return got.select(*by, "n", *(between(i, p) for i, p in enumerate(shares)))


def sweep_steps(g: Graph, scores: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, x, c_n, c_d, c_cut): size, volume and cut of every level set {score >= x} of ``scores`` (key, u, x).

    Only positive scores count. Equal scores enter together.
    """
    s = scores.where(F.col("x") > 0).select(key, "u", "x").join(g.degrees, "u").withColumn("y", -F.col("x"))
    a = s.select(key, "u", F.col("y").alias("yu"))
    b = s.select(key, F.col("u").alias("v"), F.col("y").alias("yv"))
    inner = g.edges.join(a, "u").join(b, ["v", key]).groupBy(key, F.greatest("yu", "yv").alias("y")).agg((-2 * F.sum("w")).alias("cut"))
    zero = F.lit(0).cast("bigint")
    rows = s.groupBy(key, "y").agg(F.count("*").alias("n"), F.sum("d").alias("d")).select(key, "y", "n", "d", F.col("d").alias("cut"))
    rows = rows.unionByName(inner.select(key, "y", zero.alias("n"), zero.alias("d"), "cut"))
    return running(rows, "y", ["n", "d", "cut"], [key]).select(key, (-F.col("y")).alias("x"), F.col("c_n").alias("size"), F.col("c_d").alias("vol"), F.col("c_cut").alias("cut"))


def level_sweep(g: Graph, scores: DataFrame, seeds: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, size, vol, cut, z_num, z_den): the level set with the seed and the least z = cut / vol + vol / m.

    ``seeds`` is (key, seed). Ties are never split; of equal values the smaller set
    is taken. Fractions are compared exactly.
    """
    steps = sweep_steps(g, scores, key)
    at = scores.join(seeds, (scores[key] == seeds[key]) & (scores["u"] == seeds["seed"])).select(scores[key], F.col("x").alias("xs"))
    m = F.lit(g.volume)
    ok = steps.join(at, key).where((F.col("x") <= F.col("xs")) & (F.col("vol") > 0))
    ok = ok.withColumn("z_num", F.col("cut") * m + F.col("vol") * F.col("vol")).withColumn("z_den", m * F.col("vol"))
    return _least(ok, key, "z_num", "z_den")


def _least(df: DataFrame, key: str, num: str, den: str) -> DataFrame:
    """The row of the least num / den per key, exactly; of equal ones the smallest set.

    Fractions of denominators up to 10^18 that differ do so within 36 digits; the
    order of the first and the next 18 digits is therefore that of the fractions,
    and one minimum, combined on the map side, finds the row.
    """
    big = "decimal(38,0)"
    df = df.withColumn("_n", (F.col(num).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")).cast(big)).withColumn("_d", F.nullif(F.col(den), F.lit(0)).cast(big))
    df = df.withColumn("_q", F.expr("_n div _d")).withColumn("_r", ((F.col("_n") - (F.col("_q").cast("decimal(19,0)") * F.col(den).cast("decimal(19,0)")).cast(big)).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")).cast(big))
    df = df.where("_d IS NOT NULL").withColumn("_p", F.expr("_r div _d"))
    rest = [c for c in ("vol", "cut", num, den) if c in df.columns]
    best = F.min(F.struct("_q", "_p", "size", *dict.fromkeys(rest)))
    return df.groupBy(key).agg(best.alias("_b")).select(key, "_b.size", *(f"_b.{c}" for c in dict.fromkeys(rest)))


def vertex_sweep(g: Graph, scores: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, size, vol, cut, den) of the prefix of the least conductance, vertices one by one.

    The order is falling score, then id, so equal scores are split; prefixes of
    volume 0 or all of it don't count; of equal values the shortest is taken.
    """
    s = scores.where(F.col("x") > 0).select(key, "u", "x").join(g.degrees, "u").withColumn("y", -F.col("x"))
    a = s.select(key, "u", F.struct("y", "u").alias("a"))
    b = s.select(key, F.col("u").alias("v"), F.struct("y", "u").alias("b"))
    inner = g.edges.join(a, "u").join(b, ["v", key]).groupBy(key, F.greatest("a", "b").alias("o")).agg((-2 * F.sum("w")).alias("cut"))
    zero = F.lit(0).cast("bigint")
    rows = s.select(key, "y", F.col("u").alias("t"), F.lit(1).cast("bigint").alias("n"), "d", F.col("d").alias("cut"))
    rows = rows.unionByName(inner.select(key, "o.y", F.col("o.u").alias("t"), zero.alias("n"), zero.alias("d"), "cut"))
    steps = running(rows, ["y", "t"], ["n", "d", "cut"], [key]).select(key, F.col("c_n").alias("size"), F.col("c_d").alias("vol"), F.col("c_cut").alias("cut"))
    den = F.least(F.col("vol"), F.lit(g.volume) - F.col("vol"))
    return _least(steps.withColumn("den", den).where("den > 0"), key, "cut", "den")


def capped_region(g: Graph, scores: DataFrame, start: DataFrame, num: int, den: int, key: str = "query_id") -> DataFrame:
    """(key, u): the start set and the longest run of whole score levels that adds at most num / den of its volume.

    Volume counts only outside the start set. It stops before the first level that
    doesn't fit.
    """
    s0 = start.select(key, "u").distinct()
    budget = s0.join(g.degrees, "u").groupBy(key).agg(F.sum("d").alias("v0"))
    s = scores.where(F.col("x") > 0).select(key, "u", "x").join(g.degrees, "u").join(s0.withColumn("_in", F.lit(True)), [key, "u"], "left")
    s = s.withColumn("y", -F.col("x")).withColumn("extra", F.when(F.col("_in"), 0).otherwise(F.col("d")))
    run = running(s, "y", ["extra"], [key]).join(budget, key)
    fits = run.where(F.col("c_extra") * den <= F.col("v0") * num).groupBy(key).agg(F.max("y").alias("last"))
    picked = s.join(fits, key).where(F.col("y") <= F.col("last")).select(key, "u")
    return picked.unionByName(s0).distinct()


def surrogate(g: Graph, region: DataFrame, current: DataFrame, seeds: DataFrame, scores: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, u, num, den): the unary terms of one minorise step, exactly.

    The order is the seed, the current set, the rest of the region, each by falling
    score then id; with D the running degree the term is (D^2 - (D - d)^2) / m - z d,
    over den = m vol(S). Over the current set S the terms sum to minus its cut.
    """
    from meshwright.operators.metrics import set_stats

    z = set_stats(g, current, key).select(key, "z_num", "vol")
    r = region.select(key, "u").distinct().join(g.degrees, "u").join(current.select(key, "u", F.lit(1).alias("_s")).distinct(), [key, "u"], "left").join(seeds, key)
    r = r.join(scores.select(key, "u", "x"), [key, "u"], "left")
    cls = F.when(F.col("u") == F.col("seed"), 0).when(F.col("_s").isNotNull(), 1).otherwise(2)
    w = Window.partitionBy(key).orderBy(cls, F.desc(F.coalesce("x", F.lit(0.0))), "u")
    r = r.withColumn("c", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(z, key)
    first = F.col("c") * F.col("c") - (F.col("c") - F.col("d")) * (F.col("c") - F.col("d"))
    return r.select(key, "u", (first * F.col("vol") - F.col("z_num") * F.col("d")).alias("num"), (F.lit(g.volume) * F.col("vol")).alias("den"))


def prefix_best(rows: DataFrame, key: str, order: str, value: str, lengths: list[int]) -> DataFrame:
    """(key, k, best_at, best): the greatest value among the first k rows of each key, the earliest of equal ones.

    Keys with fewer than k rows have no row for k; nulls are never best.
    """
    w = Window.partitionBy(key).orderBy(order)
    r = rows.select(key, order, value).withColumn("_i", F.row_number().over(w))
    ks = F.array(*map(F.lit, lengths))
    r = r.withColumn("k", F.explode(ks)).where(F.col("_i") <= F.col("k"))
    b = r.groupBy(key, "k").agg(F.count("*").alias("_n"), F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col("_i")).alias("i")))).alias("b"))
    return b.where(F.col("_n") == F.col("k")).select(key, "k", (-F.col("b.i")).alias("best_at"), F.col("b.v").alias("best"))


def canonical_labels(labels: DataFrame) -> DataFrame:
    """(u, l): labels renumbered 0, 1, ... by the least vertex that has them.

    Numbering all groups needs an order of the groups; it runs over one row a group,
    in two steps so that no task sees all of them.
    """
    first = labels.groupBy("l").agg(F.min("u").alias("m"))
    numbered = row_numbers(first, "m").select("l", (F.col("n") - 1).alias("c"))
    return labels.join(numbered, "l").select("u", F.col("c").alias("l"))


def row_numbers(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``n`` = 1, 2, ... along the distinct numeric ``order``, by range partitions."""
    parts = materialize(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_k"))  # one row a partition
    start = sizes.select("_p", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_o"))
    w = Window.partitionBy("_p").orderBy(order)
    return parts.join(start, "_p").withColumn("n", F.row_number().over(w) + F.col("_o")).drop("_p", "_o")


def rotated(df: DataFrame, order: str, by: str, shift: Column, reverse: Column) -> DataFrame:
    """``df`` with ``place``: a cyclic shift of each group's order, reversed where ``reverse`` holds."""
    w = Window.partitionBy(by)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    turned = F.pmod(F.col("_i") - shift, F.col("_n"))
    return r.withColumn("place", F.when(reverse, F.col("_n") - 1 - turned).otherwise(turned)).drop("_i", "_n")


def violated_triangles(pairs: DataFrame, limit: int) -> DataFrame:
    """(i, j, k, violation): the ``limit`` worst breaches of x_ij <= x_ik + x_jk among stored pairs (i, j, x), i < j.

    Ordered by falling violation, then i, j, k: the one bound kept here is the
    report's own length. x must not be negative. Only triangles whose three pairs are
    stored are looked at.
    A breach above top - t, top being the greatest value, takes a pair above that and
    legs below t. So t is raised until the triangles of those pairs and legs alone
    fill the report; only they are joined, and the result is exact without listing
    all triangles.
    """
    both = pairs.select("i", "j", "x").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "x"))
    shares = [2.0 ** (-k / 2) for k in range(28, 0, -1)]
    facts = pairs.agg(F.max("x").alias("top"), F.count("*").alias("n"), F.percentile_approx("x", shares, 100_000).alias("t"), F.approx_count_distinct("i").alias("i"), F.approx_count_distinct("j").alias("j")).first()

    def triangles(some: DataFrame, legs: DataFrame) -> DataFrame:
        a = legs.select("i", F.col("j").alias("k"), F.col("x").alias("xa"))
        b = legs.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("x").alias("xb"))
        t = some.join(a, "i").where("xa < x").join(b, ["j", "k"])
        return t.select("i", "j", "k", (F.col("x") - F.col("xa") - F.col("xb")).alias("violation")).where("violation > 0")

    order = [F.desc("violation"), F.col("i"), F.col("j"), F.col("k")]
    if facts["n"]:
        # the share of values at which as many triangles are to be expected if values are spread evenly; it only says where to begin
        ends = max(facts["i"], facts["j"])
        begin = (limit * 6 / 4) ** (1 / 3) * ends / facts["n"]
        cuts = dict.fromkeys(t for f, t in zip(shares, facts["t"]) if f >= begin and 0 < t < facts["top"])
        for t in cuts:
            low = facts["top"] - t
            got = triangles(pairs.where(F.col("x") > low), both.where(F.col("x") < t)).where(F.col("violation") > low)
            got = materialize(got.orderBy(*order).limit(limit), "worst")
            if got.count() == limit:
                return got.orderBy(*order)
    return triangles(pairs.select("i", "j", "x"), both).orderBy(*order).limit(limit)
