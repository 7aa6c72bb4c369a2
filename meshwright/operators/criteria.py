"""Exact criteria for merging the ends of an edge, and block deviations.

c = q m w - p du dv is an edge's affinity at resolution p / q. Sums over all other
vertices are written as sums over stored neighbours plus a closed form, so that no
table of all pairs appears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators.graph import Graph
from meshwright.operators.meetings import common
from meshwright.session import materialize


def _row_totals(g: Graph, p: int, q: int) -> DataFrame:
    """(u, t): the summed absolute affinities of a vertex to all others.

    Non-neighbours contribute p du dv each, in sum p du (m - du) less the neighbours' part.
    """
    m = g.volume
    a = g.weighed.select("u", "v", "w", "du", "dv").unionByName(g.weighed.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", F.col("dv").alias("du"), F.col("du").alias("dv")))
    null = F.lit(p) * F.col("du") * F.col("dv")
    stored = a.groupBy("u", "du").agg(F.sum(F.abs(F.lit(q * m) * F.col("w") - null) - null).alias("s"))
    return stored.select("u", (F.lit(p) * F.col("du") * (F.lit(m) - F.col("du")) + F.col("s")).alias("t"))


def _margins(g: Graph, p: int, q: int) -> DataFrame:
    t = _row_totals(g, p, q)
    e = g.affinities(p, q).join(t.withColumnRenamed("t", "tu"), "u").join(t.select(F.col("u").alias("v"), F.col("t").alias("tv")), "v")
    return e.select("u", "v", "c", (2 * F.col("c") - F.col("tu")).alias("mu"), (2 * F.col("c") - F.col("tv")).alias("mv"))


def singleton_dominance(g: Graph, p: int = 1, q: int = 1, strict: bool = True) -> DataFrame:
    """(u, v, margin, witness) of the edges more attractive than all else at one end together.

    The witness is the end with the greater margin, u in a tie.
    """
    best = F.greatest("mu", "mv")
    ok = best > 0 if strict else best >= 0
    e = _margins(g, p, q).where((F.col("c") > 0) & ok)
    return e.select("u", "v", best.alias("margin"), F.when(F.col("mu") >= F.col("mv"), F.col("u")).otherwise(F.col("v")).alias("witness"))


def singleton_interval(g: Graph, low: tuple[int, int], high: tuple[int, int], strict: bool = True) -> DataFrame:
    """(u, v, witness, margin_low, margin_high): edges that pass at both ends of a resolution interval with one witness.

    The margin is concave in the resolution, so such an edge passes in between too.
    Of two witnesses u is given.
    """
    lo = _margins(g, *low).select("u", "v", F.col("mu").alias("lu"), F.col("mv").alias("lv"))
    hi = _margins(g, *high).where("c > 0").select("u", "v", F.col("mu").alias("hu"), F.col("mv").alias("hv"))
    e = lo.join(hi, ["u", "v"])

    def passes(a: str, b: str):
        return F.least(a, b) > 0 if strict else F.least(a, b) >= 0

    u, v = passes("lu", "hu"), passes("lv", "hv")
    e = e.where(u | v)
    pick = [F.when(u, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("u", "v", "witness"), ("lu", "lv", "margin_low"), ("hu", "hv", "margin_high"))]
    return e.select("u", "v", *pick)


def positive_closure(g: Graph, p: int = 1, q: int = 1, strict: bool = True) -> DataFrame:
    """(u, v, margin, repaid): edges whose affinity outweighs both ends' others less what common neighbours repay.

    margin = 3 c - P_u - P_v + sum over common positive neighbours of the lesser
    affinity; P is a vertex' positive affinities. Edges that can't pass even if all
    were repaid are left out before the wedge join, and wedges start at the end of
    fewer neighbours.
    """
    pos = g.affinities(p, q).where("c > 0").select("u", "v", "c")
    both = pos.unionByName(pos.select(F.col("v").alias("u"), F.col("u").alias("v"), "c"))
    total = both.groupBy("u").agg(F.sum("c").alias("p"), F.count("*").alias("k"))
    e = pos.join(total.select("u", F.col("p").alias("pu"), F.col("k").alias("ku")), "u").join(total.select(F.col("u").alias("v"), F.col("p").alias("pv"), F.col("k").alias("kv")), "v")
    # what is repaid is at most the lesser of both ends' other affinities
    most = 3 * F.col("c") - F.col("pu") - F.col("pv") + F.least(F.col("pu"), F.col("pv")) - F.col("c")
    e = e.where(most >= 0).withColumn("a", F.when(F.col("ku") <= F.col("kv"), F.col("u")).otherwise(F.col("v"))).withColumn("b", F.when(F.col("ku") <= F.col("kv"), F.col("v")).otherwise(F.col("u")))
    one = both.select(F.col("u").alias("a"), F.col("v").alias("x"), F.col("c").alias("ca"))
    two = both.select(F.col("u").alias("b"), F.col("v").alias("x"), F.col("c").alias("cb"))
    wedge = e.select("u", "v", "a", "b").join(one, "a").join(two, ["b", "x"]).groupBy("u", "v").agg(F.sum(F.least("ca", "cb")).alias("repaid"))
    e = e.join(wedge, ["u", "v"], "left").withColumn("repaid", F.coalesce("repaid", F.lit(0)))
    margin = 3 * F.col("c") - F.col("pu") - F.col("pv") + F.col("repaid")
    return e.select("u", "v", margin.alias("margin"), "repaid").where("margin > 0" if strict else "margin >= 0")


def proportional_twins(g: Graph, p: int = 1, q: int = 1) -> DataFrame:
    """(u, v, c): edges of affinity >= 0 whose ends have the same neighbours in proportion to their degrees.

    For every other x, dv A_ux = du A_vx. Profiles differ unless both have as many
    other neighbours and all of them in common, so counting equal common ones decides.
    """
    e = g.affinities(p, q).where((F.col("c") >= 0) & (F.col("du") > 0) & (F.col("dv") > 0))
    k = g.adj.groupBy("u").agg(F.count("*").alias("k"))
    e = e.join(k.withColumnRenamed("k", "ku"), "u").join(k.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v").where("ku = kv")
    a = g.adj.select("u", F.col("v").alias("x"), F.col("w").alias("wa"))
    b = g.adj.select(F.col("u").alias("v"), F.col("v").alias("x"), F.col("w").alias("wb"))
    shared = e.select("u", "v", "du", "dv").join(a, "u").join(b, ["v", "x"]).where(F.col("dv") * F.col("wa") == F.col("du") * F.col("wb")).groupBy("u", "v").agg(F.count("*").alias("same"))
    e = e.join(shared, ["u", "v"], "left")
    return e.where(F.coalesce("same", F.lit(0)) == F.col("ku") - 1).select("u", "v", "c")


def profile_penalty(g: Graph, pairs: DataFrame) -> DataFrame:
    """(u, v, num, den): how far the pairs' neighbourhoods are from proportional.

    num / den = sum over other x of |dv A_ux - du A_vx| / (du + dv); a neighbour of
    one alone counts in full, so only common neighbours take something off the sum of
    both. Pairs with a vertex the graph doesn't have are left out.
    """
    du = g.degrees.select("u", F.col("d").alias("du"))
    e = pairs.select("u", "v").distinct().join(du, "u").join(du.select(F.col("u").alias("v"), F.col("du").alias("dv")), "v")
    e = e.join(g.adj, ["u", "v"], "left").select("u", "v", "du", "dv", F.coalesce("w", F.lit(0)).alias("w"))
    e = materialize(e, "pairs")
    s = common(g, e.select("u", "v", "du", "dv")).groupBy("u", "v").agg(F.sum(F.least(F.col("dv") * F.col("wu"), F.col("du") * F.col("wv"))).alias("s"))
    s = materialize(s, "shared")
    num = F.col("dv") * (F.col("du") - F.col("w")) + F.col("du") * (F.col("dv") - F.col("w")) - 2 * F.coalesce("s", F.lit(0))
    return e.join(s, ["u", "v"], "left").select("u", "v", num.alias("num"), (F.col("du") + F.col("dv")).alias("den"))


def exterior_deviation(g: Graph, blocks: DataFrame) -> DataFrame:
    """(block_id, u, delta, mean): each member's distance from its block's median neighbourhood outside.

    Rows are A_ux / d_u over x outside the block. The centre at x is the ordinary
    median over the members, those without the edge counting as 0; delta is the
    absolute distance summed over x, mean its degree-weighted mean over the block.
    Members of degree 0 are left out.
    """
    b = blocks.select("block_id", "u").distinct().join(g.degrees, "u").where("d > 0")
    size = b.groupBy("block_id").agg(F.count("*").alias("k"))
    inside = b.select("block_id", F.col("u").alias("v"))
    rows = b.join(g.adj, "u").join(inside, ["block_id", "v"], "left_anti").select("block_id", "u", F.col("v").alias("x"), (F.col("w") / F.col("d")).alias("r"))
    cols = rows.groupBy("block_id", "x").agg(F.count("*").alias("n")).join(size, "block_id").where(2 * F.col("n") >= F.col("k"))
    w = Window.partitionBy("block_id", "x").orderBy("r")
    ranked = rows.join(cols, ["block_id", "x"]).withColumn("i", F.row_number().over(w) + F.col("k") - F.col("n") - 1)
    odd = F.col("k") % 2 == 1
    half = F.floor(F.col("k") / 2)
    middle = F.when(odd, F.when(F.col("i") == half, F.col("r"))).otherwise(F.when(F.col("i").isin(half - 1, half) | (F.col("i") == half - 1), F.col("r") / 2))
    centre = ranked.groupBy("block_id", "x").agg(F.coalesce(F.sum(middle), F.lit(0.0)).alias("c")).where("c > 0")
    whole = centre.groupBy("block_id").agg(F.sum("c").alias("cs"))
    per = rows.join(centre, ["block_id", "x"], "left").groupBy("block_id", "u").agg(F.sum("r").alias("rs"), F.sum(F.least("r", F.coalesce("c", F.lit(0.0)))).alias("both"))
    delta = F.coalesce("rs", F.lit(0.0)) + F.coalesce("cs", F.lit(0.0)) - 2 * F.coalesce("both", F.lit(0.0))
    d = b.join(per, ["block_id", "u"], "left").join(whole, "block_id", "left").select("block_id", "u", "d", F.greatest(delta, F.lit(0.0)).alias("delta"))
    mean = d.groupBy("block_id").agg((F.sum(F.col("d") * F.col("delta")) / F.sum("d")).alias("mean"))
    return d.join(mean, "block_id").select("block_id", "u", "delta", "mean")
