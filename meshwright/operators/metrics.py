"""Exact metrics of sets, partitions and quotients; rationals are (num, den) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators.graph import Graph
from meshwright.operators.ordered import percentiles
from meshwright.session import materialize


def _inner_weight(g: Graph, sets: DataFrame, key: str) -> DataFrame:
    """(key, inner): twice the weight of the edges with both ends in a set; sets may overlap."""
    a = sets.select(key, "u")
    b = sets.select(key, F.col("u").alias("v"))
    return g.adj.join(a, "u").join(b, ["v", key]).groupBy(key).agg(F.sum("w").alias("inner"))


def set_stats(g: Graph, sets: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, size, vol, cut, z_num, z_den) of the sets (key, u).

    z = cut / vol + vol / m = z_num / z_den with m the graph's volume. Vertices the
    graph doesn't have count for the size alone; repeated rows count once; z_den of
    a set without volume is 0.
    """
    sets = sets.select(key, "u").distinct()
    vol = sets.join(g.degrees, "u", "left").groupBy(key).agg(F.count("*").alias("size"), F.coalesce(F.sum("d"), F.lit(0)).alias("vol"))
    cut = F.col("vol") - F.coalesce("inner", F.lit(0))
    m = F.lit(g.volume)
    s = vol.join(_inner_weight(g, sets, key), key, "left").select(key, "size", "vol", cut.alias("cut"))
    return s.withColumn("z_num", F.col("cut") * m + F.col("vol") * F.col("vol")).withColumn("z_den", m * F.col("vol"))


def conductance(g: Graph, stats: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, cut, den): cut / min(vol, m - vol); den is null where that isn't positive."""
    den = F.least(F.col("vol"), F.lit(g.volume) - F.col("vol"))
    return stats.select(key, "cut", F.when(den > 0, den).alias("den"))


def phi_bin(phi: Column) -> Column:
    """The bin of a conductance: 0.1 for [.05, .15) to 0.6 for [.55, .65), else null."""
    edges = [(i, (2 * i - 1) / 20, (2 * i + 1) / 20) for i in range(1, 7)]
    return F.coalesce(*(F.when((phi >= lo) & (phi < hi), F.lit(f"0.{i}")) for i, lo, hi in edges))


def partition_stats(g: Graph, labels: DataFrame) -> DataFrame:
    """(groups, phi_mean, phi_q25, phi_q50, phi_q75, outside) over the groups of a partition (u, l).

    phi is a group's conductance, its mean weighted by volume; ``outside`` is the
    share of all volume that runs between groups. Groups without conductance are
    left out of the quantiles.
    """
    s = set_stats(g, labels.withColumnRenamed("l", "set_id"))
    c = s.join(conductance(g, s).select("set_id", "den"), "set_id")
    c = materialize(c.select("vol", "cut", "den", (F.col("cut") / F.col("den")).alias("phi")), "phi")
    whole = c.agg(
        F.count("*").alias("groups"),
        (F.sum(F.col("phi") * F.col("vol")) / F.sum(F.when(F.col("den").isNotNull(), F.col("vol")))).alias("phi_mean"),
        F.try_divide(F.sum("cut"), F.lit(g.volume)).alias("outside"),
    )
    q = percentiles(c, [], "phi", [0.25, 0.5, 0.75]).select(F.col("p_0").alias("phi_q25"), F.col("p_1").alias("phi_q50"), F.col("p_2").alias("phi_q75"))
    return whole.join(q, F.lit(True), "left").select("groups", "phi_mean", "phi_q25", "phi_q50", "phi_q75", "outside")


def modularity(g: Graph, labels: DataFrame, gammas: list[tuple[int, int]]) -> DataFrame:
    """(p, q, within, vol2, num, den) of a partition (u, l) at each resolution p / q.

    The value is num / den = (q m within - p vol2) / (q m^2): ``within`` is twice the
    weight inside groups, ``vol2`` the sum of squared group volumes. Vertices
    without a label belong to no group.
    """
    lab = labels.select("u", "l").dropDuplicates(["u"])
    vol2 = g.degrees.join(lab, "u").groupBy("l").agg(F.sum("d").alias("v")).agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0)).alias("vol2"))
    ends = g.edges.join(lab, "u").join(lab.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v")
    within = ends.where(F.col("l") == F.col("lv")).agg(F.coalesce(F.sum("w") * 2, F.lit(0)).alias("within"))
    kinds = F.array(*(F.struct(F.lit(p).cast("bigint").alias("p"), F.lit(q).cast("bigint").alias("q")) for p, q in gammas))
    one = within.join(vol2, F.lit(True)).select("within", "vol2", F.inline(kinds))  # one row each
    m = F.lit(g.volume).cast("bigint")
    return one.select("p", "q", "within", "vol2", (F.col("q") * m * F.col("within") - F.col("p") * F.col("vol2")).alias("num"), (F.col("q") * m * m).alias("den"))


def quotient(g: Graph, labels: DataFrame) -> DataFrame:
    """(gu, gv, w): the graph of groups, both directions; the diagonal holds twice the inner weight.

    Ends without a label are groups of their own under their id.
    """
    lab = labels.select("u", F.col("l").cast("string").alias("l")).dropDuplicates(["u"])
    j = g.adj.join(lab, "u", "left").join(lab.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v", "left")
    gu, gv = F.coalesce("l", F.col("u").cast("string")), F.coalesce("lv", F.col("v").cast("string"))
    return j.groupBy(gu.alias("gu"), gv.alias("gv")).agg(F.sum("w").alias("w"))


def quotient_mismatches(g: Graph, labels: DataFrame, quotiented: DataFrame) -> DataFrame:
    """(g, d_quotient, d_direct) of groups whose degree in the quotient isn't the sum of its members'."""
    lab = labels.select("u", F.col("l").cast("string").alias("l")).dropDuplicates(["u"])
    direct = g.degrees.join(lab, "u", "left").groupBy(F.coalesce("l", F.col("u").cast("string")).alias("g")).agg(F.sum("d").alias("d_direct"))
    made = quotiented.groupBy(F.col("gu").alias("g")).agg(F.sum("w").alias("d_quotient"))
    both = made.join(direct, "g", "full_outer")
    return both.where(~F.col("d_quotient").eqNullSafe(F.col("d_direct"))).select("g", "d_quotient", "d_direct")


def lift(first: DataFrame, second: DataFrame) -> DataFrame:
    """(u, l): labels (g, l) of groups carried to their members (u, g)."""
    return first.select("u", "g").join(second.select("g", "l"), "g").select("u", "l")


def reduction(membership: DataFrame) -> DataFrame:
    """(vertices, groups, merged_groups, removed): what contracting the groups (u, g) saves."""
    n = membership.groupBy("g").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("vertices"), F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("merged_groups"), F.sum(F.col("n") - 1).alias("removed"))


def crossing(membership: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, labels): groups whose members have more than one label, so that contracting them loses the partition."""
    j = membership.select("u", "g").join(labels.select("u", "l"), "u")
    return j.groupBy("g").agg(F.count_distinct("l").alias("labels")).where("labels > 1")


def set_scores(predicted: DataFrame, truth: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, tp, predicted, actual, apart, exact) of each pair of sets (key, u).

    F1 is 2 tp / (predicted + actual); ``apart`` is the symmetric difference. A set
    missing on one side is empty there.
    """
    p = predicted.select(key, "u", F.lit(1).alias("p")).distinct()
    t = truth.select(key, "u", F.lit(1).alias("t")).distinct()
    n = p.join(t, [key, "u"], "full_outer").groupBy(key).agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("predicted"), F.count("t").alias("actual"))
    apart = F.col("predicted") + F.col("actual") - 2 * F.col("tp")
    return n.select(key, "tp", "predicted", "actual", apart.alias("apart"), (apart == 0).alias("exact"))


def failure_class(predicted: DataFrame, truth: DataFrame, region: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, failure_class): null if the truth is found, H2 if it lies in the region searched, else H1."""
    lost = truth.select(key, "u").distinct().join(region.select(key, "u").distinct(), [key, "u"], "left_anti").groupBy(key).agg(F.count("*").alias("lost"))
    s = set_scores(predicted, truth, key).join(lost, key, "left")
    return s.select(key, F.when(F.col("exact"), None).when(F.coalesce("lost", F.lit(0)) == 0, F.lit("H2")).otherwise(F.lit("H1")).alias("failure_class"))
