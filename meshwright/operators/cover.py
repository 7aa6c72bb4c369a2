"""Overlapping covers ``cover(cid, node)``: intersections, scores and information.

Groups are told apart by ``cid``, so equal groups stay two; repeated members count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.assign import assign


def members(cover: DataFrame) -> DataFrame:
    return cover.select("cid", "node").where("cid IS NOT NULL AND node IS NOT NULL").distinct()


def intersections(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(tcid, pcid, both, t, p) of the groups that meet, with their sizes: an equi-join on the node."""
    t, p = members(truth).withColumnRenamed("cid", "tcid"), members(predicted).withColumnRenamed("cid", "pcid")
    nt, np_ = t.groupBy("tcid").agg(F.count("*").alias("t")), p.groupBy("pcid").agg(F.count("*").alias("p"))
    both = t.join(p, "node").groupBy("tcid", "pcid").agg(F.count("*").alias("both"))
    return both.join(nt, "tcid").join(np_, "pcid").select("tcid", "pcid", "both", "t", "p")


def overlap(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(tp, predicted, actual) of the nodes that are in two groups or more."""

    def many(c: DataFrame, name: str) -> DataFrame:
        return members(c).groupBy("node").agg(F.count("*").alias("k")).where("k > 1").select("node", F.lit(1).alias(name))

    j = many(truth, "a").join(many(predicted, "b"), "node", "full_outer")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count("b").alias("predicted"), F.count("a").alias("actual"))


def cover_stats(cover: DataFrame, n: int) -> DataFrame:
    """(groups, memberships, covered, uncovered, overlapping, duplicate_groups) of a cover of n nodes.

    Equal groups are recognised by an order-insensitive digest of their members.
    """
    m = members(cover)
    k = m.groupBy("node").agg(F.count("*").alias("k")).agg(F.count("*").alias("covered"), F.count_if(F.col("k") > 1).alias("overlapping"), F.sum("k").alias("memberships"))
    groups = m.groupBy("cid").agg(F.count("*").alias("s"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    g = groups.agg(F.count("*").alias("groups"), (F.count("*") - F.count_distinct("s", "x", "y")).alias("duplicate_groups"))
    return g.join(k, F.lit(True)).select("groups", F.coalesce("memberships", F.lit(0)).alias("memberships"), "covered", (F.lit(n) - F.col("covered")).alias("uncovered"), "overlapping", "duplicate_groups")


def entropy_term(c: Column, n: int) -> Column:
    """-c log2(c / n), and 0 at 0."""
    return F.when(c > 0, -c * F.log2(c / F.lit(float(n)))).otherwise(F.lit(0.0))


def overlapping_nmi(truth: DataFrame, predicted: DataFrame, n: int) -> DataFrame:
    """(onmi, status): mutual information of two covers over max(H(X), H(Y)).

    A group is described by the other cover's group that leaves the least entropy,
    unless it is closer to that group's complement; then its own entropy counts.
    Groups that don't meet can describe each other only if one holds over half of
    the nodes; a cover has at most twice its mean memberships of those, and only
    they are joined with the groups they don't meet. Empty covers and covers
    without entropy have no value but a status.
    """
    cols = ["tcid", "pcid", "both", "t", "p"]
    pair = intersections(truth, predicted).select(*cols)
    nt = members(truth).groupBy(F.col("cid").alias("tcid")).agg(F.count("*").alias("t"))
    np_ = members(predicted).groupBy(F.col("cid").alias("pcid")).agg(F.count("*").alias("p"))
    apart = [nt.join(F.broadcast(np_.where(2 * F.col("p") > n)), F.col("t") + F.col("p") <= n), np_.join(F.broadcast(nt.where(2 * F.col("t") > n)), F.col("t") + F.col("p") <= n)]
    for x in apart:
        pair = pair.unionByName(x.join(intersections(truth, predicted), ["tcid", "pcid"], "left_anti").select("tcid", "pcid", F.lit(0).cast("bigint").alias("both"), "t", "p"))
    a, b, c, d = F.lit(n) - F.col("t") - F.col("p") + F.col("both"), F.col("p") - F.col("both"), F.col("t") - F.col("both"), F.col("both")
    ha, hb, hc, hd = (entropy_term(x.cast("double"), n) for x in (a, b, c, d))

    def own(size: Column) -> Column:
        return entropy_term(size.cast("double"), n) + entropy_term((F.lit(n) - size).cast("double"), n)

    joint = F.when(ha + hd >= hb + hc, ha + hb + hc + hd)
    cond = pair.select("tcid", "pcid", (joint - own(F.col("p"))).alias("xy"), (joint - own(F.col("t"))).alias("yx"))

    def side(sizes: DataFrame, cid: str, size: str, value: str) -> DataFrame:
        best = cond.groupBy(cid).agg(F.min(value).alias("best"))
        h = own(F.col(size))
        return sizes.join(best, cid, "left").select(h.alias("h"), F.least(h, F.coalesce("best", h)).alias("hc")).agg(F.coalesce(F.sum("h"), F.lit(0.0)).alias("h"), F.coalesce(F.sum("hc"), F.lit(0.0)).alias("hc"), F.count("*").alias("k"))

    x = side(nt, "tcid", "t", "xy").select(F.col("h").alias("hx"), F.col("hc").alias("hxy"), F.col("k").alias("kx"))
    y = side(np_, "pcid", "p", "yx").select(F.col("h").alias("hy"), F.col("hc").alias("hyx"), F.col("k").alias("ky"))
    status = F.when((F.col("kx") == 0) | (F.col("ky") == 0), "UNDEFINED_EMPTY_COVER").when((F.col("hx") == 0) & (F.col("hy") == 0), "UNDEFINED_ZERO_ENTROPY").otherwise("SCORED")
    value = 0.5 * (F.col("hx") + F.col("hy") - F.col("hxy") - F.col("hyx")) / F.nullif(F.greatest("hx", "hy"), F.lit(0.0))
    return x.join(y, F.lit(True)).withColumn("status", status).select(F.when(F.col("status") == "SCORED", value).alias("onmi"), "status")


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    ts, ps = sorted(set(pdf["tcid"])), sorted(set(pdf["pcid"]))
    ti, pi = {x: i for i, x in enumerate(ts)}, {x: i for i, x in enumerate(ps)}
    w = np.zeros((len(ts), len(ps)))
    for t, p, f in zip(pdf["tcid"], pdf["pcid"], 2 * pdf["both"] / (pdf["t"] + pdf["p"])):
        w[ti[t], pi[p]] = f
    return pd.DataFrame([(ts[i], ps[j], w[i, j]) for i, j in assign(w)], columns=["tcid", "pcid", "f1"])


def matching(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(tcid, pcid, f1): the one-to-one matching of groups with the greatest summed F1.

    Groups that meet through others form a component, matched by itself; components
    come from label propagation over the groups, so one task holds one component.
    """
    from meshwright.operators.iterative import components

    pair = intersections(truth, predicted)
    t, p = F.concat(F.lit("t"), F.col("tcid")), F.concat(F.lit("p"), F.col("pcid"))
    keyed = pair.withColumn("ku", t).withColumn("kv", p)
    part = components(keyed.select(F.col("ku").alias("u"), F.col("kv").alias("v"))).select(F.col("u").alias("ku"), F.col("c").alias("comp"))
    schema = keyed.select("tcid", "pcid").schema.add("f1", "double")
    return keyed.join(part, "ku").select("comp", "tcid", "pcid", "both", "t", "p").groupBy("comp").applyInPandas(_match, schema)


def macro_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(truth_groups, predicted_groups, macro_precision, macro_recall, macro_f1) of the best matching."""
    total = matching(truth, predicted).agg(F.coalesce(F.sum("f1"), F.lit(0.0)).alias("s"))
    a = members(truth).agg(F.count_distinct("cid").alias("truth_groups"))
    b = members(predicted).agg(F.count_distinct("cid").alias("predicted_groups"))
    s = F.col("s")
    j = total.join(a, F.lit(True)).join(b, F.lit(True))
    return j.select("truth_groups", "predicted_groups", F.coalesce(F.try_divide(s, "predicted_groups"), F.lit(0.0)).alias("macro_precision"), F.try_divide(s, "truth_groups").alias("macro_recall"), F.try_divide(2 * s, F.col("truth_groups") + F.col("predicted_groups")).alias("macro_f1"))
