"""Banks of candidate blocks: completion, mapping onto a contracted graph, mechanisms and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators.graph import Graph
from meshwright.operators.iterative import identifications
from meshwright.operators.meetings import common
from meshwright.operators.metrics import set_stats
from meshwright.session import materialize


def completed(membership: DataFrame, vertices: DataFrame) -> DataFrame:
    """(u, g): vertices that no group holds become groups of their own, named by themselves."""
    m = membership.select("u", "g").dropDuplicates(["u"])
    return vertices.select("u").distinct().join(m, "u", "left").select("u", F.coalesce("g", "u").alias("g"))


def not_disjoint(membership: DataFrame) -> DataFrame:
    """(u, groups) of the vertices that more than one group holds."""
    return membership.groupBy("u").agg(F.count_distinct("g").alias("groups")).where("groups > 1")


def mapped(blocks: DataFrame, membership: DataFrame, cap: int) -> DataFrame:
    """(first_block, blocks, size, kind): the distinct images of blocks (block_id, u) on the groups (u, g).

    Equal images are one row, named by the least block and counted; ``kind`` is
    trivial (one group), capped (more than ``cap`` groups) or admissible. The cap is
    applied after mapping. Images are told apart by two digests of their groups,
    folded without collecting a block.
    """
    image = blocks.select("block_id", "u").join(membership.select("u", "g"), "u").select("block_id", "g").distinct()
    digest = image.groupBy("block_id").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "g")).alias("y"))
    once = digest.groupBy("size", "x", "y").agg(F.min("block_id").alias("first_block"), F.count("*").alias("blocks"))
    kind = F.when(F.col("size") == 1, "trivial").when(F.col("size") > cap, "capped").otherwise("admissible")
    return once.select("first_block", "blocks", "size", kind.alias("kind"))


def mechanism(blocks: DataFrame) -> DataFrame:
    """(kind, rank): vertices removed by uniting blocks of two, blocks of more, and all of them."""
    size = blocks.select("block_id", "u").distinct().groupBy("block_id").agg(F.count("*").alias("n"))
    sized = blocks.join(size, "block_id")
    out = None
    for kind, part in (("pair", sized.where("n = 2")), ("collective", sized.where("n > 2")), ("all", sized)):
        r = identifications(part.select("block_id", "u")).select(F.lit(kind).alias("kind"), F.coalesce("rank", F.lit(0)).alias("rank"))
        out = r if out is None else out.unionByName(r)
    return out


def with_fallback(attempts: DataFrame, key: str) -> DataFrame:
    """(key, arithmetic, value, certifies): the exact attempt of (key, arithmetic, value) if it has a value, else the numeric one.

    Only an exact value certifies. Keys without any value stay, with nulls.
    """
    best = F.min(F.when(F.col("value").isNotNull(), F.struct(F.when(F.col("arithmetic") == "exact", 0).otherwise(1).alias("o"), "arithmetic", "value")))
    b = attempts.groupBy(key).agg(best.alias("b"))
    return b.select(key, F.col("b.arithmetic").alias("arithmetic"), F.col("b.value").alias("value"), F.coalesce(F.col("b.o") == 0, F.lit(False)).alias("certifies"))


def invalid_queries(g: Graph, queries: DataFrame) -> DataFrame:
    """(query_id, reason) of seeded queries that can't run: null_seed, unknown_seed or zero_degree."""
    j = queries.select("query_id", F.col("seed").alias("u")).join(g.degrees, "u", "left")
    reason = F.when(F.col("u").isNull(), "null_seed").when(F.col("d").isNull(), "unknown_seed").when(F.col("d") <= 0, "zero_degree")
    return j.select("query_id", reason.alias("reason")).where("reason IS NOT NULL")


def truth_margins(g: Graph, sets: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, operation, u, z_num, z_den): the quality each set would have after one vertex is added or deleted.

    Added are outside neighbours, deleted are members; a set of one vertex has no
    deletions. z = z_num / z_den as in ``set_stats``.
    """
    s = sets.select(key, "u").distinct()
    base = set_stats(g, s, key).select(key, "size", "vol", "cut")
    near = s.join(g.adj, "u").groupBy(key, F.col("v").alias("u")).agg(F.sum("w").alias("w"))
    inside = s.join(g.degrees, "u").join(near, [key, "u"], "left").join(base.where("size > 1"), key)
    out = near.join(s, [key, "u"], "left_anti").join(g.degrees, "u").join(base, key)
    w, m = F.coalesce("w", F.lit(0)), F.lit(g.volume)

    def moved(df: DataFrame, name: str, sign: int) -> DataFrame:
        vol = F.col("vol") + sign * F.col("d")
        cut = F.col("cut") + sign * (F.col("d") - 2 * w)
        df = df.select(key, F.lit(name).alias("operation"), "u", vol.alias("vol"), cut.alias("cut"))
        return df.select(key, "operation", "u", (F.col("cut") * m + F.col("vol") * F.col("vol")).alias("z_num"), (m * F.col("vol")).alias("z_den"))

    return moved(out, "add", 1).unionByName(moved(inside, "delete", -1))


def pair_margins(g: Graph, p: int = 1, q: int = 1) -> DataFrame:
    """(u, v, share, margin) of the edges with affinity >= 0: the best mixture copy of a pair and what it leaves, in doubles.

    The loss sum of weight * |share - root| is least at the lower weighted median of
    the roots: the first whose running weight reaches half. A root depends on a
    vertex' degree and its weights to both ends alone, so vertices alike in these are
    one root; those of one end come from its histogram, less the common neighbours.
    Vertices that neither end touches are one more root.
    """
    from pyspark.sql import Window

    m = float(g.volume)
    e = g.affinities(p, q).where("c >= 0").select("u", "v", "w", "du", "dv", (F.col("c") / F.lit(q * m)).alias("b"))
    e = materialize(e, "attractive")
    d = g.degrees.select(F.col("u").alias("x"), F.col("d").alias("dx"))
    h = materialize(g.adj.join(d, F.col("v") == F.col("x")).groupBy("u", "w", "dx").agg(F.count("*").alias("n")), "histogram")
    zero, ends = F.lit(0).cast("bigint"), e.select("u", "v", "du", "dv")

    def alike(df: DataFrame, dx: str, wu: Column | str, wv: Column | str, n: Column | str) -> DataFrame:
        own = {"dx": dx, "wu": wu, "wv": wv, "n": n}
        return df.select("u", "v", *((F.col(c) if isinstance(c, str) else c).cast("bigint").alias(k) for k, c in own.items()))

    met = materialize(common(g, ends.select("u", "v")).hint("merge").join(d, "x"), "common")
    less = F.lit(-1)
    cells = [
        alike(ends.join(h, "u"), "dx", "w", zero, "n"), alike(ends.join(h.withColumnRenamed("u", "v"), "v"), "dx", zero, "w", "n"),
        alike(e, "dv", "w", zero, less), alike(e, "du", zero, "w", less),
        alike(met, "dx", "wu", zero, less), alike(met, "dx", zero, "wv", less), alike(met, "dx", "wu", "wv", F.lit(1)),
    ]
    cell = reduce(DataFrame.unionByName, cells).groupBy("u", "v", "dx", "wu", "wv").agg(F.sum("n").alias("n")).where("n > 0").join(ends, ["u", "v"])
    g_ = F.lit(p / q / m)
    bu, bv = F.col("wu") - g_ * F.col("du") * F.col("dx"), F.col("wv") - g_ * F.col("dv") * F.col("dx")
    term = cell.select("u", "v", F.try_divide(bu, bu + bv).alias("root"), (F.abs(bu + bv) * F.col("n")).alias("weight"), (F.when(bu + bv == 0, F.abs(bu)).otherwise(0.0) * F.col("n")).alias("fixed"), "dx", "n")
    touched = term.groupBy("u", "v").agg(F.sum(F.col("dx") * F.col("n")).alias("near"), F.sum("fixed").alias("fixed"))
    t = e.join(touched, ["u", "v"], "left")
    far = t.select("u", "v", (F.col("du") / (F.col("du") + F.col("dv"))).alias("root"), (g_ * (F.lit(m) - F.col("du") - F.col("dv") - F.coalesce("near", F.lit(0))) * (F.col("du") + F.col("dv"))).alias("weight"))
    roots = term.where("weight > 0").select("u", "v", "root", "weight").unionByName(far.where("weight > 0"))
    w = Window.partitionBy("u", "v").orderBy("root").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("u", "v")
    r = roots.withColumn("run", F.sum("weight").over(w)).withColumn("all", F.sum("weight").over(whole))
    pick = r.where(2 * F.col("run") >= F.col("all")).groupBy("u", "v").agg(F.least(F.greatest(F.min("root"), F.lit(0.0)), F.lit(1.0)).alias("share"))
    loss = roots.join(pick, ["u", "v"]).groupBy("u", "v", "share").agg(F.sum(F.col("weight") * F.abs(F.col("share") - F.col("root"))).alias("loss"))
    j = t.join(loss, ["u", "v"], "left")
    return j.select("u", "v", F.coalesce("share", F.lit(0.0)).alias("share"), (F.col("b") - F.coalesce("loss", F.lit(0.0)) - F.coalesce("fixed", F.lit(0.0))).alias("margin"))
