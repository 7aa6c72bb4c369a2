"""Graph families: closed forms as range expressions, random ones as seeded numpy kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators.graph import EDGE, Graph


def _clique(spark: SparkSession, start: int, k: int) -> DataFrame:
    a = spark.range(start, start + k).withColumnRenamed("id", "u")
    return a.select("u", F.explode(F.sequence(F.col("u"), F.lit(start + k - 1))).alias("v")).where("u < v").withColumn("w", F.lit(1).cast("bigint"))


def matching_cliques(spark: SparkSession, k: int) -> Graph:
    """Two cliques of k vertices and a perfect matching between them: 2 k vertices, k^2 edges, all degrees k."""
    match = spark.range(k).select(F.col("id").alias("u"), (F.col("id") + k).alias("v"), F.lit(1).cast("bigint").alias("w"))
    return Graph(_clique(spark, 0, k).unionByName(_clique(spark, k, k)).unionByName(match))


def common_hub(spark: SparkSession, k: int) -> Graph:
    """Matching cliques and a hub 2 k next to all of the first clique."""
    hub = spark.range(k).select(F.col("id").alias("u"), F.lit(2 * k).cast("bigint").alias("v"), F.lit(1).cast("bigint").alias("w"))
    return Graph(matching_cliques(spark, k).edges.unionByName(hub))


def hub_cliques(spark: SparkSession, q: int, s: int) -> Graph:
    """q cliques of s vertices that share vertex 0."""
    own = spark.range(q).select(F.col("id").alias("c"))
    m = own.select("c", F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("i"))
    ident = F.when(F.col("i") == 0, 0).otherwise(F.col("c") * (s - 1) + F.col("i"))
    m = m.select("c", ident.cast("bigint").alias("u"))
    e = m.join(m.withColumnRenamed("u", "v"), "c").where("u < v").select("u", "v", F.lit(1).cast("bigint").alias("w"))
    return Graph(e)


def private_leaves(spark: SparkSession, k: int, leaves: int) -> Graph:
    """A clique whose vertices have private leaves: a hard outside."""
    leaf = spark.range(k * leaves).select(F.floor(F.col("id") / leaves).alias("u"), (F.col("id") + k).alias("v"), F.lit(1).cast("bigint").alias("w"))
    return Graph(_clique(spark, 0, k).unionByName(leaf))


def clique_ring(spark: SparkSession, k: int, n: int) -> Graph:
    """A clique of k, a hub next to all of it, and a ring of the remaining vertices up to n through the hub."""
    one = F.lit(1).cast("bigint").alias("w")
    hub = spark.range(k).select(F.col("id").alias("u"), F.lit(k).cast("bigint").alias("v"), one)
    ring = spark.range(k, n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), one)
    close = spark.range(1).select(F.lit(k).cast("bigint").alias("u"), F.lit(n - 1).cast("bigint").alias("v"), one)
    return Graph(_clique(spark, 0, k).unionByName(hub).unionByName(ring).unionByName(close))


def circulant(spark: SparkSession, n: int, steps: list[int]) -> Graph:
    """Vertices on a circle, each next to those some steps away."""
    e = spark.range(n).select(F.col("id").alias("a"), F.explode(F.array(*map(F.lit, steps))).alias("s")).select("a", ((F.col("a") + F.col("s")) % n).alias("b"))
    return Graph(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.lit(1).cast("bigint").alias("w")).distinct())


# A friendship network of 15 families by number, a public data set of 20 ties.
FAMILIES = ((0, 8), (1, 5), (1, 6), (1, 8), (2, 4), (2, 8), (3, 6), (3, 10), (3, 13), (4, 10), (4, 13), (6, 7), (6, 14), (8, 11), (8, 12), (8, 14), (9, 12), (10, 13), (11, 13), (11, 14))


def families(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([(u, v, 1) for u, v in FAMILIES], EDGE))


def _blocks(spark: SparkSession, n: int, seed: int, rows_per_task: int, kernel) -> DataFrame:
    """Edges drawn row by row; every row has a generator of its own, so the result doesn't depend on the tasks."""

    def run(batches):
        for pdf in batches:
            out = []
            for u in pdf["id"]:
                out += [(int(u), int(v), int(w)) for v, w in kernel(int(u), np.random.default_rng([seed, int(u)]))]
            yield pd.DataFrame(out, columns=["u", "v", "w"])

    tasks = max(1, n // rows_per_task)
    return spark.range(0, n, 1, tasks).mapInPandas(run, EDGE)


def planted(spark: SparkSession, n: int, groups: int, p_in: float, p_out: float, seed: int, weighted: bool = False) -> tuple[Graph, DataFrame]:
    """A planted partition (u, l): Bernoulli edges by whether the ends' groups agree; weights 1 to 4 if weighted."""

    def kernel(u: int, rng: np.random.Generator):
        v = np.arange(u + 1, n)
        hit = v[rng.random(len(v)) < np.where(v % groups == u % groups, p_in, p_out)]
        return zip(hit, rng.integers(1, 5, len(hit)) if weighted else np.ones(len(hit), dtype=int))

    labels = spark.range(n).select(F.col("id").alias("u"), (F.col("id") % groups).alias("l"))
    return Graph(_blocks(spark, n, seed, 500, kernel), labels.select("u")), labels


def noisy(g: Graph, n: int, drop: float, add: int, seed: int) -> Graph:
    """A graph seen through a channel that loses edges and adds ``add`` random pairs, by hashes of the pair."""
    spark = g.spark
    kept = g.edges.where(F.pmod(F.xxhash64(F.lit(seed), "u", "v"), F.lit(10**6)) >= int(drop * 10**6))
    ends = spark.range(add).select(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(n)).alias("a"), F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(n)).alias("b")).where("a <> b")
    new = ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.lit(1).cast("bigint").alias("w"))
    return Graph(kept.unionByName(new).groupBy("u", "v").agg(F.max("w").alias("w")), g.vertices)


def overlapping_planted(spark: SparkSession, n: int, groups: int, extra: float, p_in: float, p_out: float, seed: int) -> tuple[Graph, DataFrame]:
    """(graph, cover): every vertex is in one group, a share ``extra`` in the next one too; edges by whether ends share one."""

    def both(u: int) -> set[int]:
        second = np.random.default_rng([seed, 7, u]).random() < extra
        return {u % groups, (u + 1) % groups} if second else {u % groups}

    def kernel(u: int, rng: np.random.Generator):
        mine = both(u)
        draws = rng.random(n - u - 1)
        return [(v, 1) for v in range(u + 1, n) if draws[v - u - 1] < (p_in if mine & both(v) else p_out)]

    cover = spark.createDataFrame([(c, u) for u in range(n) for c in sorted(both(u))], "cid long, node long")
    return Graph(_blocks(spark, n, seed, 200, kernel), spark.range(n).withColumnRenamed("id", "u")), cover


def expected_degrees(spark: SparkSession, weights: list[float], seed: int) -> Graph:
    """Independent edges with probability min(w_u w_v / sum w, 1): a null model without groups."""
    w = np.asarray(weights, dtype=float)
    total = w.sum()

    def kernel(u: int, rng: np.random.Generator):
        p = np.minimum(w[u] * w[u + 1 :] / total, 1.0)
        return [(u + 1 + int(i), 1) for i in np.flatnonzero(rng.random(len(p)) < p)]

    return Graph(_blocks(spark, len(w), seed, 500, kernel), spark.range(len(w)).withColumnRenamed("id", "u"))


def planted_hypergraph(spark: SparkSession, n: int, groups: int, inner: int, cross: int, rank: int, seed: int) -> DataFrame:
    """inc(e, u, r): ``inner`` hyperedges inside each group and ``cross`` ones over at least two groups."""
    rng, rows, e = np.random.default_rng(seed), [], 0
    for g in range(groups):
        pool = np.arange(g, n, groups)
        for _ in range(inner):
            rows += [(e, int(u), rank) for u in rng.choice(pool, rank, replace=False)]
            e += 1
    while cross:
        m = rng.choice(n, rank, replace=False)
        if len(set(m % groups)) > 1:
            rows += [(e, int(u), rank) for u in m]
            e, cross = e + 1, cross - 1
    return spark.createDataFrame(rows, "e long, u long, r long")


def grid(spark: SparkSession, families_: list[str], sizes: list[int], gammas: list[tuple[int, int]]) -> DataFrame:
    """(family, size, p, q): the plan of all cases, a product of three short lists."""
    cells = [(f, s, p, q) for f in families_ for s in sizes for p, q in gammas]
    return spark.createDataFrame(cells, "family string, size int, p int, q int")
