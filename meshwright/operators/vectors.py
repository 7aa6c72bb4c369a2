"""Dot products of listed pairs of vectors, and the losses built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays in doubles, in whole-stage code; arrays of unlike length give null."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), s)


def pair_dots(pairs: DataFrame, vectors: DataFrame, product=dot) -> DataFrame:
    """(a, b, dot) of the listed pairs, repeated ones too; pairs without both vectors are left out.

    Each distinct pair is computed once. ``product`` may be any expression of two arrays.
    """
    once = pairs.groupBy("a", "b").agg(F.count("*").alias("_n"))
    x = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("_x"))
    y = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("_y"))
    got = once.join(x, "a").join(y, "b").select("a", "b", product(F.col("_x"), F.col("_y")).alias("dot"), "_n")
    return got.select("a", "b", "dot", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).drop("_i")


def bernoulli_poisson_loss(dots: DataFrame, epsilon: float, scale: float) -> DataFrame:
    """(edges, non_edges, loss) of (edge, dot): mean -log(1 - exp(-eps - dot)) over edges plus ``scale`` times the mean dot over others, over 1 + scale."""
    e = F.col("edge")
    near = F.avg(F.when(e, -F.log(-F.expm1(-epsilon - F.col("dot")))))
    far = F.avg(F.when(~e, F.col("dot")))
    return dots.agg(F.count_if(e).alias("edges"), F.count_if(~e).alias("non_edges"), ((near + scale * far) / (1 + scale)).alias("loss"))
