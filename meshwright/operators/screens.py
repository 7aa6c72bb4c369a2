"""Verdicts on blocks too large for one task's kernel, from sums over their members and columns.

A criterion asks that a form has no negative value, or that one sum exceeds another.
Each is tried here at one vector a member or by a bound that holds for certain; what
is summed in doubles counts only where it is further from 0 than all rounding. Blocks
that this leaves open have a null status: the kernel has to judge them whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators.graph import Graph
from meshwright.session import materialize

#: Share of the summed magnitudes beyond which a double's sign is certain: sums of up to 10^9 terms.
_SURE = 1e-6
_FAILED = "failed_exact_psd"


def _member_sums(rows: DataFrame, members: DataFrame, stats: DataFrame, m: int) -> DataFrame:
    """(block_id, u, n, vol, d, ...): what each member of a block has inside and outside, in doubles.

    ``win``, ``out``: weights inside and outside; ``own``, ``pos``: positive affinities
    there; ``links``, ``low``, ``doubt``: inner edges, those surely and those maybe of
    negative affinity; ``held_d``, ``held_w``: degrees and block weights of the outside
    columns it touches; ``uni``, ``far``: its least distances to all members there;
    ``s_*``, ``c_*``: its overlap with a centre, and the centre's columns' sums, each
    column counted at one of its rows.
    """
    inside = members.select("block_id", F.col("u").alias("v"), F.lit(True).alias("inner"))
    # a block has over 2 million edges, so there are few of them
    r = rows.join(inside, ["block_id", "v"], "left").join(F.broadcast(stats), "block_id")
    num = [F.col(c).cast("double").alias(c) for c in ("w", "du", "dv", "n", "vol")]
    r = r.select("block_id", "u", "v", *num, "first", F.coalesce("inner", F.lit(False)).alias("inner"), F.try_divide("w", "du").alias("s"))
    column = Window.partitionBy("block_id", "v")
    # a column's place among all members: those without an edge to it come first, with 0
    r = r.withColumn("at", F.row_number().over(column.orderBy("s")))
    lead = F.col("n") - F.count("*").over(column)
    place = F.col("at") - 1 + lead
    half = F.floor(F.col("n") / 2)
    r = r.withColumn("place", place).withColumn("half", half).withColumn("whole", F.sum("w").over(column))
    upper = F.coalesce(F.max(F.when(F.col("place") == F.col("half"), F.col("s"))).over(column), F.lit(0.0))
    lower = F.coalesce(F.max(F.when(F.col("place") == F.col("half") - 1, F.col("s"))).over(column), F.lit(0.0))
    median = F.when(F.col("n") % 2 == 1, upper).otherwise((upper + lower) / 2)
    anchor = F.coalesce(F.max(F.when(F.col("u") == F.col("first"), F.col("s"))).over(column), F.lit(0.0))
    r = r.withColumn("median", median).withColumn("anchor", anchor)
    w, du, dv, n, vol, big = (F.col(c) for c in ("w", "du", "dv", "n", "vol", "whole"))
    c = m * w - du * dv

    def total(x: Column, where: Column, name: str) -> Column:
        return F.sum(F.when(where, x).otherwise(0.0)).alias(name)

    inner = F.col("v").isNotNull() & F.col("inner")
    outer = F.col("v").isNotNull() & ~F.col("inner")
    once, one = outer & (F.col("at") == 1), F.lit(1.0)
    return r.groupBy("block_id", "u").agg(
        F.max("n").alias("n"), F.max("vol").alias("vol"), F.max("du").alias("d"),
        total(w, inner, "win"), total(F.greatest(c, F.lit(0.0)), inner, "own"), total(one, inner, "links"),
        total(one, inner & (c < -1e-12 * du * dv), "low"), total(one, inner & (c < 1e-12 * du * dv), "doubt"),
        total(w, outer, "out"), total(F.greatest(c, F.lit(0.0)), outer, "pos"), total(dv, outer, "held_d"), total(big, outer, "held_w"),
        total(F.abs(n * c - m * big + vol * dv), outer, "uni"), total(F.abs(vol * w - du * big), outer, "far"), total(dv, once, "c_d"),
        *(total(F.least("s", k), outer, f"s_{k}") for k in ("median", "anchor")), *(total(F.col(k), once, f"c_{k}") for k in ("median", "anchor")),
    )


def _copies(m: int, centre: str) -> tuple[Column, Column]:
    """(value, magnitude) of the form of copies around a centre at vol e_u - d_u times the ones, for each member u."""
    vol, d = F.col("vol"), F.col("d")
    if centre == "zero":
        near = every = shared = F.lit(0.0)
    else:
        near, every, shared = F.col(f"s_{centre}"), F.col(f"all_c_{centre}"), F.col(f"all_ds_{centre}")

    def value(sign: int) -> tuple[Column, Column]:
        """What a member takes, d (delta + null), and the sum over all members; sign 1 for magnitudes."""
        every_d = F.col("all_out") + vol * every + sign * 2 * shared
        return F.col("out") + d * (every + sign * 2 * near) + d * (vol / m + F.try_divide(every_d, vol)), 2 * every_d + vol * vol / m

    links = vol * vol * F.col("win")
    own, whole = value(-1)
    most, most_whole = value(1)
    return links - own * (vol - d) ** 2 - d * d * (whole - own), links + most * (vol - d) ** 2 + d * d * (most_whole + most)


def _contrast(m: int) -> tuple[Column, Column]:
    """(bound, magnitude) above each member's sum of pair values under ``uniform_copy``."""
    n, vol, d, dt = (F.col(c) for c in ("n", "vol", "d", "all_c_d"))
    held, wide, win = F.col("held_d"), F.col("held_w"), n * m * F.col("win")
    rest = F.abs((vol - n * d) * (dt - held) - m * (F.col("all_out") - wide)) + F.abs(n * d - vol) * (m - vol - dt)
    most = win + n * d * vol + n * m * F.col("out") + (n * d + vol) * (held + dt + m) + m * (wide + F.col("all_out"))
    return win - n * d * (vol - d) - F.col("uni") - rest, most


def _pairs(m: int) -> tuple[Column, Column]:
    """The same under ``full_pairs``."""
    vol, d = F.col("vol"), F.col("d")
    win = vol * m * F.col("win")
    most = win + vol * vol * d + m * (vol * F.col("out") + d * (F.col("held_w") + F.col("all_out")))
    return win - vol * d * (vol - d) - m * (F.col("far") + d * (F.col("all_out") - F.col("held_w"))), most


#: Criteria that a negative value at one member refutes: m -> (value, magnitude), and whether members without edges exclude a block.
_FORMS: dict[str, tuple[Callable[[int], tuple[Column, Column]], bool]] = {
    "degree_copy": (lambda m: _copies(m, "median"), True),
    "zero_copy": (lambda m: _copies(m, "zero"), True),
    "anchor_copy": (lambda m: _copies(m, "anchor"), True),
    "uniform_copy": (_contrast, False),
    "full_pairs": (_pairs, True),
}


def _status(method: str, m: int) -> Column:
    """A block's status under a criterion as an aggregate over its members, null where that leaves it open."""
    if method in _FORMS:
        form, positive = _FORMS[method]
        value, most = form(m)
        failed = F.when(F.max((value < -_SURE * most).cast("int")) == 1, F.lit(_FAILED))
        return F.when(F.min("d") <= 0, F.lit("zero_degree_excluded")).otherwise(failed) if positive else failed
    own, pos, vol = F.col("own"), F.sum("pos"), F.max("vol")
    inner = m * F.sum("win")
    if method == "almost_clique":
        lost = pos + (F.sum("own") - inner + vol * vol - F.sum(F.col("d") * F.col("d"))) / 2
        most = F.sum(m * F.col("out") + F.col("d") * F.col("held_d") + own) + inner + 2 * vol * vol
        return F.when(F.min("own") < lost - _SURE * most, F.lit("failed_upper_bound"))
    if method == "positive_closure":
        some = F.sum((F.col("d") > 0).cast("double"))
        missing = F.sum("links") < some * (some - 1)
        most = F.sum(m * F.col("out") + F.col("d") * F.col("held_d")) + inner + vol * vol
        bound = F.when((F.sum("doubt") == 0) & (F.min(own + F.col("pos")) - pos < -_SURE * most), F.lit("failed_pair_condition"))
        return F.when(missing | (F.sum("low") > 0), F.lit("negative_inner_affinity")).otherwise(bound)
    return F.lit(None).cast("string")


def verdicts(g: Graph, rows: DataFrame, members: DataFrame, methods: list[str]) -> DataFrame:
    """(block_id, size, method, status) of blocks (block_id, u) with all their edges (``regions.region_rows``); null where it is open."""
    m = g.volume
    stats = materialize(members.join(g.degrees, "u").groupBy("block_id").agg(F.count("*").alias("n"), F.sum("d").alias("vol"), F.min("u").alias("first")), "stats")
    each = materialize(_member_sums(rows, members, stats, m), "members")
    sums = [F.sum(c).alias(f"all_{c}") for c in ("out", "c_d", "c_median", "c_anchor")]
    sums += [F.sum(F.col("d") * F.col(f"s_{k}")).alias(f"all_ds_{k}") for k in ("median", "anchor")]
    each = each.join(F.broadcast(each.groupBy("block_id").agg(*sums)), "block_id")
    found = each.groupBy("block_id").agg(F.max("n").cast("int").alias("size"), *(_status(k, m).alias(k) for k in methods))
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("method"), F.col(k).alias("status")) for k in methods))).alias("x")
    return found.select("block_id", "size", named).select("block_id", "size", "x.method", "x.status")
