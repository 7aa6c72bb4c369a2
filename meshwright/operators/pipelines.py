"""Contraction pipelines: a graph as it is, contracted by certified blocks, by edge rules, or by one after the other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import bank, iterative, metrics, regions
from meshwright.operators.graph import Graph
from meshwright.session import materialize

#: Arms: U leaves all vertices apart, D unites certified blocks, R contracts by edge
#: rules, RD maps the bank onto what R leaves and goes on with blocks.
ARMS = ("U", "D", "R", "RD")


def certified(g: Graph, blocks: DataFrame, method: str = "degree_copy") -> DataFrame:
    """(block_id, u) of the blocks that a criterion certifies on the graph as it is."""
    ok = regions.block_panel(g, blocks, [method]).where(F.col("status").startswith("verified")).select("block_id")
    return blocks.select("block_id", "u").join(ok, "block_id", "left_semi")


def images(blocks: DataFrame, membership: DataFrame, cap: int) -> DataFrame:
    """(block_id, u): the distinct images of blocks on groups (u, g), each under its least block's name.

    Images of one group and, after mapping, those of more than ``cap`` are left out.
    """
    names = bank.mapped(blocks, membership, cap).where("kind = 'admissible'").select(F.col("first_block").alias("block_id"))
    image = blocks.select("block_id", "u").join(membership.select("u", "g"), "u").select("block_id", F.col("g").alias("u")).distinct()
    return image.join(names, "block_id", "left_semi")


def arm(g: Graph, blocks: DataFrame, name: str, cap: int = 64, progress: Callable[[dict], None] | None = None, reduced: DataFrame | None = None) -> DataFrame:
    """(u, g): the group of each vertex after one arm, named by its least vertex.

    ``blocks`` is the bank (block_id, u); blocks of more than ``cap`` groups aren't
    tried. All of a stage's decisions are on one graph; certified blocks that share
    vertices are united. Degrees and the volume of contracted graphs are those of all
    vertices, so every stage judges the same objective. ``reduced`` is what R gives, if
    it is known already.
    """
    if name not in ARMS:
        raise ValueError(f"unknown arm {name!r}")
    member = g.vertices.select("u", F.col("u").alias("g"))
    now = g
    if name.startswith("R"):
        member = reduced if reduced is not None else iterative.recursive_contraction(g, progress=progress)[0]
        if name == "RD":
            now = iterative.quotient_graph(g, member)
    if name.endswith("D"):
        tried = blocks if name == "D" else images(blocks, member, cap)
        sized = tried.groupBy("block_id").agg(F.count_distinct("u").alias("n")).where(F.col("n").between(2, cap))
        # read several times below, so the kernels' decisions are written first
        sure = materialize(certified(now, tried.join(sized, "block_id", "left_semi")), "certified")
        united = iterative.union_of_blocks(sure)
        united = materialize(united.select(F.col("u").alias("g"), F.col("g").alias("head")), "united")
        member = member.join(united, "g", "left").select("u", F.coalesce("head", "g").alias("g"))
    return materialize(member, "arm")


def arm_summary(g: Graph, blocks: DataFrame, labels: DataFrame, arms: tuple[str, ...] = ARMS, cap: int = 64) -> DataFrame:
    """(arm, vertices, groups, removed, broken, mixed) of each arm.

    ``broken`` counts groups whose degree the contracted graph doesn't keep, which
    there must not be; ``mixed`` groups whose members differ in ``labels`` (u, l).
    """
    out, reduced = [], None
    for name in arms:
        m = arm(g, blocks, name, cap, reduced=reduced)
        reduced = m if name == "R" else reduced
        count = m.agg(F.count("*").alias("vertices"), F.count_distinct("g").alias("groups"))
        lab = m.select("u", F.col("g").alias("l"))
        broken = metrics.quotient_mismatches(g, lab, metrics.quotient(g, lab)).agg(F.count("*").alias("broken"))
        mixed = m.join(labels, "u").groupBy("g").agg(F.count_distinct("l").alias("k")).agg(F.count_if(F.col("k") > 1).alias("mixed"))
        # each side is one row
        row = count.crossJoin(broken).crossJoin(mixed)
        row = row.select(F.lit(name).alias("arm"), "vertices", "groups", (F.col("vertices") - F.col("groups")).alias("removed"), "broken", "mixed")
        # written arm by arm: one plan over all arms takes the driver's memory
        out.append(materialize(row, "summary"))
    return reduce(DataFrame.unionByName, out)
