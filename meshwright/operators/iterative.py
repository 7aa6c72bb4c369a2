"""Operators that run in rounds: components, contraction, push, label propagation.

Each round is one plan over the last round's written table; nothing grows with the
number of rounds, and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators.criteria import positive_closure, proportional_twins, singleton_dominance
from meshwright.operators.graph import Graph
from meshwright.operators.meetings import ego_parts
from meshwright.session import materialize


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(u, c): the least vertex of each vertex' connected component.

    Large-star and small-star rounds: every vertex hands its larger neighbours, then
    its smaller ones, to the least vertex it knows; the number of rounds grows with
    the logarithm of the diameter. A hub's neighbours are never gathered: a round is
    a minimum per vertex and a join. Isolated vertices come from ``vertices``.
    """
    e = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    last = None
    while True:
        # large star: each neighbour greater than u links to u's least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        # small star: each smaller neighbour and u itself link to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = materialize(small, "cc")
        mark = e.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if mark == last:
            break
        last = mark
    roots = e.select(F.col("v").alias("u"), F.col("v").alias("c")).distinct()
    out = e.select("u", F.col("v").alias("c")).unionByName(roots)
    if vertices is None:
        return out
    return vertices.select("u").distinct().join(out, "u", "left").select("u", F.coalesce("c", "u").alias("c"))


def union_of_blocks(blocks: DataFrame) -> DataFrame:
    """(u, g): overlapping blocks (block_id, u) grown together; g is the least member."""
    first = blocks.groupBy("block_id").agg(F.min("u").alias("v"))
    links = blocks.join(first, "block_id").select("u", "v")
    return components(links, blocks.select("u")).withColumnRenamed("c", "g")


def identifications(blocks: DataFrame) -> DataFrame:
    """(vertices, groups, rank): how many vertices uniting the blocks removes."""
    u = union_of_blocks(blocks)
    n = u.agg(F.count("*").alias("vertices"), F.count_distinct("g").alias("groups"))
    return n.select("vertices", "groups", (F.col("vertices") - F.col("groups")).alias("rank"))


def signed_components(g: Graph, p: int, q: int) -> DataFrame:
    """(u, c): components over the edges of positive affinity."""
    return components(g.affinities(p, q).where("c > 0"), g.vertices)


def contract(g: Graph, membership: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of groups (u, g) as a graph without loops, and (g, loop): twice the weight inside each group."""
    a = membership.select("u", F.col("g").alias("gu"))
    b = membership.select(F.col("u").alias("v"), F.col("g").alias("gv"))
    e = materialize(g.edges.join(a, "u").join(b, "v").groupBy(F.least("gu", "gv").alias("u"), F.greatest("gu", "gv").alias("v")).agg(F.sum("w").alias("w")), "quotient")
    loops = e.where("u = v").select(F.col("u").alias("g"), (2 * F.col("w")).alias("loop"))
    return Graph(e.where("u <> v"), membership.select(F.col("g").alias("u")).distinct()), loops


class _Looped(Graph):
    """A contracted graph: degrees keep the inner weight, which loops would carry."""

    def __init__(self, edges: DataFrame, degrees: DataFrame, volume: int):
        super().__init__(edges, degrees.select("u"))
        self.__dict__["degrees"] = degrees
        self.__dict__["volume"] = volume


def quotient_graph(g: Graph, membership: DataFrame) -> Graph:
    """The graph of groups (u, g) without loops, whose degrees and volume are those of all vertices."""
    inner, _ = contract(g, membership)
    degrees = materialize(g.degrees.join(membership, "u").groupBy(F.col("g").alias("u")).agg(F.sum("d").alias("d")), "degrees")
    return _Looped(inner.edges, degrees, g.volume)


def recursive_contraction(g: Graph, p: int = 1, q: int = 1, progress: Callable[[dict], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(u, g) after contracting safe edges until none is left, and (round, rule, edges) of what was found.

    It ends, since every round but the last unites groups; ``progress`` is told what
    each rule found as it is found.

    Each round takes all edges that singleton dominance, positive closure or the
    twin rule accept on the present graph, unites them and contracts. Degrees and
    volume are carried over, so later rounds judge the same objective.
    """
    m, degrees, edges = g.volume, g.degrees, g.edges
    member = g.vertices.select("u", F.col("u").alias("g"))
    log: list[tuple[int, str, int]] = []
    turn = 0
    while True:
        turn += 1
        now = _Looped(edges, degrees, m)
        rules = {"dominance": singleton_dominance(now, p, q), "closure": positive_closure(now, p, q), "twins": proportional_twins(now, p, q)}
        found = None
        for name, rule in rules.items():
            rule = materialize(rule.select("u", "v"), "safe")
            n = rule.count()
            log.append((turn, name, n))
            if progress:
                progress({"round": turn, "rule": name, "edges": n})
            if n:
                found = rule if found is None else found.unionByName(rule)
        if found is None:
            break
        united = materialize(components(found, degrees.select("u")), "united")
        a, b = united.select("u", F.col("c").alias("gu")), united.select(F.col("u").alias("v"), F.col("c").alias("gv"))
        edges = materialize(edges.join(a, "u").join(b, "v").where("gu <> gv").groupBy(F.least("gu", "gv").alias("u"), F.greatest("gu", "gv").alias("v")).agg(F.sum("w").alias("w")), "contracted")
        degrees = materialize(degrees.join(united, "u").groupBy(F.col("c").alias("u")).agg(F.sum("d").alias("d")), "degrees")
        member = materialize(member.join(united.withColumnRenamed("u", "g"), "g").select("u", F.col("c").alias("g")), "member")
    spark = g.spark
    return member, spark.createDataFrame(log, "round int, rule string, edges long")


def push_rounds(g: Graph, seeds: DataFrame, alpha: float, rho: float, rounds: int | None = None, key: str = "query_id", progress: Callable[[dict], None] | None = None) -> DataFrame:
    """(key, u, rank, residual) after rounds of lazy personalised push from (key, seed).

    Without ``rounds`` it goes on until no residual exceeds rho d. That ends: each
    round with a vertex that pushes turns more than alpha rho of the mass into rank.

    In a round every vertex whose residual exceeds rho d pushes at once: alpha of it
    stays as rank, half of the rest stays as residual, the other half goes to the
    neighbours by weight. This is a different schedule from a queue's with the same
    bound: once no residual exceeds rho d nothing moves. Mass is kept. ``progress`` is
    told of each round.
    """
    d = g.degrees
    state = seeds.select(key, F.col("seed").alias("u"), F.lit(0.0).alias("rank"), F.lit(1.0).alias("residual"))
    hot = (F.col("residual") > rho * F.col("d")) & (F.col("d") > 0)
    done = 0
    while rounds is None or done < rounds:
        s = materialize(state.join(d, "u"), "push")
        if rounds is None and s.where(hot).isEmpty():
            return s.select(key, "u", "rank", "residual")
        done += 1
        if progress:
            progress({"round": done})
        go = s.where(hot).select(key, "u", ((1 - alpha) * F.col("residual") / (2 * F.col("d"))).alias("x"))
        sent = go.join(g.adj, "u").select(key, F.col("v").alias("u"), F.lit(0.0).alias("rank"), (F.col("x") * F.col("w")).alias("residual"))
        kept = s.select(
            key, "u", F.when(hot, F.col("rank") + alpha * F.col("residual")).otherwise(F.col("rank")).alias("rank"),
            F.when(hot, (1 - alpha) * F.col("residual") / 2).otherwise(F.col("residual")).alias("residual"),
        )
        state = kept.unionByName(sent).groupBy(key, "u").agg(F.sum("rank").alias("rank"), F.sum("residual").alias("residual"))
    return materialize(state, "push")


def top_l_epochs(g: Graph, seed: int, mass: float, epochs: int, eta: float = 0.5, sigma: float = 1e-4, k: int = 50, gamma: float = 1.0) -> DataFrame:
    """(u, x) after epochs of simultaneous projected dual ascent in which at most ``k`` new vertices come in.

    Active heights move against their gradient over d; of their neighbours the k
    with the greatest push * (inward weight / d)^gamma come in, ties by id. k is the
    operator's own parameter.
    """
    d = g.degrees
    x = materialize(d.where(F.col("u") == seed).select("u", F.lit(0.0).alias("x")), "heights")
    for _ in range(epochs):
        into = g.adj.join(x.select("u", "x"), "u").groupBy(F.col("v").alias("u")).agg(F.sum(F.col("w") * F.col("x")).alias("ax"), F.sum("w").alias("inward"))
        near = into.join(x, "u", "full_outer").join(d, "u").where("d > 0")
        h, ax = F.coalesce("x", F.lit(0.0)), F.coalesce("ax", F.lit(0.0))
        grad = F.col("d") * (1 + sigma * h) + F.col("d") * h - ax - F.when(F.col("u") == seed, mass).otherwise(0.0)
        near = near.select("u", F.col("x").isNotNull().alias("active"), F.greatest(h - eta * grad / F.col("d"), F.lit(0.0)).alias("y"), (F.coalesce("inward", F.lit(0)) / F.col("d")).alias("share"))
        near = materialize(near, "near")
        grown = near.where(~F.col("active") & (F.col("y") > 0)).orderBy(F.desc(F.col("y") * F.pow("share", F.lit(gamma))), "u").limit(k)
        stay = near.where("active").where((F.col("y") > 0) | (F.col("u") == seed))
        x = materialize(stay.unionByName(grown).select("u", F.col("y").alias("x")), "heights")
    return x


def label_rounds(g: Graph, rounds: int) -> DataFrame:
    """(u, label, n): labels heard in rounds of speaker-listener propagation, each with its count.

    All vertices speak at once: the label they hold most often, the least of equal
    ones; a listener keeps the one heard with the greatest weight, again the least of
    equal ones. Deterministic, so it differs from a random speaker's run.
    """
    memory = materialize(g.vertices.select("u", F.col("u").alias("label"), F.lit(1).cast("bigint").alias("n")), "labels")
    for _ in range(rounds):
        says = memory.groupBy("u").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select("u", (-F.col("b.l")).alias("label"))
        heard = g.adj.join(says, "u").groupBy(F.col("v").alias("u"), "label").agg(F.sum("w").alias("w"))
        kept = heard.groupBy("u").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("b")).select("u", (-F.col("b.l")).alias("label"), F.lit(1).cast("bigint").alias("n"))
        memory = materialize(memory.unionByName(kept).groupBy("u", "label").agg(F.sum("n").alias("n")), "labels")
    return memory


def label_cover(memory: DataFrame, share: Column | float) -> DataFrame:
    """(cid, node): labels that make up at least ``share`` of what a vertex heard."""
    total = memory.groupBy("u").agg(F.sum("n").alias("t"))
    return memory.join(total, "u").where(F.col("n") >= share * F.col("t")).select(F.col("label").alias("cid"), F.col("u").alias("node"))


def ego_components(g: Graph) -> DataFrame:
    """(ego, u, c): the component of each neighbour in its ego's neighbourhood, named by its least vertex.

    An ego's neighbours are united by one task, which finds the edges between them.
    """
    return ego_parts(g)


def persona_ids(g: Graph) -> DataFrame:
    """(u, c, persona): each vertex split into one persona per ego component."""
    return ego_parts(g, heads=True).select(F.col("ego").alias("u"), "c", _persona("ego", "c").alias("persona"))


def _persona(u: str, c: str) -> Column:
    return F.concat_ws("/", u, c)


def _split(ego: DataFrame, g: Graph) -> DataFrame:
    """(u, v, cu, cv, w): each edge with the components that its ends have in each other's neighbourhoods."""
    low = F.col("ego") < F.col("u")
    null = F.lit(None).cast("bigint")
    ends = ego.select(F.least("ego", "u").alias("u"), F.greatest("ego", "u").alias("v"), F.when(low, F.col("c")).alias("cu"), F.when(~low, F.col("c")).alias("cv"), null.alias("w"))
    every = ends.unionByName(g.edges.select("u", "v", null.alias("cu"), null.alias("cv"), "w"))
    return every.groupBy("u", "v").agg(F.max("cu").alias("cu"), F.max("cv").alias("cv"), F.max("w").alias("w"))


def personas(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(u, c, persona) and (p, q, w): each vertex split into one persona per ego component, and their edges.

    An edge joins the persona of either end in whose component the other end lies.
    """
    ego = materialize(ego_components(g), "ego")
    ids = ego.select(F.col("ego").alias("u"), "c").distinct()
    return ids.select("u", "c", _persona("u", "c").alias("persona")), _split(ego, g).select(_persona("u", "cu").alias("p"), _persona("v", "cv").alias("q"), "w")


def ego_splitting(g: Graph, least: int = 1) -> DataFrame:
    """(cid, node): components of the persona graph carried back to vertices; groups under ``least`` are left out.

    A group is named by its least persona.
    """
    ego = materialize(ego_components(g), "ego")
    ends = _split(ego, g)
    # a persona is named by two numbers while components are found
    links = ends.select(F.struct("u", F.col("cu").alias("c")).alias("u"), F.struct(F.col("v").alias("u"), F.col("cv").alias("c")).alias("v"))
    comp = materialize(components(links), "groups").select(F.col("u.u").alias("node"), F.col("u.c").alias("c"), F.col("c").alias("g"))
    names = comp.groupBy("g").agg(F.min(_persona("node", "c")).alias("cid"), F.count_distinct("node").alias("k")).where(F.col("k") >= least)
    return comp.select("g", "node").distinct().join(names, "g").select("cid", "node")


def top_labels(memory: DataFrame) -> DataFrame:
    """(u, l): the label each vertex holds most often, the least of equal ones."""
    w = Window.partitionBy("u").orderBy(F.desc("n"), "label")
    return memory.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("u", F.col("label").alias("l"))
