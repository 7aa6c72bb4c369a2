"""Small regions cut out of a large graph, and kernels run on each of them in parallel.

A region is gathered per query or block by joins; a task then holds one region at a
time as whole-number arrays. How large a region may be is a parameter: larger ones
are reported, not cut short. Blocks have no such limit unless it is given: large ones
are judged by sums first. A retrieval's region grows where its diffusion does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meshwright.functions import diffuse, exact, grouping
from meshwright.functions.compose import compose
from meshwright.functions.cuts import quality, refine, regional_bound
from meshwright.functions.region import Region
from meshwright.operators import iterative, screens
from meshwright.operators.graph import Graph
from meshwright.session import materialize


def regions(g: Graph, starts: DataFrame, hops: int, key: str = "query_id") -> DataFrame:
    """(key, u): the vertices within some hops of the starts (key, u)."""
    found = starts.select(key, "u").distinct()
    for _ in range(hops):
        near = found.join(g.adj, "u").select(key, F.col("v").alias("u"))
        found = materialize(found.unionByName(near).distinct(), "region")
    return found


def region_rows(g: Graph, members: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, u, v, w, du, dv): all edges of each region's vertices with both ends' whole degrees."""
    d = g.degrees
    r = members.join(d.withColumnRenamed("d", "du"), "u").join(g.adj, "u", "left")
    return r.join(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v", "left").select(key, "u", "v", "w", "du", "dv")


#: Edges that one task's kernel takes: some 500 MB while a region is read.
LIMIT = 2_000_000
#: Result rows that a task gathers before it hands them on.
_ROWS = 10_000
#: The status of a region too large for one task's kernel.
_OVER = "region_limit"


def per_region(rows: DataFrame, key: str, schema: str, kernel: Callable[[Region, pd.DataFrame | None], list[tuple]], extra: DataFrame | None = None, limit: int | None = LIMIT, instead: list[Column] | None = None) -> DataFrame:
    """``kernel`` run on each region; its tuples fill ``schema`` after the key.

    ``extra`` (key, ...) rides along, one row per region. A region of more than
    ``limit`` edges gives one row of ``instead`` (expressions over ``extra``, in the
    order of ``schema``); without it none, and ``oversized`` has to be asked. Without
    a limit the kernel is run on all. The kernel is given its region's row of ``extra`` as a pandas table of one row, or None.
    A task reads its regions one after another from sorted rows.
    """
    every = rows
    if limit is not None:
        small = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") <= limit).select(key)
        rows = rows.join(small, key, "left_semi")
    if extra is not None:
        rows = rows.join(extra, key)
    kind = rows.select(key).schema[0].dataType.simpleString()
    shape = to_arrow_schema(StructType.fromDDL(f"{key} {kind}, {schema}"))
    names, rides = shape.names[1:], extra is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the region being read, which may go on in the next batch
        own, first, out = None, None, []

        def end() -> None:
            u, v, w, du, dv, has = held[0] if len(held) == 1 else (np.concatenate(c) for c in zip(*held))
            held.clear()
            if has.all():
                region = Region.build(u, v, w, du, dv)
            else:
                region = Region.build(u[has], v[has], w[has], du[has], dv[has], u[~has], du[~has])
            del u, v, w, du, dv, has
            out.extend((own, *t) for t in kernel(region, first))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(shape)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=True) for c, f in zip(cols, shape)], schema=shape)

        for batch in batches:
            cols = [pc.fill_null(batch.column(c), 0).to_numpy() for c in ("u", "v", "w", "du", "dv")]
            cols.append(batch.column("v").is_valid().to_numpy(zero_copy_only=False))
            keys, begin = batch.column(key), 0
            for stop in pc.run_end_encode(keys).run_ends.to_pylist():
                here = keys[begin].as_py()
                if not held or here != own:
                    if held:
                        end()
                    own, first = here, batch.slice(begin, 1).to_pandas() if rides else None
                held.append(tuple(c[begin:stop] for c in cols))
                begin = stop
                if len(out) >= _ROWS:
                    yield flush()
        if held:
            end()
        yield flush()

    # a stated number of tasks: small tables with slow kernels would else come to one
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by the hash of the key: Spark would leave out a shuffle by the key itself after a join, and read that join locally later
    done = rows.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key).mapInArrow(run, f"{key} {kind}, {schema}")
    if instead is None or limit is None:
        return done
    over = oversized(every, key, limit)
    if extra is not None:
        over = over.join(extra, key)
    types = [f.dataType for f in done.schema.fields[1:]]
    return done.unionByName(over.select(key, *(c.cast(t).alias(n) for c, t, n in zip(instead, types, names, strict=True))))


def oversized(rows: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """(key, edges) of the regions too large for one task's kernel."""
    return rows.groupBy(key).agg(F.count("*").alias("edges")).where(F.col("edges") > limit)


_FOUND = "variant string, seed long, status string, size int, z double, lower_bound double, region int, vertices array<long>"


def retrieve(g: Graph, queries: DataFrame, variants: Sequence[str] = ("main",), limit: int = LIMIT) -> DataFrame:
    """(query_id, variant, seed, status, size, z, lower_bound, region, vertices) of seeded retrievals (query_id, seed).

    A query starts with its seed's neighbourhood. Where a diffusion would raise
    vertices outside, those come in with their neighbours and the query runs again,
    so a region is as large as its diffusions ask for. A seed whose region has more
    than ``limit`` edges is searched no further: its status is ``region_limit`` and it
    has no size or quality. A seed without edges is alone, one that isn't in the
    graph gives no row.
    """
    m, names = g.volume, list(variants)
    seeds = queries.select("query_id", "seed")
    members = regions(g, seeds.withColumnRenamed("seed", "u"), 1)
    done: DataFrame | None = None
    while True:

        def kernel(region: Region, pdf: pd.DataFrame) -> list[tuple]:
            seed = int(pdf["seed"].iloc[0])
            at = region.place(seed)
            if region.degree[at] <= 0:
                return [(k, seed, "zero_degree", 1, None, None, 0, [seed]) for k in names]
            spread, out = diffuse.Diffusions(region, at), []
            try:
                for k in names:
                    r = diffuse.retrieve(region, m, at, diffuse.VARIANTS[k], spread=spread)
                    out.append((k, seed, r["status"], len(r["places"]), r.get("z"), r["lower_bound"], r["territory"], region.ids[r["places"]].tolist()))
            except diffuse.RimRaised as more:
                return [(names[0], seed, "grows", None, None, None, None, more.vertices)]
            return out

        over = [F.lit(names[0]), F.col("seed"), F.lit(_OVER), *[F.lit(None)] * 4, F.array("seed")]
        got = materialize(per_region(region_rows(g, members), "query_id", _FOUND, kernel, seeds, limit, over), "found")
        ready = got.where("status <> 'grows'")
        done = ready if done is None else done.unionByName(ready)
        more = got.where("status = 'grows'").select("query_id", F.explode("vertices").alias("u"))
        if more.isEmpty():
            return done
        near = more.join(g.adj, "u").select("query_id", F.col("v").alias("u"))
        stay = members.join(more.select("query_id").distinct(), "query_id", "left_semi")
        members = materialize(stay.unionByName(more).unionByName(near).distinct(), "region")


def local_push(g: Graph, queries: DataFrame, alpha: float, rho: float, hops: int = 2, limit: int = LIMIT) -> DataFrame:
    """(query_id, u, rank, residual, status) of push with an exact queue within the hops of each seed.

    Where the region has more than ``limit`` edges nothing is pushed: all mass is left
    at the seed. ``iterative.push_rounds`` has no such limit.
    """
    rows = region_rows(g, regions(g, queries.select("query_id", F.col("seed").alias("u")), hops))

    def kernel(region: Region, pdf: pd.DataFrame) -> list[tuple]:
        rank, rest = diffuse.push(region, region.place(int(pdf["seed"].iloc[0])), alpha, rho)
        rank = np.concatenate([rank, np.zeros(len(region.rim_ids))])
        k = np.flatnonzero((rank > 0) | (rest > 0))
        ids = np.concatenate([region.ids, region.rim_ids])[k]
        return [(u, a, b, "pushed") for u, a, b in zip(ids.tolist(), rank[k].tolist(), rest[k].tolist())]

    return per_region(rows, "query_id", "u long, rank double, residual double, status string", kernel, queries.select("query_id", "seed"), limit, [F.col("seed"), F.lit(0.0), F.lit(1.0), F.lit(_OVER)])


def diffusions(g: Graph, queries: DataFrame, hops: int = 2, limit: int = LIMIT) -> DataFrame:
    """(query_id, u, x, status) of the diffusion (query_id, seed, mass); x is null where the region has more than ``limit`` edges."""
    rows = region_rows(g, regions(g, queries.select("query_id", F.col("seed").alias("u")), hops))

    def kernel(region: Region, pdf: pd.DataFrame) -> list[tuple]:
        x, _ = diffuse.solve(region, region.place(int(pdf["seed"].iloc[0])), float(pdf["mass"].iloc[0]))
        k = np.flatnonzero(x > 0)
        return [(u, h, "diffused") for u, h in zip(region.ids[k].tolist(), x[k].tolist())]

    return per_region(rows, "query_id", "u long, x double, status string", kernel, queries.select("query_id", "seed", "mass"), limit, [F.col("seed"), F.lit(None), F.lit(_OVER)])


def optimality(g: Graph, heights: DataFrame, queries: DataFrame, sigma: float = 1e-4) -> DataFrame:
    """(query_id, breach, mass_gap) of heights (query_id, u, x): an independent check by joins.

    ``breach`` is the greatest violation of the optimality conditions over d;
    ``mass_gap`` is the mass less what the support's volume, its rim's flow and the
    regulariser take up.
    """
    x = heights.select("query_id", "u", "x")
    ax = x.join(g.adj, "u").groupBy("query_id", F.col("v").alias("u")).agg(F.sum(F.col("w") * F.col("x")).alias("ax"))
    j = ax.join(x, ["query_id", "u"], "full_outer").join(g.degrees, "u").join(queries.select("query_id", "seed", "mass"), "query_id")
    h, a = F.coalesce("x", F.lit(0.0)), F.coalesce("ax", F.lit(0.0))
    grad = (1 + sigma) * F.col("d") * h - a + F.col("d") - F.when(F.col("u") == F.col("seed"), F.col("mass")).otherwise(0.0)
    breach = F.when(h > 0, F.abs(grad)).otherwise(F.greatest(-grad, F.lit(0.0))) / F.col("d")
    rim = F.sum(F.when(h > 0, F.lit(0.0)).otherwise(a))
    inner = F.sum(F.when(h > 0, F.col("d") + sigma * F.col("d") * h).otherwise(0.0))
    return j.groupBy("query_id").agg(F.max(breach).alias("breach"), (F.max("mass") - rim - inner).alias("mass_gap"))


def activation_masses(g: Graph, queries: DataFrame, sigma: float = 1e-4) -> DataFrame:
    """(query_id, mass) above which each seed's first neighbour becomes active."""
    d = g.degrees
    j = queries.select("query_id", F.col("seed").alias("u")).join(d, "u").join(g.adj, "u").join(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    return j.groupBy("query_id", "d").agg(F.min(F.col("dv") / F.col("w")).alias("r")).select("query_id", (F.col("d") + (1 + sigma) * F.col("d") * F.col("r")).alias("mass"))


def refinements(g: Graph, members: DataFrame, starts: DataFrame, seeds: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, size, steps, z, lower_bound, status) of sets (query_id, u) refined by exact cuts within regions (query_id, u).

    Regions of more than ``limit`` edges have status ``region_limit`` and nothing else.
    """
    m = g.volume
    start = starts.groupBy("query_id").agg(F.sort_array(F.collect_set("u")).alias("start"))
    rows = region_rows(g, members)

    def kernel(region: Region, pdf: pd.DataFrame) -> list[tuple]:
        seed = region.place(int(pdf["seed"].iloc[0]))
        if region.degree[seed] <= 0:
            return [(1, 0, None, None, "zero_degree")]
        given = np.flatnonzero(np.isin(region.ids, np.asarray(pdf["start"].iloc[0])))
        s, steps = refine(region, m, seed, set(given.tolist()))
        bound, _, _ = regional_bound(region, m, seed)
        return [(len(s), steps, float(quality(region, m, s)), bound, "refined")]

    return per_region(rows, "query_id", "size int, steps int, z double, lower_bound double, status string", kernel, seeds.join(start, "query_id"), limit, [*[F.lit(None)] * 4, F.lit(_OVER)])


#: Named block criteria at resolution 1: block, m -> status.
CRITERIA: dict[str, Callable[[Region, int], str]] = {
    "degree_copy": lambda b, m: exact.block_certificate(b, m, Fraction(1)),
    "uniform_copy": lambda b, m: exact.contrast_certificate(b, m, Fraction(1)),
    "zero_copy": lambda b, m: exact.block_certificate(b, m, Fraction(1), "zero"),
    "anchor_copy": lambda b, m: exact.block_certificate(b, m, Fraction(1), "anchor"),
    "full_pairs": lambda b, m: exact.pairs_certificate(b, m, Fraction(1)),
    "almost_clique": lambda b, m: exact.almost_clique(b, m, 1, 1)[0],
    "positive_closure": lambda b, m: exact.closure_block(b, m, 1, 1)[0],
}


#: The criteria of a panel unless others are named.
MAIN_CRITERIA = ["almost_clique", "degree_copy", "positive_closure", "uniform_copy"]


def _edge_counts(g: Graph, members: DataFrame, key: str) -> DataFrame:
    """(key, edges): the rows of ``region_rows`` of each region, without making them."""
    k = g.adj.groupBy("u").agg(F.count("*").alias("k"))
    return members.join(k, "u", "left").groupBy(key).agg(F.sum(F.coalesce("k", F.lit(1))).alias("edges"))


_PANEL = "size int, method string, status string"


def block_panel(g: Graph, blocks: DataFrame, methods: list[str] | None = None, limit: int | None = None, large: int = LIMIT) -> DataFrame:
    """(block_id, size, method, status): each block (block_id, u) under each named criterion.

    Repeated members count once, null ones and those that aren't in the graph not at
    all. Blocks of fewer than two vertices stay in the table as ``too_small``. Those of
    more than ``large`` edges are judged by sums over their members and columns
    (``screens``); what these leave open the kernel judges whole, however large. Only
    where a ``limit`` is given, blocks of more edges aren't judged: ``size_limit``.
    """
    methods, m = methods or MAIN_CRITERIA, g.volume
    b = blocks.select("block_id", "u").distinct().join(g.vertices.select("u"), "u", "left_semi")
    size = b.groupBy("block_id").agg(F.count("*").cast("int").alias("size"))
    b = b.join(size.where("size > 1"), "block_id", "left_semi")
    each = F.explode(F.array(*map(F.lit, methods))).alias("method")
    rest = size.where("size < 2").select("block_id", "size", each, F.lit("too_small").alias("status"))

    def kernel(block: Region, pdf: pd.DataFrame | None) -> list[tuple]:
        todo = methods if pdf is None else [k for i, k in enumerate(methods) if int(pdf["todo"].iloc[0]) >> i & 1]
        return [(block.n, k, CRITERIA[k](block, m)) for k in todo]

    if limit is not None:
        rows = region_rows(g, b, "block_id")
        over = oversized(rows, "block_id", limit).join(size, "block_id").select("block_id", "size", each, F.lit("size_limit").alias("status"))
        return per_region(rows, "block_id", _PANEL, kernel, None, limit).unionByName(rest).unionByName(over)
    heavy = materialize(_edge_counts(g, b, "block_id").where(F.col("edges") > large).select("block_id"), "heavy")
    if heavy.isEmpty():
        return per_region(region_rows(g, b, "block_id"), "block_id", _PANEL, kernel, None, None).unionByName(rest)
    done = per_region(region_rows(g, b.join(heavy, "block_id", "left_anti"), "block_id"), "block_id", _PANEL, kernel, None, None).unionByName(rest)
    b = materialize(b.join(heavy, "block_id", "left_semi"), "members")
    found = materialize(screens.verdicts(g, region_rows(g, b, "block_id"), b, methods), "verdicts")
    done = done.unionByName(found.where("status IS NOT NULL"))
    bit = reduce(lambda x, i: x.when(F.col("method") == methods[i], 1 << i), range(1, len(methods)), F.when(F.col("method") == methods[0], 1))
    still = materialize(found.where("status IS NULL").groupBy("block_id").agg(F.sum(bit).alias("todo")), "open")
    if still.isEmpty():
        return done
    return done.unionByName(per_region(region_rows(g, b.join(still, "block_id", "left_semi"), "block_id"), "block_id", _PANEL, kernel, still, None))


def optima(g: Graph, blocks: DataFrame, cap: int = 10) -> DataFrame:
    """(block_id, size, active, kept, ties): whether keeping a block whole is optimal for it and who is drawn to it.

    ``kept`` is null, and ``ties`` 0, where more than ``cap`` vertices are involved:
    those aren't enumerated (10 vertices have 115,975 partitions, 12 over 4 million).
    """
    m = g.volume
    rows = region_rows(g, blocks.select("block_id", "u").distinct(), "block_id")

    def kernel(block: Region, pdf: pd.DataFrame) -> list[tuple]:
        near, degree = block.as_rows()
        active, value, whole = exact.subinstance(near, degree, m, sorted(near), Fraction(1))
        if len(active) > cap:
            return [(len(near), len(active), None, 0)]
        best, ties, _ = exact.best_partition(len(active), value)
        return [(len(near), len(active), whole == best, ties)]

    return per_region(rows, "block_id", "size int, active int, kept boolean, ties int", kernel, None, instead=[F.lit(None), F.lit(None), F.lit(None), F.lit(0)])


def compositions(g: Graph, parts: DataFrame, bank: DataFrame, mode: str = "S", cap: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(part, u, g): groups of each part's own subgraph (part, u) after sequential composition with its bank (part, block_id, u).

    Each part is a graph of its own: edges that leave it don't count. A part of more
    than ``limit`` edges gives one row of null u and g. Parts are small by nature,
    since merges follow one another.
    """
    inside = parts.select("part", F.col("u").alias("v"))
    rows = region_rows(g, parts, "part").join(inside, ["part", "v"], "left_semi").select("part", "u", "v", "w", "du", "dv")
    blocks = bank.select("part", "block_id", "u").distinct().groupBy("part", "block_id").agg(F.sort_array(F.collect_list("u")).alias("b"))
    blocks = blocks.groupBy("part").agg(F.collect_list("b").alias("bank"))
    extra = parts.select("part").distinct().join(blocks, "part", "left")

    def kernel(region: Region, pdf: pd.DataFrame) -> list[tuple]:
        near, _ = region.as_rows()
        degree = {u: sum(r.values()) for u, r in near.items()}
        given = pdf["bank"].iloc[0]
        own = [] if given is None else [[int(u) for u in b if int(u) in near] for b in given]
        groups, _ = compose(near, degree, sum(degree.values()), [b for b in own if len(b) > 1], mode=mode, cap=cap)
        return [(u, gr[0]) for gr in groups for u in gr]

    return per_region(rows, "part", "u long, g long", kernel, extra, limit, [F.lit(None), F.lit(None)])


def _induced(g: Graph, parts: DataFrame) -> DataFrame:
    """(part, u, v, w, du, dv): the edges inside each part (part, u), and a row of null v for each of its vertices."""
    inside = parts.select("part", F.col("u").alias("v"))
    rows = region_rows(g, parts, "part").join(inside, ["part", "v"], "left_semi").select("part", "u", "v", "w", "du", "dv")
    alone = parts.join(g.degrees.withColumnRenamed("d", "du"), "u").select("part", "u", F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("w"), "du", F.lit(None).cast("long").alias("dv"))
    return rows.unionByName(alone)


def groupings(g: Graph, parts: DataFrame, seed: int = 0, limit: int = LIMIT) -> DataFrame:
    """(part, u, l): local-move partitions of the subgraphs induced by disjoint parts (part, u).

    A part of more than ``limit`` inner edges gives one row of null u and l.
    """
    def kernel(region: Region, pdf: pd.DataFrame) -> list[tuple]:
        return sorted(grouping.louvain(region.as_rows()[0], seed=seed).items())

    return per_region(_induced(g, parts), "part", "u long, l long", kernel, None, limit, [F.lit(None), F.lit(None)])


_FOREST = "block int, u long"


def forests(g: Graph, parts: DataFrame, limit: int | None = None, large: int = LIMIT) -> DataFrame:
    """(part, block, u): bisection forests of the subgraphs induced by disjoint parts (part, u), scaled by whole degrees.

    Blocks are numbered in the order of the forest. A part of more than ``large`` inner
    edges is taken apart into its connected parts first, each of which is one task's.
    Only where a ``limit`` is given, a part of more inner edges gives one row of null
    block and u.
    """

    def kernel(region: Region, pdf: pd.DataFrame | None) -> list[tuple]:
        return [(i, u) for i, b in enumerate(grouping.region_forest(region)) for u in b.tolist()]

    if limit is not None:
        return per_region(_induced(g, parts), "part", _FOREST, kernel, None, limit, [F.lit(None), F.lit(None)])
    parts = parts.where("part IS NOT NULL")
    maybe = materialize(_edge_counts(g, parts, "part").where(F.col("edges") > large).select("part"), "heavy")
    if maybe.isEmpty():
        return per_region(_induced(g, parts), "part", _FOREST, kernel, None, None)
    done = per_region(_induced(g, parts.join(maybe, "part", "left_anti")), "part", _FOREST, kernel, None, None)
    rows = materialize(_induced(g, parts.join(maybe, "part", "left_semi")), "induced")
    heavy = materialize(oversized(rows, "part", large).select("part"), "heavy")
    done = done.unionByName(per_region(rows.join(heavy, "part", "left_anti"), "part", _FOREST, kernel, None, None))
    if heavy.isEmpty():
        return done
    rows = rows.join(heavy, "part", "left_semi").where("du > 0")
    member = rows.where("v IS NULL").select("part", "u")
    split = iterative.components(rows.where("u < v").select("u", "v"), member.select("u"))
    member = materialize(member.join(split, "u"), "components")
    # a part in several pieces is a block itself, and is split only if it has four vertices
    shape = member.groupBy("part").agg(F.count_distinct("c").alias("pieces"), F.count("*").alias("n")).where("n > 1")
    whole = member.join(shape.where("pieces > 1"), "part", "left_semi").select("part", F.lit(0).alias("block"), "u")
    own = member.join(shape.where("pieces = 1 OR n > 3"), "part", "left_semi").select("u", "c")
    trees = materialize(per_region(rows.drop("part").join(own, "u"), "c", _FOREST, kernel, None, None), "trees")
    # blocks of a piece follow those of the pieces before it
    count = trees.groupBy("c").agg((F.max("block") + 1).alias("k")).join(member.where("u = c").select("part", "c"), "c").join(shape, "part")
    before = F.coalesce(F.sum("k").over(Window.partitionBy("part").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = count.select("part", "c", (before + F.when(F.col("pieces") > 1, 1).otherwise(0)).cast("int").alias("first"))
    return done.unionByName(whole).unionByName(trees.join(first, "c").select("part", (F.col("block") + F.col("first")).alias("block"), "u"))


def bootstrap(values: DataFrame, panel: str, group: str, value: str, replicates: int = 2000, seed: int = 20261005) -> DataFrame:
    """(panel, n, groups, mean, mean_low, mean_high, median, ...): nested resampling of each panel's values.

    A panel's values come to one task: panels are summaries of finished cases.
    """
    names = ["n", "groups", "mean", "mean_low", "mean_high", "median", "median_low", "median_high"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = grouping.nested_bootstrap({str(k): v[value].tolist() for k, v in pdf.groupby(group)}, replicates, seed)
        return pd.DataFrame([[pdf[panel].iloc[0], *(got[k] for k in names)]], columns=[panel, *names]) if got else pd.DataFrame(columns=[panel, *names])

    clean = values.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(panel, group, value)
    return clean.groupBy(panel).applyInPandas(run, f"{panel} string, n long, groups long, " + ", ".join(f"{k} double" for k in names[2:]))


def unnested_supports(heights: DataFrame, order: DataFrame) -> DataFrame:
    """(query_id, mass, u) whose support isn't in the next larger mass' support; none if supports are nested.

    ``order`` is (query_id, mass, next_mass), ``heights`` (query_id, mass, u, x).
    """
    s = heights.where("x > 0").select("query_id", "mass", "u")
    nxt = s.withColumnRenamed("mass", "next_mass")
    return s.join(order.where("next_mass IS NOT NULL"), ["query_id", "mass"]).join(nxt, ["query_id", "next_mass", "u"], "left_anti").select("query_id", "mass", "u")
