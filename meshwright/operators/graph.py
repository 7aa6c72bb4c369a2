"""Graphs as edge tables, and the graphs derived from ordinary tables.

A graph is ``edges(u, v, w)`` with u < v, a whole positive weight and one row a
pair, plus its vertices. ``adj`` holds both directions; all metrics and criteria
are joins and aggregates over it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.session import materialize, table

EDGE = "u bigint, v bigint, w bigint"


class Graph:
    """A weighted undirected graph without loops.

    ``vertices`` may hold isolated vertices; without it the ends of edges are the
    vertices. An empty edge table is a graph of volume 0.
    """

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None):
        self.edges = edges.select("u", "v", "w")
        self._vertices = vertices
        self.written = False  # whether the edges are files as they are

    def edge_files(self) -> list[str]:
        """Parquet files with u and v of all edges, written if they aren't there."""
        return (self.edges if self.written else materialize(self.edges.select("u", "v"), "edges")).inputFiles()

    @classmethod
    def from_rows(cls, rows: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """From raw (u, v, w) rows: ends are ordered, parallel rows summed, loops and w <= 0 left out.

        ``rejects`` names what is left out here.
        """
        ok = rows.where((F.col("u") != F.col("v")) & (F.col("w") > 0))
        edges = ok.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.sum("w").alias("w"))
        return cls(edges, vertices)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def adj(self) -> DataFrame:
        """(u, v, w) in both directions."""
        return self.edges.unionByName(self.edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))

    @cached_property
    def vertices(self) -> DataFrame:
        return self._vertices if self._vertices is not None else self.degrees.select("u")

    @cached_property
    def degrees(self) -> DataFrame:
        """(u, d): summed weight of each vertex' edges; isolated vertices have 0."""
        d = self.adj.groupBy("u").agg(F.sum("w").alias("d"))
        if self._vertices is not None:
            d = self._vertices.select("u").distinct().join(d, "u", "left").select("u", F.coalesce("d", F.lit(0)).alias("d"))
        return materialize(d, "degrees")

    @cached_property
    def volume(self) -> int:
        """The sum of all degrees, one number."""
        return int(self.edges.agg(F.sum("w").alias("m")).first()["m"] or 0) * 2

    @cached_property
    def weighed(self) -> DataFrame:
        """(u, v, w, du, dv): edges with the degrees of both ends."""
        du = self.degrees.select("u", F.col("d").alias("du"))
        dv = self.degrees.select(F.col("u").alias("v"), F.col("d").alias("dv"))
        return self.edges.join(du, "u").join(dv, "v").select("u", "v", "w", "du", "dv")

    def affinities(self, p: int, q: int) -> DataFrame:
        """(u, v, w, du, dv, c): edges with  c = q m w - p du dv, the affinity at resolution p / q times q m."""
        return self.weighed.withColumn("c", F.lit(q * self.volume) * F.col("w") - F.lit(p) * F.col("du") * F.col("dv"))


def rejects(rows: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(reason, n) of raw (u, v, w) rows: loop, reversed, weight, duplicate, null, unknown_vertex.

    A row may count under several reasons; reasons that don't occur aren't listed.
    """
    checks = {
        "loop": F.col("u") == F.col("v"),
        "reversed": F.col("u") > F.col("v"),
        "weight": F.col("w") <= 0,
        "null": F.col("u").isNull() | F.col("v").isNull() | F.col("w").isNull(),
    }
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))
    found = rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    pairs = rows.groupBy("u", "v").agg(F.count("*").alias("k")).where("k > 1")
    found = found.unionByName(pairs.agg(F.sum(F.col("k") - 1).alias("n")).where("n > 0").select(F.lit("duplicate").alias("reason"), "n"))
    if vertices is not None:
        ends = rows.select(F.explode(F.array("u", "v")).alias("u")).where(F.col("u").isNotNull())
        lost = ends.join(vertices.select("u").distinct(), "u", "left_anti").agg(F.count("*").alias("n")).where("n > 0")
        found = found.unionByName(lost.select(F.lit("unknown_vertex").alias("reason"), "n"))
    return found


def asymmetries(adj: DataFrame) -> DataFrame:
    """Rows of an adjacency table without an equal row in the other direction; none if it is symmetric."""
    return adj.select("u", "v", "w").exceptAll(adj.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def fingerprint(edges: DataFrame) -> DataFrame:
    """(edges, weight, digest): an order-insensitive digest of the edge table in one pass.

    Each row's SHA-256 is folded by exclusive or, so that partial results combine
    on the map side and nothing is collected; equal tables have equal digests.
    """
    h = F.sha2(F.concat_ws(",", "u", "v", "w"), 256)
    words = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    folded = edges.agg(F.count("*").alias("edges"), F.sum("w").alias("weight"), *(F.bit_xor(w).alias(f"_{i}") for i, w in enumerate(words)))
    digest = F.concat(*(F.lpad(F.lower(F.hex(F.coalesce(F.col(f"_{i}"), F.lit(0)))), 8, "0") for i in range(8)))
    return folded.select("edges", "weight", digest.alias("digest"))


def co_occurrence(rows: DataFrame, group: str, item: str) -> Graph:
    """Items are vertices; an edge weighs how many groups hold both. Nulls and repeats don't count."""
    pairs = rows.select(F.col(group).alias("g"), F.col(item).cast("bigint").alias("u")).where(F.col("g").isNotNull() & F.col("u").isNotNull())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(parts, "g").sortWithinPartitions("g", "u").mapInArrow(_pairs_by_group, "u long, v long")
    return Graph(pairs.groupBy("u", "v").agg(F.count("*").alias("w")))


#: Pairs that a task makes at a time.
_PAIRS = 1 << 20


def _pairs_by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each two distinct items u < v of a group, of rows (g, u) sorted by both; a task holds a batch and the group that it ends with."""

    def made(u: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
        # each item with those after it up to its group's end
        n = stop - np.arange(len(u)) - 1
        total, at = np.concatenate([[0], np.cumsum(n)]), 0
        while at < len(u):
            end = max(int(np.searchsorted(total, total[at] + _PAIRS, "right")) - 1, at + 1)
            first = np.repeat(np.arange(at, end), n[at:end])
            other = first + 1 + np.arange(len(first)) - np.repeat(total[at:end] - total[at], n[at:end])
            yield pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(u[other])], names=["u", "v"])
            at = end

    key, rest = None, []
    for batch in batches:
        g, u = batch.column("g"), batch.column("u").to_numpy()
        ends = pc.run_end_encode(g).run_ends.to_numpy()
        if rest and g[0].as_py() == key:
            # the group goes on, and may go on further
            if len(ends) == 1:
                rest.append(u)
                continue
            rest.append(u[: ends[0]])
            u, ends = u[ends[0] :], ends[1:] - ends[0]
        last = int(ends[-2]) if len(ends) > 1 else 0
        if rest:
            own = np.unique(np.concatenate(rest))
            yield from made(own, np.full(len(own), len(own)))
        key, rest = g[len(g) - 1].as_py(), [u[last:]]
        ends, u = ends[:-1], u[:last]
        of = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
        once = np.append(True, (of[1:] != of[:-1]) | (u[1:] != u[:-1]))[: len(u)]
        u, of = u[once], of[once]
        yield from made(u, np.searchsorted(of, of, "right"))
    if rest:
        own = np.unique(np.concatenate(rest))
        yield from made(own, np.full(len(own), len(own)))


#: Derived graphs of this application, by folder and name.
_held: dict[tuple[str, str, str], Graph] = {}


def held(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> Graph:
    """The derived graph ``name`` of the tables below ``d``, written once per application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _held:
        _held[key] = Graph(materialize(make().sortWithinPartitions("u", "v"), name, compression="zstd"))
        _held[key].written = True
    return _held[key]


def forget(spark: SparkSession) -> None:
    """Drop what is held for this application."""
    for key in [k for k in _held if k[0] == spark.sparkContext.applicationId]:
        del _held[key]


def g_part(spark: SparkSession, d: str) -> Graph:
    """Parts ordered together."""
    return held(spark, d, "g_part", lambda: co_occurrence(table(spark, d, "lineitem"), "l_orderkey", "l_partkey").edges)


def g_supp(spark: SparkSession, d: str) -> Graph:
    """Suppliers that serve the same orders."""
    return held(spark, d, "g_supp", lambda: co_occurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey").edges)


#: Offsets that keep the ids of g_geo's kinds of vertices apart.
SUPPLIER, NATION, REGION = 10**12, 2 * 10**12, 3 * 10**12


def g_geo(spark: SparkSession, d: str) -> Graph:
    """Customers and suppliers hang on nations, nations on regions; all weights 1."""

    def make() -> DataFrame:
        c = table(spark, d, "customer").select(F.col("c_custkey").alias("u"), (F.col("c_nationkey") + F.lit(NATION)).alias("v"))
        s = table(spark, d, "supplier").select((F.col("s_suppkey") + F.lit(SUPPLIER)).alias("u"), (F.col("s_nationkey") + F.lit(NATION)).alias("v"))
        n = table(spark, d, "nation").select((F.col("n_nationkey") + F.lit(NATION)).alias("u"), (F.col("n_regionkey") + F.lit(REGION)).alias("v"))
        return reduce(DataFrame.unionByName, [c, s, n]).where("u IS NOT NULL AND v IS NOT NULL").withColumn("w", F.lit(1).cast("bigint"))

    return held(spark, d, "g_geo", make)


#: Weight of the edge between two customers of neighbouring ids in g_pair.
PAIRED = 50


def g_pair(spark: SparkSession, d: str) -> Graph:
    """Customers 2k and 2k + 1 in close pairs, each customer hung on its nation: pairs of one nation close triangles."""

    def make() -> DataFrame:
        c = table(spark, d, "customer").where("c_custkey IS NOT NULL").select("c_custkey", "c_nationkey")
        hung = c.where("c_nationkey IS NOT NULL").select(F.col("c_custkey").alias("u"), (F.col("c_nationkey") + F.lit(NATION)).alias("v"), F.lit(1).cast("bigint").alias("w"))
        even = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 1).alias("v"))
        odd = c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("v"))
        return hung.unionByName(even.join(odd, "v").select("u", "v", F.lit(PAIRED).cast("bigint").alias("w")))

    return held(spark, d, "g_pair", make)


def brand_labels(spark: SparkSession, d: str) -> DataFrame:
    """(u, l): the brand of each part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("u"), F.col("p_brand").alias("l"))
