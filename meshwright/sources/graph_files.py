"""Readers and writers of graph, cover, hypergraph and run-record files.

Everything is read with explicit schemas; rows that can't be read are kept apart
by the ``*_rejects`` readers rather than dropped without a trace.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators.graph import Graph
from meshwright.operators.ordered import row_numbers


def read_graph_json(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """A graph file ``{"n": .., "edges": [[u, v] or [u, v, w], ..]}``, and what is wrong with it.

    Weights default to 1; isolated vertices 0..n-1 stay. The second table is
    (reason, n): loop, reversed, weight, null, duplicate, unknown_vertex.
    """
    from meshwright.operators.graph import rejects

    raw = spark.read.schema("n bigint, edges array<array<bigint>>").option("multiLine", True).json(path)
    w = F.coalesce(F.get("e", F.lit(2)), F.lit(1)).alias("w")
    rows = raw.select(F.explode("edges").alias("e")).select(F.get("e", F.lit(0)).alias("u"), F.get("e", F.lit(1)).alias("v"), w)
    vertices = raw.where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("u"))
    return Graph.from_rows(rows, vertices), rejects(rows, vertices)


def write_graph_json(g: Graph, path: str) -> None:
    """One JSON row per edge, the form ``spark.read.json`` takes back; fails if the path exists."""
    g.edges.write.mode("errorifexists").json(path)


def read_cover_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """cover(cid, node) of ``{"communities": [[..], ..]}``, and (groups, empty, repeated) of what was cleaned.

    ``cid`` is the place in the file, so equal groups stay two; empty groups go and
    members repeated in a group count once.
    """
    raw = spark.read.schema("communities array<array<bigint>>, labels_complete boolean").option("multiLine", True).json(path)
    groups = raw.select(F.posexplode("communities").alias("cid", "m"))
    cover = groups.select("cid", F.explode("m").alias("node")).where("node IS NOT NULL").distinct()
    audit = groups.agg(F.count("*").alias("groups"), F.count_if(F.size("m") == 0).alias("empty"), F.sum(F.size("m") - F.size(F.array_distinct("m"))).alias("repeated"))
    return cover, audit


def read_edge_text(spark: SparkSession, path: str) -> tuple[Graph, DataFrame, DataFrame]:
    """A tab-separated edge list with ``#`` comments, plain or gzipped, as a simple undirected graph.

    Ids are renumbered 0, 1, ... in ascending order; vertices whose only rows are
    loops stay as isolated ones. Also (u, id), and (rows, loops, repeated).
    """
    raw = spark.read.schema("a bigint, b bigint").option("sep", "\t").option("comment", "#").csv(path).where("a IS NOT NULL AND b IS NOT NULL")
    ids = row_numbers(raw.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").select((F.col("n") - 1).alias("u"), "id")
    pairs = raw.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    simple = pairs.distinct()
    edges = simple.join(ids.select(F.col("id").alias("a"), "u"), "a").join(ids.select(F.col("id").alias("b"), F.col("u").alias("v")), "b")
    counts = raw.agg(F.count("*").alias("rows"), F.count_if(F.col("a") == F.col("b")).alias("loops")).join(simple.agg(F.count("*").alias("simple")), F.lit(True))
    g = Graph(edges.select("u", "v", F.lit(1).cast("bigint").alias("w")), ids.select("u"))
    return g, ids, counts.select("rows", "loops", (F.col("rows") - F.col("loops") - F.col("simple")).alias("repeated"))


def read_benchmark_text(spark: SparkSession, network: str, community: str) -> tuple[Graph, DataFrame, DataFrame]:
    """A benchmark's pair of 1-based text files as a graph, cover(cid, node), and (reason, n) of faults.

    ``network`` lists each edge in both directions; ``community`` gives each node's
    groups after a blank. Faults: one_way edges, unlisted nodes.
    """

    def ints(df: DataFrame) -> DataFrame:
        return df.select(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("t")).where(F.size("t") >= 2)

    rows = ints(spark.read.text(network)).select((F.get("t", F.lit(0)).try_cast("bigint") - 1).alias("u"), (F.get("t", F.lit(1)).try_cast("bigint") - 1).alias("v")).distinct()
    member = ints(spark.read.text(community)).select((F.get("t", F.lit(0)).try_cast("bigint") - 1).alias("node"), F.transform(F.slice("t", 2, 10**6), lambda x: x.try_cast("bigint") - 1).alias("c")).select(F.explode("c").alias("cid"), "node").distinct()
    one_way = rows.join(rows.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti").agg(F.count("*").alias("n"))
    unlisted = rows.select(F.col("u").alias("node")).distinct().join(member, "node", "left_anti").agg(F.count("*").alias("n"))
    faults = one_way.select(F.lit("one_way").alias("reason"), "n").unionByName(unlisted.select(F.lit("unlisted").alias("reason"), "n")).where("n > 0")
    edges = rows.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return Graph(edges.withColumn("w", F.lit(1).cast("bigint")), member.select(F.col("node").alias("u")).distinct()), member, faults


def read_hyperedges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """inc(e, u, r) of a file with one 1-based comma list a line, and (reason, n) of lines left out.

    Hyperedges are told apart by their line's text and number within equal ones.
    Lines with fewer than two members (rank), with a repeated one (repeated) or with
    something else than a whole number (unreadable) are left out.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    ids = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("bigint") - 1)
    h = lines.select(F.monotonically_increasing_id().alias("e"), ids.alias("m"))
    bad = F.when(F.exists("m", lambda x: x.isNull()), "unreadable").when(F.size("m") < 2, "rank").when(F.size(F.array_distinct("m")) < F.size("m"), "repeated")
    h = h.withColumn("bad", bad)
    inc = h.where("bad IS NULL").select("e", F.explode("m").alias("u"), F.size("m").cast("bigint").alias("r"))
    return inc, h.where("bad IS NOT NULL").groupBy(F.col("bad").alias("reason")).agg(F.count("*").alias("n"))


def read_csr(spark: SparkSession, folder: str, chunk: int = 1_000_000) -> Graph:
    """A folder of ``indptr.npy``, ``indices.npy`` and ``weights.npy``: memory-mapped, stretches of rows per task.

    The folder must be visible to every executor. Only edges u < v are kept.
    """
    n = len(np.load(f"{folder}/indptr.npy", mmap_mode="r")) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ptr, idx, wts = (np.load(f"{folder}/{x}.npy", mmap_mode="r") for x in ("indptr", "indices", "weights"))
        for pdf in batches:
            for lo in pdf["id"]:
                hi = min(int(lo) + chunk, n)
                a, b = int(ptr[lo]), int(ptr[hi])
                u = np.repeat(np.arange(lo, hi), np.diff(ptr[lo : hi + 1]))
                v, w = np.asarray(idx[a:b]), np.asarray(wts[a:b])
                keep = u < v
                yield pd.DataFrame({"u": u[keep], "v": v[keep].astype(np.int64), "w": w[keep].astype(np.int64)})

    edges = spark.range(0, n, chunk).mapInPandas(run, "u bigint, v bigint, w bigint")
    return Graph(edges, spark.range(n).withColumnRenamed("id", "u"))


def read_run_results(spark: SparkSession, planned: DataFrame, results: str, failures: str | None = None) -> DataFrame:
    """(job_id, status, pipeline_seconds, matched_macro_f1) of every planned job.

    A failure record overrides a result's status; jobs with neither are NOT_RUN.
    Results are JSON rows, plain or gzipped.
    """
    schema = "job_id string, status string, pipeline_seconds double, matched_macro_f1 double"
    r = spark.read.schema(schema).json(results).where("job_id IS NOT NULL")
    r = r.groupBy("job_id").agg(F.max(F.struct("status", "pipeline_seconds", "matched_macro_f1")).alias("r"))
    j = planned.select("job_id").distinct().join(r, "job_id", "left")
    status = F.col("r.status")
    if failures:
        f = spark.read.schema("job_id string, status string").json(failures).groupBy("job_id").agg(F.max("status").alias("failed"))
        j = j.join(f, "job_id", "left")
        status = F.coalesce("failed", "r.status")
    return j.select("job_id", F.coalesce(status, F.lit("NOT_RUN")).alias("status"), "r.pipeline_seconds", "r.matched_macro_f1")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, bytes, sha256, content) of every member of the zip files at ``path``; content is text."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, blob in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    rows = []
                    for i in z.infolist():
                        data = z.read(i)
                        rows.append((name, i.filename, len(data), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["archive", "member", "bytes", "sha256", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, bytes long, sha256 string, content string")


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """A table as JSON or CSV, once: an existing path is an error. Nested columns become JSON text in CSV."""
    if kind == "csv":
        nested = {c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
        df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns)).write.mode("errorifexists").option("header", True).csv(path)
    else:
        df.write.mode("errorifexists").json(path)


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Tables of unlike columns in one, absent ones null."""
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def write_proposal(spark: SparkSession, arrays: dict[int, np.ndarray], path: str) -> None:
    """Numeric matrices by round as rows (round, i, values array<double>)."""
    rows = [(k, i, [float(x) for x in r]) for k, a in arrays.items() for i, r in enumerate(np.atleast_2d(a))]
    spark.createDataFrame(rows, "round int, i int, values array<double>").write.mode("errorifexists").parquet(path)
