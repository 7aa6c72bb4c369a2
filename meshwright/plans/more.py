"""Queries of banks, margins, plans and scalar expressions, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import columns, diffuse
from meshwright.operators import bank, hyper, jobs, regions
from meshwright.operators.graph import brand_labels, g_geo, g_part, g_supp
from meshwright.plans.graphs import GEO, PART, brands
from meshwright.session import table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey AS u, CASE WHEN p_size > 10 THEN 1000000 + p_size ELSE p_partkey END AS g FROM part")
def partition_completion(spark, d):
    """Parts of size up to 10 belong to no group and become their own."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("u"), "p_size")
    return bank.completed(p.where("p_size > 10").select("u", (F.lit(1000000) + F.col("p_size")).alias("g")), p.select("u"))


@query("SELECT l_partkey AS u, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def partition_conflicts(spark, d):
    return bank.not_disjoint(table(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("g")))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS b, p_brand AS g FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT b, string_agg(g, ',' ORDER BY g) AS k, count(*) AS n FROM i GROUP BY b)
SELECT min(b) AS first_block, count(*) AS blocks, any_value(n) AS size, CASE WHEN any_value(n) = 1 THEN 'trivial' WHEN any_value(n) > 4 THEN 'capped' ELSE 'admissible' END AS kind FROM s GROUP BY k""")
def mapped_bank(spark, d):
    """Orders as blocks of parts, mapped onto brands."""
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_partkey").alias("u"))
    return bank.mapped(b, brand_labels(spark, d).withColumnRenamed("l", "g"), 4)


@query()
def mechanism_ranks(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_partkey").alias("u"))
    return bank.mechanism(b)


@query("""WITH a AS (SELECT case_id AS k, CASE WHEN seed <= 72 THEN 'exact' ELSE 'numeric' END AS arithmetic, min(CASE WHEN status = 'COMPLETED' AND isfinite(onmi) THEN onmi END) AS value FROM runs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY value IS NULL, arithmetic = 'numeric') AS i FROM a)
SELECT k AS case_id, CASE WHEN value IS NOT NULL THEN arithmetic END AS arithmetic, value, value IS NOT NULL AND arithmetic = 'exact' AS certifies FROM r WHERE i = 1""")
def exact_fallback(spark, d):
    r = table(spark, d, "runs")
    ok = (F.col("status") == "COMPLETED") & ~F.isnan("onmi") & (F.abs("onmi") < float("inf"))
    a = r.groupBy("case_id", F.when(F.col("seed") <= 72, "exact").otherwise("numeric").alias("arithmetic")).agg(F.min(F.when(ok, F.col("onmi"))).alias("value"))
    return bank.with_fallback(a, "case_id")


@query(f"{GEO} SELECT q AS query_id, CASE WHEN s IS NULL THEN 'null_seed' ELSE 'unknown_seed' END AS reason FROM (SELECT s_suppkey AS q, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN s_suppkey + 1000000000000 ELSE -s_suppkey END AS s FROM supplier) x WHERE s IS NULL OR s NOT IN (SELECT u FROM deg)")
def query_validation(spark, d):
    k = F.col("s_suppkey")
    q = table(spark, d, "supplier").select(k.alias("query_id"), F.when(k % 3 == 0, None).when(k % 3 == 1, k + 10**12).otherwise(-k).cast("bigint").alias("seed"))
    return bank.invalid_queries(g_geo(spark, d), q)


@query(f"""{PART}, s AS (SELECT p_brand AS set_id, p_partkey AS u FROM part), vol AS (SELECT set_id, count(*) AS n, sum(coalesce(d, 0)) AS v FROM s LEFT JOIN deg ON deg.u = s.u GROUP BY set_id),
i AS (SELECT a.set_id, sum(w) AS i FROM adj JOIN s a ON a.u = adj.u JOIN s b ON b.u = adj.v AND a.set_id = b.set_id GROUP BY a.set_id),
bs AS (SELECT vol.set_id, n, v, v - coalesce(i, 0) AS c FROM vol LEFT JOIN i ON i.set_id = vol.set_id),
nr AS (SELECT s.set_id, adj.v AS u, sum(w) AS w FROM s JOIN adj ON adj.u = s.u GROUP BY s.set_id, adj.v),
x AS (SELECT nr.set_id, 'add' AS operation, nr.u, v + d AS v, c + d - 2 * w AS c FROM nr JOIN deg ON deg.u = nr.u JOIN bs ON bs.set_id = nr.set_id WHERE (nr.set_id, nr.u) NOT IN (SELECT set_id, u FROM s)
 UNION ALL SELECT s.set_id, 'delete', s.u, v - d, c - d + 2 * coalesce(w, 0) FROM s JOIN deg ON deg.u = s.u JOIN bs ON bs.set_id = s.set_id LEFT JOIN nr ON nr.set_id = s.set_id AND nr.u = s.u WHERE n > 1)
SELECT set_id, operation, u, CAST(c * m + v * v AS BIGINT) AS z_num, CAST(m * v AS BIGINT) AS z_den FROM x, tot""")
def truth_margins(spark, d):
    """What adding or deleting one part would do to each brand's parts."""
    s = table(spark, d, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("u"))
    return bank.truth_margins(g_part(spark, d), s)


@query()
def pair_copies(spark, d):
    """The best mixture copy of each attractive pair of suppliers, by joins and a weighted median."""
    return bank.pair_margins(g_geo(spark, d))


@query(f"{GEO} SELECT u, CAST(j AS INT) AS j, 3.0::DOUBLE * d * pow(2, j) AS mass FROM deg, tot, generate_series(0, 60) s(j) WHERE 3.0 * d * pow(2, j) <= 0.5 * m")
def mass_grid(spark, d):
    g = g_geo(spark, d)
    return g.degrees.select("u", F.posexplode(columns.mass_grid(F.col("d"), g.volume)).alias("j", "mass"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey <> 0 THEN CAST(l_partkey // gcd(l_partkey, l_suppkey) AS BIGINT) END AS num, CASE WHEN l_suppkey <> 0 THEN CAST(l_suppkey // gcd(l_partkey, l_suppkey) AS BIGINT) END AS den FROM lineitem")
def reduced_fractions(spark, d):
    r = columns.reduced(F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.num", "r.den")


@query("""SELECT record_id, load_id, CASE WHEN pipeline_seconds IS NULL THEN 'null' WHEN isnan(pipeline_seconds) THEN '"nan"' WHEN isinf(pipeline_seconds) THEN '"inf"' ELSE 'number' END AS kind,
CASE WHEN isfinite(pipeline_seconds) AND isfinite(matched_macro_f1) AND matched_macro_f1 <> 0 THEN pipeline_seconds / matched_macro_f1 END AS ratio FROM runs""")
def nonfinite_json(spark, d):
    """How each time is written in JSON, and its null-safe ratio to the score."""
    j = columns.json_number(F.col("pipeline_seconds"))
    kind = F.when(j.rlike("^-?[0-9]"), "number").otherwise(j)
    return table(spark, d, "runs").select("record_id", "load_id", kind.alias("kind"), columns.safe_ratio(F.col("pipeline_seconds"), F.col("matched_macro_f1")).alias("ratio"))


@query("""SELECT case_id || '--' || method || '--s' || seed AS job_id, case_id AS graph_id, method, seed, CASE WHEN method = 'native' THEN 'external program' END AS blocked
FROM (SELECT DISTINCT case_id FROM cases), (VALUES ('components'), ('local_moves'), ('native')) m(method), (VALUES (71), (72)) s(seed)""")
def job_plan(spark, d):
    return jobs.plan(table(spark, d, "cases").select(F.col("case_id").alias("graph_id")), ["components", "local_moves", "native"], [71, 72], {"native": "external program"})


@query()
def method_covers(spark, d):
    """Suppliers of each nation grouped by a method called by name, through a table function."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("n"))
    e = g_supp(spark, d).edges.join(s, "u").join(s.select(F.col("u").alias("v"), F.col("n").alias("k")), "v").where("n = k")
    return jobs.grouped(spark, e.select(F.col("n").cast("string").alias("graph_id"), "u", "v", "w", F.lit("local_moves").alias("method"), F.lit(1).alias("seed")))


@query()
def candidate_forest(spark, d):
    """Bisection forests over the suppliers of each nation: (part, block, u)."""
    g = g_supp(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("part"), F.col("s_suppkey").alias("u")).join(g.degrees.select("u"), "u", "left_semi")
    return regions.forests(g, s)


@query()
def hyper_retrieval(spark, d):
    """Communities of the hypergraph of orders around one part of each brand, within the orders it is in and their parts."""
    inc = hyper.h_order(spark, d)
    seeds = brands(spark, d).groupBy("set_id").agg(F.min("u").alias("seed"))
    mine = seeds.join(inc.select("e", F.col("u").alias("seed")), "seed")
    deg = hyper.degrees(inc)
    rows = mine.join(inc, "e").join(deg, "u").select("set_id", "seed", "e", "u", "d")
    m = hyper.volume(inc)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        degree = {int(u): int(x) for u, x in zip(pdf["u"], pdf["d"])}
        edges = [(sorted(int(u) for u in set(g["u"])), 1) for _, g in pdf.groupby("e")]
        r = diffuse.hyper_retrieve(edges, degree, m, int(pdf["seed"].iloc[0]), masses=3)
        return pd.DataFrame([(pdf["set_id"].iloc[0], int(pdf["seed"].iloc[0]), len(r["vertices"]), r["z"], r["region"])], columns=["set_id", "seed", "size", "z", "region"])

    return rows.groupBy("set_id").applyInPandas(run, "set_id string, seed long, size int, z double, region int")


def queries():
    return Q


def oracle_sql():
    return SQL



