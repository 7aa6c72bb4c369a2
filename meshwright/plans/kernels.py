"""Queries that run kernels on regions, generators and streams; most are checked by tests instead of SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.functions.compose import MODES
from meshwright.functions.diffuse import VARIANTS
from meshwright.operators import metrics, pipelines, regions, reports
from meshwright.operators.graph import fingerprint, g_geo, g_pair, g_supp
from meshwright.plans.graphs import GEO, PAIR, brands
from meshwright.session import materialize, table
from meshwright.sources import generators
from meshwright.streaming import windows

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _supplier_queries(spark, d):
    """A search's queries: the suppliers whose id is divisible by 100 against the whole graph."""
    g = g_supp(spark, d)
    return g, g.degrees.where("u % 100 = 0").select(F.col("u").alias("query_id"), F.col("u").alias("seed"))


def _blocks(spark, d):
    """Suppliers of one nation and third of the id range."""
    s = table(spark, d, "supplier").select(F.concat_ws("/", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 3).cast("string")).alias("block_id"), F.col("s_suppkey").alias("u"))
    return s.join(g_supp(spark, d).degrees.select("u"), "u", "left_semi")


def _nation_queries(spark, d):
    g = g_geo(spark, d)
    return g, g.degrees.where("u >= 2000000000000 AND u < 3000000000000").select(F.col("u").alias("query_id"), F.col("u").alias("seed"))


@query()
def retrieve_seed(spark, d):
    """Communities around every nation of the geographic forest, with lower bounds."""
    return regions.retrieve(*_nation_queries(spark, d))


@query()
def retrieve_supp(spark, d):
    """Communities around the query suppliers in the supplier graph, which has cycles."""
    return regions.retrieve(*_supplier_queries(spark, d))


@query()
def retrieve_variants(spark, d):
    """Every named variant of the retrieval around each nation."""
    found = regions.retrieve(*_nation_queries(spark, d), variants=list(VARIANTS))
    return found.select("query_id", "variant", "status", "size", "z", "lower_bound")


@query()
def acl_local(spark, d):
    """Push with an exact queue around each nation."""
    g, q = _nation_queries(spark, d)
    return regions.local_push(g, q, 0.15, 1e-5, 3)


@query("SELECT n_nationkey + 2000000000000 AS query_id, true AS kept, true AS settled FROM nation")
def acl_local_check(spark, d):
    """Whether each push kept its mass and left no residual above its limit."""
    g, q = _nation_queries(spark, d)
    r = regions.local_push(g, q, 0.15, 1e-5, 3).join(g.degrees, "u")
    limit = F.col("residual") <= 1e-5 * F.col("d") + 1e-15
    return r.groupBy("query_id").agg((F.abs(F.sum(F.col("rank") + F.col("residual")) - 1) < 1e-9).alias("kept"), F.every(limit).alias("settled"))


def _checked(g, q):
    """Each retrieved set's quality recomputed by joins, its bound and its seed."""
    r = materialize(regions.retrieve(g, q), "found")
    s = metrics.set_stats(g, r.select(F.col("query_id").alias("set_id"), F.explode("vertices").alias("u")))
    z = (F.col("z_num") / F.col("z_den")).alias("z2")
    j = r.join(s.select(F.col("set_id").alias("query_id"), z), "query_id", "left")
    no = F.lit(False)
    return j.select("query_id", F.coalesce(F.abs(F.col("z") - F.col("z2")) < 1e-9, no).alias("same_z"), F.coalesce(F.col("lower_bound") <= F.col("z") + 1e-9, no).alias("bounded"), F.array_contains("vertices", F.col("seed")).alias("seeded"))


@query("SELECT n_nationkey + 2000000000000 AS query_id, true AS same_z, true AS bounded, true AS seeded FROM nation")
def retrieve_check(spark, d):
    return _checked(*_nation_queries(spark, d))


@query("SELECT DISTINCT l_suppkey AS query_id, true AS same_z, true AS bounded, true AS seeded FROM lineitem WHERE l_suppkey % 100 = 0")
def retrieve_supp_check(spark, d):
    """The same on the supplier graph."""
    return _checked(*_supplier_queries(spark, d))


@query()
def diffusion(spark, d):
    g, q = _nation_queries(spark, d)
    return regions.diffusions(g, q.withColumn("mass", F.lit(400.0)), 3)


_NATIONS = "SELECT n_nationkey + 2000000000000 AS query_id, {} FROM nation"


@query(_NATIONS.format("true AS optimal, true AS balanced"))
def diffusion_check(spark, d):
    """Optimality of the diffusions, recomputed by joins."""
    g, q = _nation_queries(spark, d)
    q = q.withColumn("mass", F.lit(400.0))
    r = regions.optimality(g, materialize(regions.diffusions(g, q, 3), "x"), q)
    return r.select("query_id", (F.col("breach") < 1e-6).alias("optimal"), (F.abs("mass_gap") < 1e-5).alias("balanced"))


@query(f"{GEO} SELECT adj.u AS query_id, round(deg.d + 1.0001 * deg.d * min(b.d / w), 6) AS mass FROM adj JOIN deg ON deg.u = adj.u JOIN deg b ON b.u = adj.v WHERE adj.u >= 2000000000000 AND adj.u < 3000000000000 GROUP BY adj.u, deg.d")
def activation_mass(spark, d):
    g, q = _nation_queries(spark, d)
    return regions.activation_masses(g, q).select("query_id", F.round("mass", 6).alias("mass"))


@query()
def mm_refine(spark, d):
    """Nations refined within three hops, by exact cuts."""
    g, q = _nation_queries(spark, d)
    members = regions.regions(g, q.select("query_id", F.col("seed").alias("u")), 2)
    return regions.refinements(g, members, q.select("query_id", F.col("seed").alias("u")), q)


@query()
def block_certificate(spark, d):
    """Blocks of suppliers under each named criterion."""
    return regions.block_panel(g_supp(spark, d), _blocks(spark, d))


def _pair_blocks(spark, d):
    """(block_id, u): customers in pairs of neighbouring ids."""
    c = g_pair(spark, d).degrees.where("u < 1000000000000").select(F.floor(F.col("u") / 2).alias("block_id"), "u")
    return c.join(c.groupBy("block_id").agg(F.count("*").alias("n")).where("n = 2"), "block_id", "left_semi")


@query(f"""{PAIR}, e2 AS (SELECT e.u, e.v, e.w, a.d AS du, b.d AS dv, m FROM e JOIN deg a ON a.u = e.u JOIN deg b ON b.u = e.v, tot WHERE e.w = 50),
o AS (SELECT e2.u, e2.v, x.v AS x, x.w AS a, 0 AS b FROM e2 JOIN adj x ON x.u = e2.u AND x.v <> e2.v UNION ALL SELECT e2.u, e2.v, x.v, 0, x.w FROM e2 JOIN adj x ON x.u = e2.v AND x.v <> e2.u),
n AS (SELECT o.u, o.v, x, sum(a) AS a, sum(b) AS b, any_value(d) AS d FROM o JOIN deg ON deg.u = x GROUP BY o.u, o.v, x),
k AS (SELECT n.u, n.v, sum(abs(dv * a - du * b)) AS s, sum(abs(m * (a - b) - (du - dv) * d)) AS near, sum(d) AS dn,
  sum(greatest(m * a - du * d, 0) + greatest(m * b - dv * d, 0)) AS pos, sum(least(greatest(m * a - du * d, 0), greatest(m * b - dv * d, 0))) AS shared FROM n JOIN e2 ON e2.u = n.u AND e2.v = n.v GROUP BY n.u, n.v),
g AS (SELECT e2.u // 2 AS block_id, m * w * (du + dv) - m * s - (du + dv) * du * dv AS deg, 2 * (m * w - du * dv) - near - abs(du - dv) * (m - du - dv - dn) AS uni, m * w - du * dv - pos AS clique, m * w - du * dv AS c, m * w - du * dv + shared - pos AS clo
  FROM k JOIN e2 ON e2.u = k.u AND e2.v = k.v),
r AS (SELECT block_id, 'degree_copy' AS method, CASE WHEN deg > 0 THEN 'verified_positive_definite' WHEN deg = 0 THEN 'verified_positive_semidefinite' ELSE 'failed_exact_psd' END AS status FROM g
  UNION ALL SELECT block_id, 'full_pairs', CASE WHEN deg > 0 THEN 'verified_positive_definite' WHEN deg = 0 THEN 'verified_positive_semidefinite' ELSE 'failed_exact_psd' END FROM g
  UNION ALL SELECT block_id, 'uniform_copy', CASE WHEN uni > 0 THEN 'verified_positive_definite' WHEN uni = 0 THEN 'verified_positive_semidefinite' ELSE 'failed_exact_psd' END FROM g
  UNION ALL SELECT block_id, 'almost_clique', CASE WHEN clique > 0 THEN 'verified_strict' ELSE 'failed_upper_bound' END FROM g
  UNION ALL SELECT block_id, 'positive_closure', CASE WHEN c < 0 THEN 'negative_inner_affinity' WHEN clo > 0 THEN 'verified_all_pairs' ELSE 'failed_pair_condition' END FROM g)
SELECT CAST(block_id AS BIGINT) AS block_id, CAST(2 AS INT) AS size, method, status FROM r""")
def pair_certificates(spark, d):
    """Pairs of customers under five criteria, which for two members have closed forms."""
    return regions.block_panel(g_pair(spark, d), _pair_blocks(spark, d), ["degree_copy", "full_pairs", "uniform_copy", "almost_clique", "positive_closure"])


@query()
def weighted_copies(spark, d):
    """Blocks of suppliers under copies around other centres and over all pairs of members."""
    return regions.block_panel(g_supp(spark, d), _blocks(spark, d), ["zero_copy", "anchor_copy", "full_pairs"])


@query()
def sequential_composition(spark, d):
    """Suppliers of one nation and third of the id range, composed as small graphs of their own, in each mode."""
    g, b = g_supp(spark, d), _blocks(spark, d)
    parts = b.select(F.col("block_id").alias("part"), "u")
    bank = parts.select("part", (F.col("u") % 6).alias("block_id"), "u")
    out = [regions.compositions(g, parts, bank, mode).select(F.lit(mode).alias("mode"), "part", "u", "g") for mode in MODES]
    return reduce(DataFrame.unionByName, out)


@query()
def pipeline_arms(spark, d):
    """What each contraction pipeline removes from the graph of paired customers, given blocks of two and of four."""
    g = g_pair(spark, d)
    two = _pair_blocks(spark, d)
    four = two.select((-F.floor(F.col("u") / 4) - 1).alias("block_id"), "u")
    labels = table(spark, d, "customer").select(F.col("c_custkey").alias("u"), F.col("c_nationkey").alias("l"))
    return pipelines.arm_summary(g, two.unionByName(four), labels)


def _suite(spark, d):
    """Orders as nested cases; every hundredth one stores a total that is wrong."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")))).alias("blocks"), F.sum("l_quantity").alias("q"))
    stored = F.col("q") + F.when(F.col("l_orderkey") % 100 == 0, 1.0).otherwise(0.0)
    return lines.select(F.col("l_orderkey").alias("case_id"), F.to_json(F.struct("blocks", stored.alias("total"))).alias("payload"))


@query("SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) - 1 AS place, l_quantity AS quantity, l_extendedprice AS price FROM lineitem")
def suite_blocks(spark, d):
    """The flat table of one list of nested cases."""
    return reports.suite_table(_suite(spark, d), "blocks", "quantity:double,price:double").select("case_id", F.col("place").cast("bigint").alias("place"), "quantity", "price")


@query("SELECT l_orderkey AS case_id, sum(l_quantity) + 1 AS stored, sum(l_quantity) AS derived FROM lineitem WHERE l_orderkey % 100 = 0 GROUP BY l_orderkey")
def suite_differences(spark, d):
    """Cases whose stored total isn't the sum over their flat rows."""
    cases = _suite(spark, d)
    return reports.suite_mismatches(cases, reports.suite_table(cases, "blocks", "quantity:double"), "total", F.sum("quantity"))


@query()
def leaf_certificate(spark, d):
    """Each nation with one customer, a block every criterion can accept."""
    g = g_geo(spark, d)
    n = g.edges.where("u < 1000000000000").groupBy("v").agg(F.min("u").alias("u"))
    b = n.select(F.col("v").alias("block_id"), F.explode(F.array("u", "v")).alias("u"))
    return regions.block_panel(g, b)


@query()
def enumerate_partitions(spark, d):
    """Whether keeping each small block whole is optimal among all partitions of it and its surroundings."""
    g = g_geo(spark, d)
    n = g.edges.where("v >= 3000000000000")
    return regions.optima(g, n.select(F.col("u").alias("block_id"), F.explode(F.array("u", "v")).alias("u")))


@query()
def local_moves(spark, d):
    """Local-move partitions of the suppliers of each nation."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("part"), F.col("s_suppkey").alias("u")).join(g_supp(spark, d).degrees.select("u"), "u", "left_semi")
    return regions.groupings(g_supp(spark, d), s)


@query()
def bootstrap_ci(spark, d):
    """Mean score of each method with intervals from resampling cases, then runs."""
    r = reports.one_per_record(table(spark, d, "runs")).where(reports.sound()).groupBy("method", "case_id").agg(F.avg("matched_macro_f1").alias("f"), F.avg("onmi").alias("o"))
    return regions.bootstrap(r, "method", "case_id", "f", 500)


@query("""WITH m AS (SELECT o_custkey AS query_id, CAST(o_totalprice AS DOUBLE) AS mass, o_orderkey % 5 AS u FROM orders), o AS (SELECT query_id, mass, lead(mass) OVER (PARTITION BY query_id ORDER BY mass) AS nx FROM (SELECT DISTINCT query_id, mass FROM m))
SELECT m.query_id, m.mass, m.u FROM m JOIN o ON o.query_id = m.query_id AND o.mass = m.mass WHERE nx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m n WHERE n.query_id = m.query_id AND n.mass = o.nx AND n.u = m.u)""")
def support_nesting(spark, d):
    """Supports that aren't nested in mass order (orders of a customer as supports)."""
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_totalprice").alias("mass"), (F.col("o_orderkey") % 5).alias("u"), F.lit(1.0).alias("x"))
    order = h.select("query_id", "mass").distinct().withColumn("next_mass", F.lead("mass").over(Window.partitionBy("query_id").orderBy("mass")))
    return regions.unnested_supports(h, order)


@query("""SELECT 'matching_cliques' AS family, 40 AS n, 400 AS m, 800 AS volume UNION ALL SELECT 'common_hub', 41, 420, 840 UNION ALL SELECT 'hub_cliques', 13, 30, 60
UNION ALL SELECT 'private_leaves', 30, 65, 130 UNION ALL SELECT 'clique_ring', 100, 145, 290 UNION ALL SELECT 'circulant', 64, 128, 256 UNION ALL SELECT 'families', 15, 20, 40""")
def generated_families(spark, d):
    """Sizes of the closed-form families against their formulas."""
    made = {
        "matching_cliques": generators.matching_cliques(spark, 20), "common_hub": generators.common_hub(spark, 20), "hub_cliques": generators.hub_cliques(spark, 3, 5),
        "private_leaves": generators.private_leaves(spark, 10, 2), "clique_ring": generators.clique_ring(spark, 10, 100), "circulant": generators.circulant(spark, 64, [1, 2]), "families": generators.families(spark),
    }
    out = None
    for name, g in made.items():
        n = g.adj.agg(F.count_distinct("u").alias("n"), (F.count("*") / 2).cast("bigint").alias("m"), F.sum("w").alias("volume")).select(F.lit(name).alias("family"), "n", "m", "volume")
        out = n if out is None else out.unionByName(n)
    return out


@query()
def generated_random(spark, d):
    """Sizes and digests of the seeded random families: the same in every run."""
    planted, _ = generators.planted(spark, 400, 4, 0.2, 0.02, 7, True)
    over, _ = generators.overlapping_planted(spark, 200, 5, 0.3, 0.3, 0.02, 7)
    made = {"planted": planted, "noisy": generators.noisy(planted, 400, 0.1, 50, 3), "overlapping": over, "expected_degrees": generators.expected_degrees(spark, [float(1 + i % 9) for i in range(300)], 5)}
    out = None
    for name, g in made.items():
        f = fingerprint(g.edges).select(F.lit(name).alias("family"), "edges", "weight", "digest")
        out = f if out is None else out.unionByName(f)
    return out


@query()
def seed_sample(spark, d):
    """Two seeds in each of five brands: a sampling operator."""
    from meshwright.functions.grouping import query_sample

    b = brands(spark, d).groupBy("set_id").agg(F.min("u").alias("a"), F.max("u").alias("b")).orderBy("set_id").collect()
    picked = query_sample([[r["a"], r["b"]] for r in b], 5, 2, 11)
    return spark.createDataFrame([(i, b[c]["set_id"], u) for i, (c, u) in enumerate(picked)], "query_id int, set_id string, seed long")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = windows.tumbling(table(spark, d, "events"))
    return w.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"))


@query(f"{GEO} SELECT u AS query_id, 1 AS size, d AS vol FROM deg WHERE u >= 2000000000000 AND u < 3000000000000")
def seed_stats(spark, d):
    """Size and volume of the single seeds, the start of every retrieval."""
    g, q = _nation_queries(spark, d)
    return metrics.set_stats(g, q.select(F.col("query_id").alias("set_id"), F.col("seed").alias("u"))).select(F.col("set_id").alias("query_id"), "size", "vol")


def queries():
    return Q


def oracle_sql():
    return SQL
