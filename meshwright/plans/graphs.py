"""Queries of graph, hypergraph and cover operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import cover, criteria, hyper, iterative, metrics, ordered
from meshwright.operators.graph import asymmetries, brand_labels, fingerprint, g_geo, g_pair, g_part, g_supp, rejects
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


_E = """e AS (SELECT a.i AS u, b.i AS v, CAST(count(*) AS BIGINT) AS w FROM op a JOIN op b ON a.o = b.o AND a.i < b.i GROUP BY a.i, b.i)"""
_REST = """adj AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e),
deg AS (SELECT u, CAST(sum(w) AS BIGINT) AS d FROM adj GROUP BY u),
tot AS (SELECT CAST(sum(d) AS BIGINT) AS m FROM deg)"""
PART = f"WITH RECURSIVE op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS i FROM lineitem), {_E}, {_REST}, lab AS (SELECT p_partkey AS u, p_brand AS l FROM part)"
SUPP = f"WITH RECURSIVE op AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS i FROM lineitem), {_E}, {_REST}"
GEO = f"""WITH RECURSIVE e AS (
  SELECT c_custkey AS u, 2000000000000 + c_nationkey AS v, CAST(1 AS BIGINT) AS w FROM customer
  UNION ALL SELECT 1000000000000 + s_suppkey, 2000000000000 + s_nationkey, 1 FROM supplier
  UNION ALL SELECT 2000000000000 + n_nationkey, 3000000000000 + n_regionkey, 1 FROM nation), {_REST}"""
PAIR = f"""WITH RECURSIVE e AS (
  SELECT c_custkey AS u, 2000000000000 + c_nationkey AS v, CAST(1 AS BIGINT) AS w FROM customer
  UNION ALL SELECT a.c_custkey, b.c_custkey, 50 FROM customer a JOIN customer b ON a.c_custkey % 2 = 0 AND b.c_custkey = a.c_custkey + 1), {_REST}"""
HYPER = """WITH op AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS u FROM lineitem),
rk AS (SELECT e, CAST(count(*) AS BIGINT) AS r FROM op GROUP BY e HAVING count(*) > 1),
inc AS (SELECT op.e, op.u, rk.r FROM op JOIN rk ON op.e = rk.e),
deg AS (SELECT u, CAST(count(*) AS BIGINT) AS d FROM inc GROUP BY u)"""


def brands(spark: SparkSession, d: str) -> DataFrame:
    """(set_id, u): the parts of each brand."""
    return brand_labels(spark, d).withColumnRenamed("l", "set_id").where("set_id IS NOT NULL")


# --- graphs and metrics -----------------------------------------------------------------------


@query(f"{PART} SELECT u, d FROM deg")
def graph_degree(spark, d):
    return g_part(spark, d).degrees


@query(f"{PART} SELECT (SELECT count(*) FROM deg) AS vertices, (SELECT count(*) FROM e) AS edges, m AS volume FROM tot")
def graph_volume(spark, d):
    g = g_part(spark, d)
    n = g.degrees.agg(F.count("*").alias("vertices"))
    return n.join(g.edges.agg(F.count("*").alias("edges"), (2 * F.sum("w")).alias("volume")), F.lit(True))


@query(f"{PART} (SELECT u, v, w FROM adj) EXCEPT ALL (SELECT v, u, w FROM adj)")
def graph_symmetry_violations(spark, d):
    return asymmetries(g_part(spark, d).adj)


_RAW = "r AS (SELECT l_suppkey AS u, l_partkey AS v, CAST(l_linenumber - 1 AS BIGINT) AS w FROM lineitem)"


def _raw(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), (F.col("l_linenumber") - 1).cast("bigint").alias("w"))


@query(f"""WITH {_RAW}, x AS (
  SELECT 'loop' AS reason, count(*) AS n FROM r WHERE u = v
  UNION ALL SELECT 'reversed', count(*) FROM r WHERE u > v
  UNION ALL SELECT 'weight', count(*) FROM r WHERE w <= 0
  UNION ALL SELECT 'null', count(*) FROM r WHERE u IS NULL OR v IS NULL OR w IS NULL
  UNION ALL SELECT 'duplicate', CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM r GROUP BY u, v HAVING count(*) > 1)
  UNION ALL SELECT 'unknown_vertex', count(*) FROM (SELECT u FROM r UNION ALL SELECT v FROM r) WHERE u NOT IN (SELECT p_partkey FROM part))
  SELECT * FROM x WHERE n > 0""")
def graph_rejects(spark, d):
    """What a scan of raw supplier-part rows as edges would leave out."""
    return rejects(_raw(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("u")))


@query(f"WITH {_RAW} SELECT least(u, v) AS u, greatest(u, v) AS v, CAST(sum(w) AS BIGINT) AS w FROM r WHERE u <> v AND w > 0 GROUP BY least(u, v), greatest(u, v)")
def graph_from_rows(spark, d):
    """Parallel raw rows summed into simple edges."""
    from meshwright.operators.graph import Graph

    return Graph.from_rows(_raw(spark, d)).edges


@query()
def graph_fingerprint(spark, d):
    return fingerprint(g_part(spark, d).edges)


@query(f"""{PART}, s AS (SELECT l AS set_id, lab.u, coalesce(d, 0) AS d FROM lab LEFT JOIN deg ON lab.u = deg.u),
v AS (SELECT set_id, count(*) AS size, CAST(sum(d) AS BIGINT) AS vol FROM s GROUP BY set_id),
i AS (SELECT a.l AS set_id, CAST(sum(w) AS BIGINT) AS inn FROM adj JOIN lab a ON a.u = adj.u JOIN lab b ON b.u = adj.v AND a.l = b.l GROUP BY a.l)
SELECT v.set_id, size, vol, vol - coalesce(inn, 0) AS cut,
  CAST((vol - coalesce(inn, 0)) * m + vol * vol AS BIGINT) AS z_num, CAST(m * vol AS BIGINT) AS z_den
FROM v LEFT JOIN i ON v.set_id = i.set_id, tot""")
def set_stats(spark, d):
    return metrics.set_stats(g_part(spark, d), brands(spark, d))


_SETS = f"""{PART}, v AS (SELECT l AS set_id, CAST(sum(d) AS BIGINT) AS vol FROM lab JOIN deg ON lab.u = deg.u GROUP BY l),
i AS (SELECT a.l AS set_id, CAST(sum(w) AS BIGINT) AS inn FROM adj JOIN lab a ON a.u = adj.u JOIN lab b ON b.u = adj.v AND a.l = b.l GROUP BY a.l),
c AS (SELECT v.set_id, vol, vol - coalesce(inn, 0) AS cut, CASE WHEN least(vol, m - vol) > 0 THEN least(vol, m - vol) END AS den FROM v LEFT JOIN i ON v.set_id = i.set_id, tot)"""


@query(f"{_SETS} SELECT set_id, cut, den FROM c")
def set_conductance(spark, d):
    g = g_part(spark, d)
    return metrics.conductance(g, metrics.set_stats(g, brands(spark, d)))


@query(f"""{_SETS} SELECT phi_bin, count(*) AS n FROM (
  SELECT CASE WHEN cut / den < 0.05 THEN NULL WHEN cut / den < 0.15 THEN '0.1' WHEN cut / den < 0.25 THEN '0.2' WHEN cut / den < 0.35 THEN '0.3'
    WHEN cut / den < 0.45 THEN '0.4' WHEN cut / den < 0.55 THEN '0.5' WHEN cut / den < 0.65 THEN '0.6' END AS phi_bin FROM c) GROUP BY phi_bin""")
def conductance_bins(spark, d):
    g = g_part(spark, d)
    c = metrics.conductance(g, metrics.set_stats(g, brands(spark, d)))
    return c.groupBy(metrics.phi_bin(F.col("cut") / F.col("den")).alias("phi_bin")).agg(F.count("*").alias("n"))


@query(f"""{_SETS} SELECT count(*) AS groups, round(sum(cut / den * vol) / sum(vol) FILTER (WHERE den IS NOT NULL), 9) AS phi_mean,
  round(quantile_cont(cut / den, 0.25), 9) AS phi_q25, round(quantile_cont(cut / den, 0.5), 9) AS phi_q50, round(quantile_cont(cut / den, 0.75), 9) AS phi_q75,
  round(sum(cut) / any_value(m), 9) AS outside FROM c, tot""")
def partition_stats(spark, d):
    p = metrics.partition_stats(g_part(spark, d), brand_labels(spark, d))
    return p.select("groups", *(F.round(c, 9).alias(c) for c in p.columns[1:]))


_MOD = f"""{PART}, vc AS (SELECT l, sum(d) AS v FROM lab JOIN deg ON lab.u = deg.u GROUP BY l), v2 AS (SELECT CAST(sum(v * v) AS BIGINT) AS vol2 FROM vc),
wi AS (SELECT CAST(2 * sum(w) AS BIGINT) AS within FROM e JOIN lab a ON a.u = e.u JOIN lab b ON b.u = e.v AND a.l = b.l)"""


@query(f"{_MOD} SELECT p, q, within, vol2, CAST(q * m * within - p * vol2 AS BIGINT) AS num, CAST(q * m * m AS BIGINT) AS den FROM v2, wi, tot, (VALUES (1::BIGINT, 2::BIGINT), (1, 1), (2, 1)) g(p, q)")
def modularity_by_gamma(spark, d):
    return metrics.modularity(g_part(spark, d), brand_labels(spark, d), [(1, 2), (1, 1), (2, 1)])


@query(f"{PART} SELECT a.l AS gu, b.l AS gv, CAST(sum(w) AS BIGINT) AS w FROM adj JOIN lab a ON a.u = adj.u JOIN lab b ON b.u = adj.v GROUP BY a.l, b.l")
def quotient_edges(spark, d):
    return metrics.quotient(g_part(spark, d), brand_labels(spark, d))


@query("SELECT '' AS g, CAST(0 AS BIGINT) AS d_quotient, CAST(0 AS BIGINT) AS d_direct WHERE false")
def quotient_validate(spark, d):
    """Groups whose degree is not kept by contraction: none."""
    g, lab = g_part(spark, d), brand_labels(spark, d)
    return metrics.quotient_mismatches(g, lab, metrics.quotient(g, lab))


@query("SELECT p_partkey AS u, substr(p_brand, 1, 7) AS l FROM part")
def lift_labels(spark, d):
    """Makers of brands carried to the parts."""
    first = brand_labels(spark, d).withColumnRenamed("l", "g")
    second = first.select("g").distinct().select("g", F.substring("g", 1, 7).alias("l"))
    return metrics.lift(first, second)


@query("SELECT CAST(sum(n) AS BIGINT) AS vertices, count(*) AS groups, count(*) FILTER (WHERE n > 1) AS merged_groups, CAST(sum(n - 1) AS BIGINT) AS removed FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)")
def coverage_summary(spark, d):
    return metrics.reduction(brand_labels(spark, d).withColumnRenamed("l", "g"))


@query("SELECT p_brand AS g, count(DISTINCT p_type) AS labels FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def crossing_groups(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("u"), F.col("p_type").alias("l"))
    return metrics.crossing(brand_labels(spark, d).withColumnRenamed("l", "g"), t)


@query(f"{PART} SELECT e.u, e.v, e.w, a.d AS du, b.d AS dv, CAST(m * w - a.d * b.d AS BIGINT) AS c FROM e JOIN deg a ON a.u = e.u JOIN deg b ON b.u = e.v, tot")
def affinity_edges(spark, d):
    return g_part(spark, d).affinities(1, 1)


_TRUTH = "t AS (SELECT p_brand AS set_id, p_partkey AS u FROM part), p AS (SELECT p_brand AS set_id, p_partkey AS u FROM part WHERE p_size <= 25 UNION SELECT p_brand, p_partkey + 1 FROM part WHERE p_size = 30)"


def _predicted(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size <= 25").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("u"))
    return a.unionByName(p.where("p_size = 30").select(F.col("p_brand").alias("set_id"), (F.col("p_partkey") + 1).alias("u")))


@query(f"""WITH {_TRUTH}, j AS (SELECT coalesce(t.set_id, p.set_id) AS set_id, t.u AS a, p.u AS b FROM t FULL OUTER JOIN p ON t.set_id = p.set_id AND t.u = p.u)
SELECT set_id, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS tp, count(b) AS predicted, count(a) AS actual,
  count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS apart, count(*) FILTER (WHERE a IS NULL OR b IS NULL) = 0 AS exact FROM j GROUP BY set_id""")
def seeded_f1(spark, d):
    return metrics.set_scores(_predicted(spark, d), brands(spark, d))


@query(f"""WITH {_TRUTH}, r AS (SELECT p_brand AS set_id, p_partkey AS u FROM part WHERE p_brand < 'Brand#3' OR p_size < 40),
x AS (SELECT set_id, u FROM t EXCEPT SELECT set_id, u FROM p), y AS (SELECT set_id, u FROM p EXCEPT SELECT set_id, u FROM t),
l AS (SELECT set_id, u FROM t EXCEPT SELECT set_id, u FROM r)
SELECT s.set_id, CASE WHEN s.set_id NOT IN (SELECT set_id FROM x) AND s.set_id NOT IN (SELECT set_id FROM y) THEN NULL
  WHEN s.set_id NOT IN (SELECT set_id FROM l) THEN 'H2' ELSE 'H1' END AS failure_class FROM (SELECT DISTINCT set_id FROM t UNION SELECT set_id FROM p) s""")
def failure_class(spark, d):
    region = table(spark, d, "part").where("p_brand < 'Brand#3' OR p_size < 40").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("u"))
    return metrics.failure_class(_predicted(spark, d), brands(spark, d), region)


# --- edge and block criteria ------------------------------------------------------------------


def _dominance_sql(base: str, p: int = 1, q: int = 1) -> str:
    return f"""{base}, x AS (SELECT adj.u, adj.v, w, a.d AS du, b.d AS dv, CAST({q} * m * w - {p} * a.d * b.d AS BIGINT) AS c FROM adj JOIN deg a ON a.u = adj.u JOIN deg b ON b.u = adj.v, tot),
t AS (SELECT x.u, CAST({p} * any_value(du) * (any_value(m) - any_value(du)) + sum(abs(c) - {p} * du * dv) AS BIGINT) AS t FROM x, tot GROUP BY x.u),
mg AS (SELECT x.u, x.v, c, 2 * c - a.t AS mu, 2 * c - b.t AS mv FROM x JOIN t a ON a.u = x.u JOIN t b ON b.u = x.v WHERE x.u < x.v)"""


_DOM = " SELECT u, v, CAST(greatest(mu, mv) AS BIGINT) AS margin, CASE WHEN mu >= mv THEN u ELSE v END AS witness FROM mg WHERE c > 0 AND greatest(mu, mv) > 0"


@query(_dominance_sql(GEO) + _DOM)
def singleton_dominance(spark, d):
    return criteria.singleton_dominance(g_geo(spark, d))


@query(_dominance_sql(PART) + _DOM)
def singleton_dominance_parts(spark, d):
    return criteria.singleton_dominance(g_part(spark, d))


@query(
    _dominance_sql(GEO, 1, 2).replace(" x AS", " x1 AS").replace("FROM x,", "FROM x1,").replace("FROM x ", "FROM x1 ").replace("x.", "x1.").replace(" t AS (", " t1 AS (", 1).replace("JOIN t ", "JOIN t1 ").replace("\nt AS", "\nt1 AS").replace("mg AS", "m1 AS")
    + ", "
    + _dominance_sql(GEO)[len(GEO) + 2 :]
    + """ SELECT u, v, CASE WHEN a THEN u ELSE v END AS witness, CAST(CASE WHEN a THEN lu ELSE lv END AS BIGINT) AS margin_low, CAST(CASE WHEN a THEN hu ELSE hv END AS BIGINT) AS margin_high
FROM (SELECT m1.u, m1.v, m1.mu AS lu, m1.mv AS lv, mg.mu AS hu, mg.mv AS hv, least(m1.mu, mg.mu) > 0 AS a, least(m1.mv, mg.mv) > 0 AS b FROM m1 JOIN mg ON m1.u = mg.u AND m1.v = mg.v WHERE mg.c > 0) WHERE a OR b"""
)
def singleton_interval(spark, d):
    return criteria.singleton_interval(g_geo(spark, d), (1, 2), (1, 1))


def _closure_sql(base: str) -> str:
    return f"""{base}, x AS (SELECT adj.u, adj.v, CAST(m * w - a.d * b.d AS BIGINT) AS c FROM adj JOIN deg a ON a.u = adj.u JOIN deg b ON b.u = adj.v, tot),
p AS (SELECT * FROM x WHERE c > 0), ps AS (SELECT u, sum(c) AS s FROM p GROUP BY u),
wd AS (SELECT a.u, b.u AS v, sum(least(a.c, b.c)) AS r FROM p a JOIN p b ON a.v = b.v AND a.u < b.u GROUP BY a.u, b.u)
SELECT p.u, p.v, CAST(3 * c - a.s - b.s + coalesce(r, 0) AS BIGINT) AS margin, CAST(coalesce(r, 0) AS BIGINT) AS repaid
FROM p JOIN ps a ON a.u = p.u JOIN ps b ON b.u = p.v LEFT JOIN wd ON wd.u = p.u AND wd.v = p.v WHERE p.u < p.v AND 3 * c - a.s - b.s + coalesce(r, 0) > 0"""


@query(_closure_sql(PAIR))
def positive_closure(spark, d):
    return criteria.positive_closure(g_pair(spark, d))


@query(_closure_sql(PART))
def positive_closure_parts(spark, d):
    return criteria.positive_closure(g_part(spark, d))


@query(f"""{PAIR}, k AS (SELECT u, count(*) AS k FROM adj GROUP BY u),
s AS (SELECT e.u, e.v, count(*) AS n FROM e JOIN adj a ON a.u = e.u JOIN adj b ON b.u = e.v AND a.v = b.v JOIN deg x ON x.u = e.u JOIN deg y ON y.u = e.v WHERE y.d * a.w = x.d * b.w GROUP BY e.u, e.v)
SELECT e.u, e.v, CAST(m * e.w - x.d * y.d AS BIGINT) AS c FROM e JOIN deg x ON x.u = e.u JOIN deg y ON y.u = e.v JOIN k a ON a.u = e.u JOIN k b ON b.u = e.v LEFT JOIN s ON s.u = e.u AND s.v = e.v, tot
WHERE a.k = b.k AND coalesce(n, 0) = a.k - 1 AND m * e.w - x.d * y.d >= 0""")
def prop_twins(spark, d):
    return criteria.proportional_twins(g_pair(spark, d))


@query(f"""{PART}, c AS (SELECT e.u, e.v, a.v AS x, a.w AS wa, 0 AS wb FROM e JOIN adj a ON a.u = e.u AND a.v <> e.v UNION ALL SELECT e.u, e.v, b.v, 0, b.w FROM e JOIN adj b ON b.u = e.v AND b.v <> e.u),
s AS (SELECT u, v, x, sum(wa) AS wa, sum(wb) AS wb FROM c GROUP BY u, v, x), p AS (SELECT s.u, s.v, sum(abs(y.d * wa - z.d * wb)) AS num FROM s JOIN deg z ON z.u = s.u JOIN deg y ON y.u = s.v GROUP BY s.u, s.v)
SELECT e.u, e.v, CAST(coalesce(num, 0) AS BIGINT) AS num, z.d + y.d AS den FROM e JOIN deg z ON z.u = e.u JOIN deg y ON y.u = e.v LEFT JOIN p ON p.u = e.u AND p.v = e.v""")
def profile_penalties(spark, d):
    """Distance from proportional neighbourhoods of every edge's ends."""
    g = g_part(spark, d)
    return criteria.profile_penalty(g, g.edges)


@query(f"""{PART}, b AS (SELECT p_brand || '/' || (p_size % 4) AS block_id, p_partkey AS u, d FROM part JOIN deg ON deg.u = p_partkey),
k AS (SELECT block_id, count(*) AS k FROM b GROUP BY block_id),
r AS (SELECT b.block_id, b.u, adj.v AS x, w / b.d AS r FROM b JOIN adj ON adj.u = b.u LEFT JOIN b i ON i.block_id = b.block_id AND i.u = adj.v WHERE i.u IS NULL),
n AS (SELECT block_id, x, list_sort(list(r)) AS l, count(*) AS n FROM r GROUP BY block_id, x),
c AS (SELECT n.block_id, x, CASE WHEN 2 * n < k THEN 0 WHEN k % 2 = 1 THEN CASE WHEN k // 2 < k - n THEN 0 ELSE l[k // 2 - (k - n) + 1] END
  ELSE (CASE WHEN k // 2 - 1 < k - n THEN 0 ELSE l[k // 2 - 1 - (k - n) + 1] END + CASE WHEN k // 2 < k - n THEN 0 ELSE l[k // 2 - (k - n) + 1] END) / 2 END AS c FROM n JOIN k ON n.block_id = k.block_id),
cs AS (SELECT block_id, sum(c) AS cs FROM c GROUP BY block_id),
q AS (SELECT r.block_id, r.u, sum(r) AS rs, sum(least(r, coalesce(c, 0))) AS s FROM r LEFT JOIN c ON c.block_id = r.block_id AND c.x = r.x GROUP BY r.block_id, r.u),
z AS (SELECT b.block_id, b.u, d, coalesce(rs, 0) + coalesce(cs, 0) - 2 * coalesce(s, 0) AS delta FROM b LEFT JOIN q ON q.block_id = b.block_id AND q.u = b.u LEFT JOIN cs ON cs.block_id = b.block_id)
SELECT block_id, u, round(delta, 8) AS delta, round(sum(d * delta) OVER w / sum(d) OVER w, 8) AS mean FROM z WINDOW w AS (PARTITION BY block_id)""")
def exterior_median(spark, d):
    b = table(spark, d, "part").select(F.concat_ws("/", "p_brand", (F.col("p_size") % 4).cast("string")).alias("block_id"), F.col("p_partkey").alias("u"))
    x = criteria.exterior_deviation(g_part(spark, d), b)
    return x.select("block_id", "u", F.round("delta", 8).alias("delta"), F.round("mean", 8).alias("mean"))


# --- sweeps and orders ------------------------------------------------------------------------

_SCORE = "sc AS (SELECT 1 AS query_id, p_partkey AS u, CAST(p_size AS DOUBLE) AS x FROM part WHERE p_size > 0 UNION ALL SELECT 2, p_partkey, CAST((p_partkey * 7919) % 1000 AS DOUBLE) FROM part WHERE (p_partkey * 7919) % 1000 > 0)"
_STEPS = f"""{_SCORE}, sd AS (SELECT sc.*, deg.d FROM sc JOIN deg ON deg.u = sc.u),
ed AS (SELECT a.query_id, least(a.x, b.x) AS x, sum(w) AS w FROM e JOIN sc a ON a.u = e.u JOIN sc b ON b.u = e.v AND a.query_id = b.query_id GROUP BY a.query_id, least(a.x, b.x)),
lv AS (SELECT sd.query_id, sd.x, count(*) AS n, sum(d) AS d FROM sd GROUP BY sd.query_id, sd.x),
st AS (SELECT lv.query_id, lv.x, CAST(sum(n) OVER q AS BIGINT) AS size, CAST(sum(d) OVER q AS BIGINT) AS vol, CAST(sum(d) OVER q - 2 * sum(coalesce(ed.w, 0)) OVER q AS BIGINT) AS cut
  FROM lv LEFT JOIN ed ON ed.query_id = lv.query_id AND ed.x = lv.x WINDOW q AS (PARTITION BY lv.query_id ORDER BY lv.x DESC))"""


def _scores(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("u"), "p_size")
    one = p.select(F.lit(1).alias("query_id"), "u", F.col("p_size").cast("double").alias("x"))
    two = p.select(F.lit(2).alias("query_id"), "u", ((F.col("u") * 7919) % 1000).cast("double").alias("x"))
    return one.unionByName(two).where("x > 0")


@query(f"{PART}, {_STEPS} SELECT query_id, x, size, vol, cut FROM st")
def sweep_steps(spark, d):
    return ordered.sweep_steps(g_part(spark, d), _scores(spark, d))


def _seeds(spark):
    return spark.createDataFrame([(1, 5), (2, 7)], "query_id int, seed bigint")


_SEEDED = "sq AS (SELECT * FROM (VALUES (1, 5), (2, 7)) s(query_id, seed))"


@query(f"""{PART}, {_STEPS}, {_SEEDED}, ok AS (SELECT st.*, CAST(cut * m + vol * vol AS HUGEINT) AS zn, CAST(m * vol AS HUGEINT) AS zd FROM st JOIN sq ON sq.query_id = st.query_id JOIN sc ON sc.query_id = sq.query_id AND sc.u = sq.seed, tot WHERE st.x <= sc.x AND vol > 0)
SELECT query_id, size, vol, cut, CAST(zn AS BIGINT) AS z_num, CAST(zd AS BIGINT) AS z_den FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.query_id = a.query_id AND (CAST(b.zn AS DECIMAL(38, 0)) * a.zd < CAST(a.zn AS DECIMAL(38, 0)) * b.zd OR (CAST(b.zn AS DECIMAL(38, 0)) * a.zd = CAST(a.zn AS DECIMAL(38, 0)) * b.zd AND b.size < a.size)))""")
def level_sweep(spark, d):
    return ordered.level_sweep(g_part(spark, d), _scores(spark, d), _seeds(spark))


@query(f"""{PART}, {_SCORE}, rk AS (SELECT query_id, u, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, u) AS r FROM sc JOIN (SELECT u AS du FROM deg) ON du = u),
ed AS (SELECT a.query_id, greatest(a.r, b.r) AS r, sum(w) AS w FROM e JOIN rk a ON a.u = e.u JOIN rk b ON b.u = e.v AND a.query_id = b.query_id GROUP BY a.query_id, greatest(a.r, b.r)),
st AS (SELECT rk.query_id, rk.r AS size, CAST(sum(d) OVER q AS BIGINT) AS vol, CAST(sum(d) OVER q - 2 * sum(coalesce(ed.w, 0)) OVER q AS BIGINT) AS cut FROM rk JOIN deg ON deg.u = rk.u LEFT JOIN ed ON ed.query_id = rk.query_id AND ed.r = rk.r WINDOW q AS (PARTITION BY rk.query_id ORDER BY rk.r)),
ok AS (SELECT *, least(vol, m - vol) AS den FROM st, tot WHERE least(vol, m - vol) > 0), bs AS (SELECT query_id, min(CAST(cut AS DOUBLE) / den) AS b FROM ok GROUP BY query_id)
SELECT query_id, min(size) AS size, arg_min(vol, size) AS vol, arg_min(cut, size) AS cut, arg_min(den, size) AS den FROM ok JOIN bs USING (query_id) WHERE CAST(cut AS DOUBLE) / den = b GROUP BY query_id""")
def baseline_sweep(spark, d):
    return ordered.vertex_sweep(g_part(spark, d), _scores(spark, d))


@query(f"""{PART}, {_SCORE}, s0 AS (SELECT query_id, p_partkey AS u FROM part, (VALUES (1), (2)) q(query_id) WHERE p_partkey <= 100),
bg AS (SELECT query_id, sum(d) AS v0 FROM s0 JOIN deg ON deg.u = s0.u GROUP BY query_id),
lv AS (SELECT sc.query_id, x, sum(CASE WHEN s0.u IS NULL THEN d ELSE 0 END) AS ex FROM sc JOIN deg ON deg.u = sc.u LEFT JOIN s0 ON s0.u = sc.u AND s0.query_id = sc.query_id GROUP BY sc.query_id, x),
rn AS (SELECT *, sum(ex) OVER (PARTITION BY query_id ORDER BY x DESC) AS c FROM lv),
ok AS (SELECT rn.query_id, min(x) AS x FROM rn JOIN bg ON bg.query_id = rn.query_id WHERE 2 * c <= 3 * v0 GROUP BY rn.query_id)
SELECT sc.query_id, sc.u FROM sc JOIN deg ON deg.u = sc.u JOIN ok ON ok.query_id = sc.query_id AND sc.x >= ok.x UNION SELECT query_id, u FROM s0""")
def capped_region(spark, d):
    p = table(spark, d, "part").where("p_partkey <= 100").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("query_id"), F.col("p_partkey").alias("u"))
    return ordered.capped_region(g_part(spark, d), _scores(spark, d), p, 3, 2)


@query(f"""{PART}, {_SCORE}, sq AS (SELECT * FROM (VALUES (1, 5), (2, 7)) s(query_id, seed)), s AS (SELECT query_id, b.p_partkey AS u FROM sq JOIN part a ON a.p_partkey = seed JOIN part b ON b.p_brand = a.p_brand),
z AS (SELECT query_id, CAST(sum(d) AS BIGINT) AS vol FROM s JOIN deg ON deg.u = s.u GROUP BY query_id), i AS (SELECT a.query_id, CAST(sum(w) AS BIGINT) AS inn FROM adj JOIN s a ON a.u = adj.u JOIN s b ON b.u = adj.v AND b.query_id = a.query_id GROUP BY a.query_id),
o AS (SELECT sq.query_id, deg.u, deg.d, sum(deg.d) OVER (PARTITION BY sq.query_id ORDER BY CASE WHEN deg.u = seed THEN 0 WHEN s.u IS NOT NULL THEN 1 ELSE 2 END, coalesce(x, 0) DESC, deg.u ROWS UNBOUNDED PRECEDING) AS c
  FROM sq CROSS JOIN part JOIN deg ON deg.u = p_partkey LEFT JOIN s ON s.u = deg.u AND s.query_id = sq.query_id LEFT JOIN sc ON sc.u = deg.u AND sc.query_id = sq.query_id)
SELECT o.query_id, o.u, CAST((c * c - (c - d) * (c - d)) * vol - ((vol - coalesce(inn, 0)) * m + vol * vol) * d AS BIGINT) AS num, CAST(m * vol AS BIGINT) AS den FROM o JOIN z ON z.query_id = o.query_id LEFT JOIN i ON i.query_id = o.query_id, tot""")
def mm_surrogate(spark, d):
    """One minorise step over all parts, from the brand of each query's seed."""
    p, s = table(spark, d, "part"), _seeds(spark)
    brand = p.join(s, F.col("p_partkey") == F.col("seed")).select("query_id", "p_brand")
    region = p.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("query_id"), F.col("p_partkey").alias("u"))
    return ordered.surrogate(g_part(spark, d), region, p.join(brand, "p_brand").select("query_id", F.col("p_partkey").alias("u")), s, _scores(spark, d))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
k AS (SELECT * FROM (VALUES (1), (3), (9)) k(k)), j AS (SELECT o_custkey, k, i, o_totalprice FROM r, k WHERE i <= k)
SELECT o_custkey, k, min(i) FILTER (WHERE o_totalprice = b) AS best_at, any_value(b) AS best FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey, k) AS b, count(*) OVER (PARTITION BY o_custkey, k) AS n FROM j) WHERE n = k GROUP BY o_custkey, k""")
def prefix_best(spark, d):
    return ordered.prefix_best(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice", [1, 3, 9])


@query("WITH m AS (SELECT p_type, min(p_partkey) AS m FROM part GROUP BY p_type), n AS (SELECT p_type, row_number() OVER (ORDER BY m) - 1 AS l FROM m) SELECT p_partkey AS u, l FROM part JOIN n USING (p_type)")
def canonical_labels(spark, d):
    return ordered.canonical_labels(table(spark, d, "part").select(F.col("p_partkey").alias("u"), F.col("p_type").alias("l")))


@query(f"""{SUPP}, x AS (SELECT u AS i, v AS j, CAST((u * 31 + v * 17) % 1000 AS DOUBLE) AS x FROM e), b AS (SELECT i, j, x FROM x UNION ALL SELECT j, i, x FROM x)
SELECT x.i, x.j, a.j AS k, x.x - a.x - c.x AS violation FROM x JOIN b a ON a.i = x.i JOIN b c ON c.i = x.j AND c.j = a.j WHERE x.x - a.x - c.x > 0 ORDER BY violation DESC, x.i, x.j, k LIMIT 500""")
def topk_triangles(spark, d):
    """The 500 worst breaches of the triangle inequality: a top-k report."""
    x = g_supp(spark, d).edges.select(F.col("u").alias("i"), F.col("v").alias("j"), ((F.col("u") * 31 + F.col("v") * 17) % 1000).cast("double").alias("x"))
    return ordered.violated_triangles(x, 500)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 2 = 1 THEN n - 1 - ((i - o_custkey % n + n) % n) ELSE (i - o_custkey % n + n) % n END AS place FROM r""")
def rotated_order(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return ordered.rotated(o, "o_orderkey", "o_custkey", F.col("o_custkey"), F.col("o_custkey") % 2 == 1)


# --- hypergraphs ------------------------------------------------------------------------------


@query(f"{HYPER} SELECT u, d FROM deg")
def hyper_degree(spark, d):
    return hyper.degrees(hyper.h_order(spark, d))


@query(f"{HYPER} SELECT r, count(*) AS n FROM rk GROUP BY r")
def rank_histogram(spark, d):
    return hyper.h_order(spark, d).select("e", "r").distinct().groupBy("r").agg(F.count("*").alias("n"))


def _hyper_cut_sql(w: str) -> str:
    return f"""{HYPER}, s AS (SELECT p_brand AS set_id, p_partkey AS u FROM part), v AS (SELECT set_id, count(*) AS size, CAST(coalesce(sum(d), 0) AS BIGINT) AS vol FROM s LEFT JOIN deg ON deg.u = s.u GROUP BY set_id),
j AS (SELECT set_id, e, r, count(*) AS j FROM inc JOIN s ON s.u = inc.u GROUP BY set_id, e, r), c AS (SELECT set_id, CAST(sum({w}) AS BIGINT) AS cut FROM j GROUP BY set_id)
SELECT v.set_id, size, vol, coalesce(cut, 0) AS cut FROM v LEFT JOIN c ON c.set_id = v.set_id"""


@query(_hyper_cut_sql("CASE WHEN j < r THEN 1 ELSE 0 END"))
def hyper_cut(spark, d):
    return hyper.set_cut(hyper.h_order(spark, d), brands(spark, d), "all_or_nothing")


@query(_hyper_cut_sql("least(j, r - j)"))
def hyper_cut_cardinality(spark, d):
    return hyper.set_cut(hyper.h_order(spark, d), brands(spark, d), "cardinality_min")


@query(f"""{HYPER}, s AS (SELECT p_brand AS set_id, p_partkey AS u FROM part), v AS (SELECT set_id, CAST(sum(d) AS DOUBLE) AS vol FROM s JOIN deg ON deg.u = s.u GROUP BY set_id),
c AS (SELECT set_id, count(*) AS cut FROM (SELECT set_id, e, r, count(*) AS j FROM inc JOIN s ON s.u = inc.u GROUP BY set_id, e, r) WHERE j < r GROUP BY set_id), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM inc),
p AS (SELECT v.set_id, vol, coalesce(cut, 0) AS cut, vol / m AS x FROM v LEFT JOIN c ON c.set_id = v.set_id, m),
g AS (SELECT p.set_id, vol - sum(n * (1 - pow(1 - x, r) - pow(x, r))) AS g FROM p, (SELECT r, count(*) AS n FROM rk GROUP BY r) k GROUP BY p.set_id, vol)
SELECT p.set_id, round(g, 5) AS g, round((cut + g) / vol, 7) AS z FROM p JOIN g ON g.set_id = p.set_id""")
def hyper_quality(spark, d):
    q = hyper.set_quality(hyper.h_order(spark, d), brands(spark, d))
    return q.where("vol > 0").select("set_id", F.round("g", 5).alias("g"), F.round("z", 7).alias("z"))


@query(f"""{HYPER}, {_SCORE.replace(" UNION ALL SELECT 2, p_partkey, CAST((p_partkey * 7919) % 1000 AS DOUBLE) FROM part WHERE (p_partkey * 7919) % 1000 > 0", "")},
o AS (SELECT query_id, x, r, row_number() OVER (PARTITION BY query_id, e ORDER BY x DESC, inc.u) AS j FROM inc JOIN sc ON sc.u = inc.u),
p AS (SELECT query_id, x, count(*) AS vol, sum(least(j, r - j) - least(j - 1, r - j + 1)) AS cut FROM o GROUP BY query_id, x), n AS (SELECT query_id, x, count(*) AS n FROM sc GROUP BY query_id, x)
SELECT n.query_id, n.x, CAST(sum(n) OVER w AS BIGINT) AS size, CAST(sum(coalesce(vol, 0)) OVER w AS BIGINT) AS vol, CAST(sum(coalesce(cut, 0)) OVER w AS BIGINT) AS cut FROM n LEFT JOIN p ON p.query_id = n.query_id AND p.x = n.x WINDOW w AS (PARTITION BY n.query_id ORDER BY n.x DESC)""")
def hyper_sweep(spark, d):
    return hyper.sweep_steps(hyper.h_order(spark, d), _scores(spark, d).where("query_id = 1"), "cardinality_min")


@query(f"{HYPER} SELECT a.u, b.u AS v, round(sum(1.0::DOUBLE / (a.r - 1)), 9) AS weight FROM inc a JOIN inc b ON a.e = b.e AND a.u < b.u GROUP BY a.u, b.u")
def clique_expansion(spark, d):
    c = hyper.clique_expansion(hyper.h_order(spark, d))
    return c.select("u", "v", F.round("weight", 9).alias("weight"))


@query(f"""{HYPER}, h AS (SELECT e, inc.u, CAST(p_size AS DOUBLE) AS x FROM inc JOIN part ON p_partkey = inc.u)
SELECT e, arg_min(u, (-x, u)) AS first_u, arg_max(u, (-x, u)) AS last_u, max(x) - min(x) AS fall FROM h GROUP BY e""")
def hyper_gradient_ends(spark, d):
    h = table(spark, d, "part").select(F.col("p_partkey").alias("u"), F.col("p_size").cast("double").alias("x"))
    return hyper.gradient_ends(hyper.h_order(spark, d), h)


@query()
def hyper_top_l(spark, d):
    return hyper.top_l_epochs(hyper.h_order(spark, d), 5, 2000.0, 4)


# --- covers -----------------------------------------------------------------------------------


def _truth_cover(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("cid"), F.col("p_partkey").alias("node")).unionByName(p.select(F.col("p_type").alias("cid"), F.col("p_partkey").alias("node")))


def _band_cover(spark, d):
    p = table(spark, d, "part")
    band = p.select(F.concat(F.lit("s"), F.floor(F.col("p_size") / 5).cast("string")).alias("cid"), F.col("p_partkey").alias("node"))
    return band.unionByName(p.where("p_size % 3 = 0").select(F.col("p_brand").alias("cid"), F.col("p_partkey").alias("node")))


_COVERS = """t AS (SELECT p_brand AS cid, p_partkey AS node FROM part UNION SELECT p_type, p_partkey FROM part),
p AS (SELECT 's' || CAST(p_size // 5 AS VARCHAR) AS cid, p_partkey AS node FROM part UNION SELECT p_brand, p_partkey FROM part WHERE p_size % 3 = 0),
nt AS (SELECT cid, count(*) AS n FROM t GROUP BY cid), np AS (SELECT cid, count(*) AS n FROM p GROUP BY cid),
x AS (SELECT t.cid AS tcid, p.cid AS pcid, count(*) AS "both" FROM t JOIN p ON t.node = p.node GROUP BY t.cid, p.cid)"""


@query(f'WITH {_COVERS} SELECT tcid, pcid, "both", nt.n AS t, np.n AS p FROM x JOIN nt ON nt.cid = tcid JOIN np ON np.cid = pcid')
def cover_intersections(spark, d):
    return cover.intersections(_truth_cover(spark, d), _band_cover(spark, d))


@query(f"""WITH {_COVERS}, a AS (SELECT node FROM t GROUP BY node HAVING count(*) > 1), b AS (SELECT node FROM p GROUP BY node HAVING count(*) > 1)
SELECT (SELECT count(*) FROM a JOIN b USING (node)) AS tp, (SELECT count(*) FROM b) AS predicted, (SELECT count(*) FROM a) AS actual""")
def overlap_nodes(spark, d):
    return cover.overlap(_truth_cover(spark, d), _band_cover(spark, d))


@query("""WITH t AS (SELECT p_brand AS cid, p_partkey AS node FROM part UNION SELECT p_type, p_partkey FROM part), k AS (SELECT node, count(*) AS k FROM t GROUP BY node),
g AS (SELECT cid, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS m FROM t GROUP BY cid)
SELECT (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM t) AS memberships, (SELECT count(*) FROM k) AS covered, (SELECT count(*) FROM part) - (SELECT count(*) FROM k) AS uncovered,
 (SELECT count(*) FROM k WHERE k > 1) AS overlapping, (SELECT count(*) - count(DISTINCT m) FROM g) AS duplicate_groups""")
def cover_summary(spark, d):
    return cover.cover_stats(_truth_cover(spark, d), table(spark, d, "part").count())


@query(f"""WITH {_COVERS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM part),
f AS (SELECT nt.cid AS tcid, np.cid AS pcid, nt.n AS t, np.n AS p, coalesce("both", 0) AS d, n.n FROM nt CROSS JOIN np CROSS JOIN n LEFT JOIN x ON x.tcid = nt.cid AND x.pcid = np.cid),
h AS (SELECT *, [n - t - p + d, p - d, t - d, d, t, n - t, p, n - p] AS c FROM f),
k AS (SELECT *, list_transform(c, lambda q: CASE WHEN q > 0 THEN -q * log2(q / n) ELSE 0 END) AS q FROM h),
z AS (SELECT tcid, pcid, q[5] + q[6] AS hx, q[7] + q[8] AS hy, CASE WHEN q[1] + q[4] >= q[2] + q[3] THEN q[1] + q[2] + q[3] + q[4] - q[7] - q[8] ELSE q[5] + q[6] END AS xy, CASE WHEN q[1] + q[4] >= q[2] + q[3] THEN q[1] + q[2] + q[3] + q[4] - q[5] - q[6] ELSE q[7] + q[8] END AS yx FROM k),
a AS (SELECT sum(h) AS h, sum(c) AS c FROM (SELECT any_value(hx) AS h, min(xy) AS c FROM z GROUP BY tcid)), b AS (SELECT sum(h) AS h, sum(c) AS c FROM (SELECT any_value(hy) AS h, min(yx) AS c FROM z GROUP BY pcid))
SELECT round(0.5 * (a.h + b.h - a.c - b.c) / greatest(a.h, b.h), 7) AS onmi, 'SCORED' AS status FROM a, b""")
def onmi(spark, d):
    o = cover.overlapping_nmi(_truth_cover(spark, d), _band_cover(spark, d), table(spark, d, "part").count())
    return o.select(F.round("onmi", 7).alias("onmi"), "status")


@query()
def cover_matching(spark, d):
    return cover.matching(_truth_cover(spark, d), _band_cover(spark, d))


@query()
def cover_scores(spark, d):
    return cover.macro_scores(_truth_cover(spark, d), _band_cover(spark, d))


# --- rounds -----------------------------------------------------------------------------------


@query(f"""{GEO}, n AS (SELECT n_nationkey + 2000000000000 AS u, n_regionkey + 3000000000000 AS r FROM nation),
x AS (SELECT r AS u, r FROM n UNION SELECT u, r FROM n UNION SELECT e.u, n.r FROM e JOIN n ON n.u = e.v)
SELECT x.u, min(x.u) OVER (PARTITION BY r) AS c FROM x""")
def components(spark, d):
    """Components of the customer-nation-region forest: one per region."""
    return iterative.components(g_geo(spark, d).edges)


@query(f"""{PART}, reach AS (SELECT (SELECT min(u) FROM deg) AS u UNION SELECT adj.v FROM reach JOIN adj ON adj.u = reach.u)
SELECT deg.u, CASE WHEN reach.u IS NOT NULL THEN (SELECT min(u) FROM deg) ELSE deg.u END AS c FROM deg LEFT JOIN reach ON reach.u = deg.u""")
def components_parts(spark, d):
    """Components of the co-purchase graph (the SQL assumes one large component and singletons)."""
    return iterative.components(g_part(spark, d).edges)


@query()
def block_union(spark, d):
    """Parts united through the orders they are in, over all lines."""
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_partkey").alias("u"))
    return iterative.union_of_blocks(b)


@query("SELECT count(*) AS vertices, count(DISTINCT p_brand) AS groups, count(*) - count(DISTINCT p_brand) AS rank FROM part")
def identification_rank(spark, d):
    return iterative.identifications(brands(spark, d).withColumnRenamed("set_id", "block_id"))


@query()
def signed_components(spark, d):
    return iterative.signed_components(g_part(spark, d), 1, 1)


@query()
def recursive_contraction(spark, d):
    """What each rule finds per round on the geographic forest."""
    return iterative.recursive_contraction(g_geo(spark, d))[1]


def _push_sql(rounds: int) -> str:
    parts = [SUPP, "r0 AS (SELECT query_id, seed AS u, CAST(0 AS DOUBLE) AS rk, CAST(1 AS DOUBLE) AS rs FROM (VALUES (1, 3), (2, 8)) s(query_id, seed))"]
    for i in range(rounds):
        parts.append(f"""s{i} AS (SELECT r{i}.*, d, rs > 1e-7 * d AS hot FROM r{i} JOIN deg ON deg.u = r{i}.u),
r{i + 1} AS (SELECT query_id, u, sum(rk) AS rk, sum(rs) AS rs FROM (
  SELECT query_id, u, CASE WHEN hot THEN rk + 0.15 * rs ELSE rk END AS rk, CASE WHEN hot THEN 0.85 * rs / 2 ELSE rs END AS rs FROM s{i}
  UNION ALL SELECT query_id, adj.v, 0, 0.85 * rs / (2 * d) * w FROM s{i} JOIN adj ON adj.u = s{i}.u WHERE hot) GROUP BY query_id, u)""")
    return ", ".join(parts) + f" SELECT query_id, u, round(rk, 10) AS rank, round(rs, 10) AS residual FROM r{rounds}"


@query(_push_sql(4))
def acl_rounds(spark, d):
    s = spark.createDataFrame([(1, 3), (2, 8)], "query_id int, seed bigint")
    r = iterative.push_rounds(g_supp(spark, d), s, 0.15, 1e-7, 4)
    return r.select("query_id", "u", F.round("rank", 10).alias("rank"), F.round("residual", 10).alias("residual"))


@query()
def acl_settled(spark, d):
    """Push until no residual exceeds 1e-7 of a degree."""
    s = spark.createDataFrame([(1, 3), (2, 8)], "query_id int, seed bigint")
    return iterative.push_rounds(g_supp(spark, d), s, 0.15, 1e-7)


def _top_sql(epochs: int, seed: int, mass: float) -> str:
    parts = [SUPP, f"x0 AS (SELECT u, CAST(0 AS DOUBLE) AS x FROM deg WHERE u = {seed})"]
    for i in range(epochs):
        parts.append(f"""i{i} AS (SELECT adj.v AS u, sum(w * x) AS ax, sum(w) AS inw FROM adj JOIN x{i} ON x{i}.u = adj.u GROUP BY adj.v),
n{i} AS (SELECT deg.u, x{i}.x IS NOT NULL AS active, coalesce(inw, 0) / d AS sh,
  greatest(coalesce(x, 0) - 0.5 * (d * (1 + 0.0001 * coalesce(x, 0)) + d * coalesce(x, 0) - coalesce(ax, 0) - CASE WHEN deg.u = {seed} THEN {mass} ELSE 0 END) / d, 0) AS y
  FROM deg LEFT JOIN i{i} ON i{i}.u = deg.u LEFT JOIN x{i} ON x{i}.u = deg.u WHERE d > 0 AND (i{i}.u IS NOT NULL OR x{i}.u IS NOT NULL)),
x{i + 1} AS (SELECT u, y AS x FROM n{i} WHERE active AND (y > 0 OR u = {seed}) UNION ALL SELECT u, y FROM (SELECT u, y FROM n{i} WHERE NOT active AND y > 0 ORDER BY y * sh DESC, u LIMIT 50))""")
    return ", ".join(parts) + f" SELECT u, round(x, 4) AS x FROM x{epochs}"


@query(_top_sql(5, 3, 5000000.0))
def topl_epochs(spark, d):
    return iterative.top_l_epochs(g_supp(spark, d), 3, 5000000.0, 5).select("u", F.round("x", 4).alias("x"))


def _label_sql(rounds: int) -> str:
    parts = [SUPP, "m0 AS (SELECT u, u AS label, CAST(1 AS BIGINT) AS n FROM deg)"]
    for i in range(rounds):
        parts.append(f"""y{i} AS (SELECT u, arg_max(label, (n, -label)) AS label FROM m{i} GROUP BY u),
h{i} AS (SELECT adj.v AS u, label, sum(w) AS w FROM adj JOIN y{i} ON y{i}.u = adj.u GROUP BY adj.v, label),
m{i + 1} AS (SELECT u, label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM m{i} UNION ALL SELECT u, arg_max(label, (w, -label)), 1 FROM h{i} GROUP BY u) GROUP BY u, label)""")
    return ", ".join(parts) + f" SELECT u, label, n FROM m{rounds}"


@query(_label_sql(3))
def slpa_rounds(spark, d):
    return iterative.label_rounds(g_supp(spark, d), 3)


@query(_label_sql(5).rsplit(" SELECT u, label, n FROM m5", 1)[0] + " SELECT label AS cid, m5.u AS node FROM m5 JOIN (SELECT u, sum(n) AS t FROM m5 GROUP BY u) x ON x.u = m5.u WHERE n >= 0.3 * t")
def slpa_cover(spark, d):
    return iterative.label_cover(iterative.label_rounds(g_supp(spark, d), 5), 0.3)


@query(f"""{PAIR} SELECT a.u AS ego, a.v AS u, least(a.v, coalesce(min(t.x), a.v)) AS c FROM adj a
LEFT JOIN (SELECT b.u AS ego, b.v AS y, c.v AS x FROM adj b JOIN adj c ON c.u = b.u JOIN adj o ON o.u = b.v AND o.v = c.v) t ON t.ego = a.u AND t.y = a.v GROUP BY a.u, a.v""")
def ego_components(spark, d):
    """Ego networks of customers in pairs: a partner and the nation both hang on are one component, other neighbours are alone."""
    return iterative.ego_components(g_pair(spark, d))


@query()
def ego_personas(spark, d):
    return iterative.persona_ids(g_part(spark, d))


@query()
def ego_splitting(spark, d):
    return iterative.ego_splitting(g_part(spark, d), 2)


# --- vectors ----------------------------------------------------------------------------------


def _vector_pairs(spark, d):
    from meshwright.operators.vectors import pair_dots

    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")).unionByName(v.select(F.col("vec_id").alias("a"), (F.col("vec_id") * 7 % 97).alias("b")))
    return pair_dots(pairs, v)


_DOT = """pr AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings UNION ALL SELECT vec_id, vec_id * 7 % 97 FROM embeddings),
dt AS (SELECT pr.a, pr.b, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS dot FROM pr JOIN embeddings x ON x.vec_id = pr.a JOIN embeddings y ON y.vec_id = pr.b)"""


@query(f"WITH {_DOT} SELECT a, b, round(dot, 6) AS dot FROM dt")
def pair_dot(spark, d):
    return _vector_pairs(spark, d).select("a", "b", F.round("dot", 6).alias("dot"))


@query(f"""WITH {_DOT}, l AS (SELECT x.label = y.label AS edge, abs(dot) AS dot FROM dt JOIN embeddings x ON x.vec_id = dt.a JOIN embeddings y ON y.vec_id = dt.b WHERE dt.a <> dt.b)
SELECT count(*) FILTER (WHERE edge) AS edges, count(*) FILTER (WHERE NOT edge) AS non_edges, round((avg(-ln(1 - exp(-0.001 - dot))) FILTER (WHERE edge) + 10 * avg(dot) FILTER (WHERE NOT edge)) / 11, 6) AS loss FROM l""")
def berpo_loss(spark, d):
    from meshwright.operators.vectors import bernoulli_poisson_loss

    lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("label").alias("la"))
    dots = _vector_pairs(spark, d).where("a <> b").join(lab, "a").join(lab.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b")
    r = bernoulli_poisson_loss(dots.select((F.col("la") == F.col("lb")).alias("edge"), F.abs("dot").alias("dot")), 0.001, 10.0)
    return r.select("edges", "non_edges", F.round("loss", 6).alias("loss"))


def queries():
    return Q


def oracle_sql():
    return SQL
