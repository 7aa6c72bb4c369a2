"""Queries over run records, traces and logs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import reports
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


def _runs(spark, d):
    return table(spark, d, "runs")


# deliveries of one record agree but for the load
ONCE = """WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY load_id DESC) AS k FROM runs) WHERE k = 1),
ok AS (SELECT *, coalesce(status = 'COMPLETED' AND isfinite(pipeline_seconds) AND pipeline_seconds > 0 AND isfinite(matched_macro_f1) AND matched_macro_f1 BETWEEN 0 AND 1, false) AS sound FROM once)"""
PAIRS = f"""{ONCE}, c AS (SELECT * FROM (SELECT record_id, method, status, pipeline_seconds AS s, matched_macro_f1 AS f, sound, coalesce(case_id, '') AS case_id, coalesce(information_policy, '') AS information_policy,
  coalesce(device, '') AS device, coalesce(CAST(threads AS VARCHAR), '') AS threads, coalesce(CAST(seed AS VARCHAR), '') AS seed,
  row_number() OVER (PARTITION BY method, coalesce(case_id, ''), coalesce(information_policy, ''), coalesce(device, ''), coalesce(CAST(threads AS VARCHAR), ''), coalesce(CAST(seed AS VARCHAR), '') ORDER BY record_id) AS r FROM ok) WHERE r = 1),
pr AS (SELECT a.case_id, a.information_policy, a.device, a.threads, a.seed, a.method AS reference, b.method AS comparison,
  CASE WHEN a.sound AND b.sound THEN 'both_completed_and_scored' ELSE 'not_both_completed_and_scored' END AS basis,
  CASE WHEN a.sound AND b.sound THEN b.s / a.s END AS ratio, CASE WHEN a.sound AND b.sound THEN b.f - a.f END AS delta
  FROM c a JOIN c b ON a.case_id = b.case_id AND a.information_policy = b.information_policy AND a.device = b.device AND a.threads = b.threads AND a.seed = b.seed AND a.method < b.method)"""


@query(f"{PAIRS} SELECT case_id, information_policy, device, threads, seed, reference, comparison, basis, round(ratio, 8) AS ratio, round(delta, 8) AS delta FROM pr")
def paired_runs(spark, d):
    p = reports.paired_runs(_runs(spark, d))
    return p.withColumn("ratio", F.round("ratio", 8)).withColumn("delta", F.round("delta", 8))


@query(f"""{PAIRS} SELECT reference, comparison, count(*) AS planned, count(ratio) AS "both", count(*) FILTER (WHERE delta >= 0 AND ratio < 1) AS better_and_faster,
  round(median(ratio), 8) AS median_ratio, round(median(delta), 8) AS median_delta FROM pr GROUP BY reference, comparison""")
def pair_summary(spark, d):
    s = reports.pair_summary(reports.paired_runs(_runs(spark, d)))
    return s.withColumn("median_ratio", F.round("median_ratio", 8)).withColumn("median_delta", F.round("median_delta", 8))


@query(f"""{PAIRS}, g AS (SELECT reference, comparison, seed, count(*) AS n, count(ratio) AS k, median(1 - ratio) AS ms, avg(delta) AS md FROM pr GROUP BY reference, comparison, seed)
SELECT reference, comparison, seed, n, CASE WHEN n >= 2 AND n = k THEN round(ms, 8) END AS median_saving, CASE WHEN n >= 2 AND n = k THEN round(md, 8) END AS mean_delta, CASE WHEN n >= 2 AND n = k THEN ms > 0 AND md >= -0.01 END AS passed FROM g""")
def gate_decision(spark, d):
    g = reports.gates(reports.paired_runs(_runs(spark, d)), 2)
    return g.withColumn("median_saving", F.round("median_saving", 8)).withColumn("mean_delta", F.round("mean_delta", 8))


_ARMS = [("split_vs_mix", "hubsplit", "labelmix"), ("walk_vs_fan", "tidewalk", "seedfan")]


@query(
    f"{ONCE}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, case_id, seed ORDER BY record_id) AS r FROM ok WHERE case_id IS NOT NULL AND seed IS NOT NULL) WHERE r = 1)"
    + " UNION ALL ".join(
        f""" SELECT '{n}' AS comparison, coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.seed, b.seed) AS seed, a.status AS status_a, b.status AS status_b,
  CASE WHEN a.status = 'COMPLETED' AND b.status = 'COMPLETED' AND NOT isnan(a.pipeline_seconds) AND NOT isnan(b.pipeline_seconds) THEN round(b.pipeline_seconds - a.pipeline_seconds, 8) END AS delta
  FROM (SELECT * FROM c WHERE method = '{x}') a FULL OUTER JOIN (SELECT * FROM c WHERE method = '{y}') b ON a.case_id = b.case_id AND a.seed = b.seed"""
        for n, x, y in _ARMS
    )
)
def arm_compare(spark, d):
    return reports.arm_comparison(_runs(spark, d), _ARMS).withColumn("delta", F.round("delta", 8))


@query("""WITH p AS (SELECT case_id, method FROM (SELECT DISTINCT case_id FROM cases), (SELECT DISTINCT method FROM method_reference)),
o AS (SELECT case_id, method, bool_or(coalesce(status = 'COMPLETED', false)) AS ok FROM runs WHERE case_id IS NOT NULL GROUP BY case_id, method)
SELECT p.method, count(*) AS planned, count(*) FILTER (WHERE ok) AS completed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok IS NULL) AS not_run FROM p LEFT JOIN o ON o.case_id = p.case_id AND o.method = p.method GROUP BY p.method""")
def planned_runs(spark, d):
    return reports.planned_runs(table(spark, d, "cases"), table(spark, d, "method_reference"), _runs(spark, d))


@query("SELECT case_id, count(*) AS n FROM runs WHERE case_id IS NULL OR case_id NOT IN (SELECT case_id FROM cases) GROUP BY case_id")
def unplanned_runs(spark, d):
    return reports.unplanned_runs(table(spark, d, "cases"), _runs(spark, d))


@query(f"""{ONCE} SELECT method, device, threads, grouping(method, device, threads) AS level, count(*) AS n, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
  min(CASE WHEN sound THEN pipeline_seconds END) AS low, round(median(CASE WHEN sound THEN pipeline_seconds END), 8) AS middle, max(CASE WHEN sound THEN pipeline_seconds END) AS high
  FROM ok GROUP BY GROUPING SETS ((), (method), (method, device), (method, threads))""")
def panel_summary(spark, d):
    return reports.panel_summary(_runs(spark, d)).withColumn("middle", F.round("middle", 8))


@query("SELECT method, status, count(*) AS n FROM runs GROUP BY method, status")
def status_counts(spark, d):
    return reports.status_counts(_runs(spark, d))


@query("""WITH t AS (SELECT job_id, epoch, CASE WHEN isnan(elapsed) THEN NULL ELSE elapsed END AS elapsed, f1, level FROM trace, (VALUES (0.3::DOUBLE), (0.5), (0.7), (0.9)) l(level) WHERE f1 IS NOT NULL AND NOT isnan(f1) AND epoch IS NOT NULL AND f1 >= level),
m AS (SELECT job_id, level, min(epoch) AS epoch FROM t GROUP BY job_id, level) SELECT m.job_id, m.level, m.epoch, min(elapsed) AS elapsed FROM m JOIN t ON t.job_id = m.job_id AND t.level = m.level AND t.epoch = m.epoch GROUP BY m.job_id, m.level, m.epoch""")
def first_crossing(spark, d):
    return reports.first_crossings(table(spark, d, "trace"), [0.3, 0.5, 0.7, 0.9])


@query("""WITH r AS (SELECT job_id, epoch, coalesce(CASE WHEN isnan(f1) THEN NULL ELSE f1 END, -1) AS f, row_number() OVER (PARTITION BY job_id ORDER BY loss, epoch, coalesce(CASE WHEN isnan(f1) THEN NULL ELSE f1 END, -1)) AS k
FROM trace WHERE loss IS NOT NULL AND NOT isnan(loss) AND epoch IS NOT NULL) SELECT job_id, epoch, CASE WHEN f >= 0 THEN f END AS f1 FROM r WHERE k = 1""")
def trace_selection(spark, d):
    return reports.trace_selection(table(spark, d, "trace"))


@query("""WITH e AS (SELECT DISTINCT job_id, epoch FROM trace WHERE epoch IS NOT NULL)
SELECT job_id, max(epoch) AS last, count(*) AS checks, CAST(max(epoch) // 50 + 1 - count(*) FILTER (WHERE epoch % 50 = 0) AS BIGINT) AS gaps, max(epoch) AS low, max(epoch) + 49 AS high FROM e GROUP BY job_id""")
def trace_bounds(spark, d):
    return reports.trace_bounds(table(spark, d, "trace"))


@query(f"""{ONCE} SELECT method, count(*) AS n, round(regr_slope(log10(pipeline_seconds), log10(n_vertices)), 7) AS slope, round(regr_intercept(log10(pipeline_seconds), log10(n_vertices)), 7) AS intercept
FROM ok JOIN (SELECT DISTINCT case_id, n_vertices FROM cases WHERE n_vertices > 0) c ON c.case_id = ok.case_id WHERE sound GROUP BY method""")
def ols_slope(spark, d):
    s = reports.cost_slope(_runs(spark, d), table(spark, d, "cases"))
    return s.select("method", "n", F.round("slope", 7).alias("slope"), F.round("intercept", 7).alias("intercept"))


@query(f"""{ONCE}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, case_id, seed ORDER BY record_id) AS r FROM ok WHERE case_id IS NOT NULL AND seed IS NOT NULL) WHERE r = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY method, case_id ORDER BY seed) AS i FROM c)
SELECT method, case_id, k.k AS k, CASE WHEN count(*) FILTER (WHERE sound) = k.k THEN round(sum(pipeline_seconds), 6) END AS cost FROM o, (VALUES (1), (3), (5)) k(k) WHERE i <= k.k GROUP BY method, case_id, k.k HAVING count(*) = k.k""")
def workload_totals(spark, d):
    return reports.workload_totals(_runs(spark, d)).withColumn("cost", F.round("cost", 6))


@query(f"""{ONCE}, m AS (SELECT case_id, method, avg(matched_macro_f1) AS score FROM ok WHERE sound GROUP BY case_id, method),
r AS (SELECT *, lead(score) OVER w AS nx, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY case_id ORDER BY score DESC, method)) SELECT case_id, method, round(score, 7) AS score, round(score - nx, 7) AS gap FROM r WHERE i = 1""")
def model_selection(spark, d):
    m = reports.model_selection(_runs(spark, d))
    return m.select("case_id", "method", F.round("score", 7).alias("score"), F.round("gap", 7).alias("gap"))


@query("""SELECT record_id, count(DISTINCT (job_id, case_id, method, information_policy, device, threads, seed, status, pipeline_seconds, matched_macro_f1, onmi, peak_tree_rss_bytes, finished_at)) AS versions FROM runs GROUP BY record_id
HAVING count(DISTINCT (job_id, case_id, method, information_policy, device, threads, seed, status, pipeline_seconds, matched_macro_f1, onmi, peak_tree_rss_bytes, finished_at)) > 1""")
def inconsistent_records(spark, d):
    return reports.inconsistent_records(_runs(spark, d))


@query(f"{ONCE} SELECT method, count(*) FILTER (WHERE sound) AS completed, round(sum(pipeline_seconds) FILTER (WHERE sound), 4) AS cost FROM ok GROUP BY method HAVING count(*) FILTER (WHERE sound) > 0 ORDER BY completed DESC, cost, method LIMIT 1")
def backend_choice(spark, d):
    return reports.backend_choice(_runs(spark, d)).withColumn("cost", F.round("cost", 4))


@query("""WITH x AS (SELECT doc_id, regexp_extract_all(text, 'stage=''([^''\\n]*)'' elapsed=([0-9]+(?:\\.[0-9]+)?)', 1) AS s, regexp_extract_all(text, 'stage=''([^''\\n]*)'' elapsed=([0-9]+(?:\\.[0-9]+)?)', 2) AS e FROM documents WHERE text LIKE '%elapsed=%')
SELECT doc_id, CAST(i - 1 AS INT) AS position, s[i] AS stage, CAST(e[i] AS DOUBLE) AS elapsed FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM x)""")
def log_stages(spark, d):
    return reports.log_stages(table(spark, d, "documents"))


@query(f"""{ONCE} SELECT method, CASE WHEN matched_macro_f1 < 0.5 THEN '[0,.5)' WHEN matched_macro_f1 < 0.9 THEN '[.5,.9)' WHEN matched_macro_f1 < 1 THEN '[.9,1)' ELSE '1' END AS bin, count(*) AS n FROM ok WHERE sound GROUP BY ALL""")
def quality_bins(spark, d):
    return reports.quality_bins(_runs(spark, d))


@query(f"""{ONCE}, a AS (SELECT case_id, method, min(matched_macro_f1) AS f, max(onmi) AS o FROM ok WHERE sound AND seed <= 72 GROUP BY case_id, method), b AS (SELECT case_id, method, min(matched_macro_f1) AS f, max(onmi) AS o FROM ok WHERE sound AND seed > 72 GROUP BY case_id, method),
j AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.method, b.method) AS method, a.f AS fa, b.f AS fb, a.o AS oa, b.o AS ob FROM a FULL OUTER JOIN b ON a.case_id = b.case_id AND a.method = b.method),
u AS (SELECT case_id, method, 'f' AS field, fa AS a, fb AS b FROM j UNION ALL SELECT case_id, method, 'o', oa, ob FROM j)
SELECT * FROM u WHERE NOT ((a IS NULL AND b IS NULL) OR coalesce(abs(a - b) <= 0.05, false))""")
def score_differences(spark, d):
    """Best scores of early and late seeds that differ by more than 0.05."""
    r = reports.one_per_record(_runs(spark, d)).where(reports.sound())

    def side(where):
        return r.where(where).groupBy("case_id", "method").agg(F.min("matched_macro_f1").alias("f"), F.max("onmi").alias("o"))

    return reports.score_differences(side("seed <= 72"), side("seed > 72"), ["case_id", "method"], ["f", "o"], 0.05)


def queries():
    return Q


def oracle_sql():
    return SQL
