"""Queries of the general data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import drift, manifests, nested, profile
from meshwright.session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return manifests.manifest_differences(table(spark, d, "release_manifest"), table(spark, d, "mirror_manifest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.findings(spark, f"{d}/runs.parquet", table(spark, d, "loads"), profile.RUN_RULES)


def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    """Rows and nulls of every column of runs, from the footers."""
    return profile.column_profile(spark, f"{d}/runs.parquet", ranges=False).select("column_name", "n_rows", "nulls")


def p2_statuses(spark: SparkSession, d: str) -> DataFrame:
    """The distinct values of status, from the dictionaries."""
    return profile.distinct_values(spark, f"{d}/runs.parquet", "status")


def p2_loads(spark: SparkSession, d: str) -> DataFrame:
    """Counts of nulls, distinct and invalid values of each load's checked columns."""
    cells = profile.histogram(spark, f"{d}/runs.parquet", "load_id", profile.RUN_RULES)
    stats = profile.load_statistics(cells, "load_id", profile.RUN_RULES)
    return stats.select("load_id", F.col("column").alias("column_name"), F.col("total").alias("n_rows"), "nulls", F.col("distinct").alias("distinct_values"), "invalid")


def _run_rules(spark: SparkSession, d: str) -> list[profile.Rule]:
    return profile.every_rule(table(spark, d, "runs").schema, profile.MEASURE_RULES)


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Counts of nulls, distinct and invalid values and the range of every column of each load."""
    rules = _run_rules(spark, d)
    stats = profile.load_statistics(profile.histogram(spark, f"{d}/runs.parquet", "load_id", rules), "load_id", rules)
    return stats.select("load_id", F.col("column").alias("column_name"), F.col("total").alias("n_rows"), "nulls", F.col("distinct").alias("distinct_values"), "invalid", "low", "high", "low_text", "high_text")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """What p2_found reports, for every column of runs; ids and times differ between loads by nature."""
    return profile.findings(spark, f"{d}/runs.parquet", table(spark, d, "loads"), _run_rules(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "result_files"), table(spark, d, "result_lines"))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """All readable records under one set of names; one row per record and field."""
    files, lines = table(spark, d, "result_files"), table(spark, d, "result_lines")
    found = materialize(drift.changes(files, lines), "changes")
    rows = drift.unified(files, lines, found)
    return rows.select("file_id", "line_no", "record_id", F.explode("fields").alias("field", "value"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    flat = nested.flatten(table(spark, d, "run_records"))
    return flat.where(F.col("entity") != "record").select("record_id", "entity", "position")


def p5_orphans(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, entity, position) of rows whose parent isn't there: none."""
    flat = materialize(nested.flatten(table(spark, d, "run_records")), "flat")
    parents = flat.where(F.col("entity").isin("record", "attempt", "stage")).select("record_id", F.col("position").alias("parent"))
    return flat.where(F.col("entity") != "record").join(parents, ["record_id", "parent"], "left_anti").select("record_id", "entity", "position")


def _entity(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.entity_table(nested.flatten(table(spark, d, "run_records")), name)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (p1_found, p2_found, p2_columns, p2_statuses, p2_loads, p2_profile, p2_changes, p3_found, p3_unified, p5_found, p5_orphans)}
    return own | {f"p5_{e}s": _entity(e) for e in nested.SCHEMAS}


_STATUSES = ", ".join(f"'{s}'" for s in profile.STATUSES)

_CELLS = f"""
    c AS (
      SELECT load_id, 'status' AS column_name, status AS txt, CAST(NULL AS DOUBLE) AS num,
             status IS NULL AS empty, status IN ({_STATUSES}) AS valid FROM runs
      UNION ALL
      SELECT load_id, 'onmi', NULL, onmi, onmi IS NULL, NOT isnan(onmi) AND onmi BETWEEN 0 AND 1 FROM runs
      UNION ALL
      SELECT load_id, 'peak_tree_rss_bytes', NULL, CAST(peak_tree_rss_bytes AS DOUBLE), peak_tree_rss_bytes IS NULL,
             peak_tree_rss_bytes BETWEEN 1048576 AND 1099511627776 FROM runs)"""


_NUMBERS = {
    "record_id": "true", "threads": "true", "seed": "true", "load_id": "true", "finished_at": "true", "onmi": "x BETWEEN 0 AND 1", "matched_macro_f1": "x BETWEEN 0 AND 1",
    "pipeline_seconds": "x BETWEEN 0 AND 1.7976931348623157e308", "peak_tree_rss_bytes": "x BETWEEN 1048576 AND 1099511627776",
}
_TEXTS = {"job_id": "true", "case_id": "true", "method": "true", "information_policy": "true", "device": "true", "status": f"t IN ({_STATUSES})"}


def _profile_sql() -> str:
    """SQL for the profile of every column of each load."""
    parts = [
        f"""SELECT load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count(x) AS nulls, count(DISTINCT x) AS distinct_values, count(*) FILTER (WHERE x IS NOT NULL AND NOT (NOT isnan(x) AND {ok})) AS invalid,
        min(x) FILTER (WHERE NOT isnan(x)) AS low, max(x) FILTER (WHERE NOT isnan(x)) AS high, CAST(NULL AS VARCHAR) AS low_text, CAST(NULL AS VARCHAR) AS high_text
        FROM (SELECT load_id, {'epoch_us(finished_at) / 1e6' if c == 'finished_at' else f'CAST({c} AS DOUBLE)'} AS x FROM runs) WHERE load_id IS NOT NULL GROUP BY load_id"""
        for c, ok in _NUMBERS.items()
    ]
    parts += [
        f"""SELECT load_id, '{c}', count(*), count(*) - count(t), count(DISTINCT t), count(*) FILTER (WHERE t IS NOT NULL AND NOT ({ok})), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), min(t), max(t)
        FROM (SELECT load_id, {c} AS t FROM runs) WHERE load_id IS NOT NULL GROUP BY load_id"""
        for c, ok in _TEXTS.items()
    ]
    return " UNION ALL ".join(parts)


def _opened(x: str) -> str:
    """SQL for a JSON value out of the text it may be written in."""
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) END ELSE {x} END)"


def _listed(x: str) -> str:
    """SQL for a list in whichever way it is written, as a JSON array or an object of places."""
    u = _opened(x)
    places = f"list_bool_and(list_transform(json_keys({u}), lambda k: regexp_full_match(k, '[0-9]+')))"
    return f"(CASE WHEN json_type({u}) = 'OBJECT' AND NOT {places} THEN json_array({u}) WHEN json_type({u}) IN ('OBJECT', 'ARRAY') THEN {u} END)"


_SELECTION = _opened("(doc -> 'metadata' -> 'selection')")
_NESTED = f"""
    WITH RECURSIVE w AS (SELECT record_id, delivered_at, CASE WHEN json_valid(payload) THEN {_opened('CAST(payload AS JSON)')} END AS doc FROM run_records),
    l AS (SELECT record_id, arg_max(doc, delivered_at) AS doc FROM w WHERE json_type(doc) = 'OBJECT' GROUP BY record_id),
    t AS (
      SELECT record_id, 'attempt' AS entity, {_listed("(doc -> 'attempts')")} AS lst FROM l
      UNION ALL SELECT record_id, 'candidate', {_listed(f"({_SELECTION} -> 'candidates')")} FROM l),
    a AS (SELECT record_id, entity, j.key AS position, j.value AS obj FROM t, json_each(t.lst) j WHERE t.lst IS NOT NULL AND j.type = 'OBJECT'),
    k AS (
      SELECT record_id, 'stage' AS entity, position, {_listed("(obj -> 'stage_seconds')")} AS lst FROM a WHERE entity = 'attempt'
      UNION ALL SELECT record_id, 'margin', position, {_listed("(obj -> 'diagnosis' -> 'margins')")} FROM a WHERE entity = 'attempt'),
    s AS (
      SELECT k.record_id, k.entity, k.position || '/' || j.key AS position, {_listed("(j.value -> 'parts')")} AS lst
      FROM k, json_each(k.lst) j WHERE k.lst IS NOT NULL AND j.type = 'OBJECT'
      UNION ALL SELECT s.record_id, s.entity, s.position || '/' || j.key, {_listed("(j.value -> 'parts')")}
      FROM s, json_each(s.lst) j WHERE s.lst IS NOT NULL AND s.entity = 'stage' AND j.type = 'OBJECT')
    SELECT record_id, entity, CAST(position AS VARCHAR) AS position FROM a UNION ALL SELECT record_id, entity, position FROM s"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            WITH u AS (
              SELECT 0 AS side, * FROM release_manifest UNION ALL SELECT 1, * FROM mirror_manifest),
            n AS (
              SELECT side, release_id,
                     nfc_normalize(array_to_string(list_filter(string_split(replace(trim(path), '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/')) AS path,
                     bytes, regexp_replace(lower(trim(sha256)), '^.*:', '') AS sha256, recorded_at FROM u),
            r AS (
              SELECT *, row_number() OVER (PARTITION BY side, release_id, path ORDER BY recorded_at DESC NULLS LAST, bytes DESC NULLS LAST, sha256 DESC NULLS LAST) AS k FROM n),
            l AS (SELECT * FROM r WHERE k = 1),
            j AS (
              SELECT coalesce(a.release_id, b.release_id) AS release_id, coalesce(a.path, b.path) AS path,
                     a.side AS a, b.side AS b, a.bytes AS ab, b.bytes AS bb, a.sha256 AS asha, b.sha256 AS bsha
              FROM (SELECT * FROM l WHERE side = 0) a FULL OUTER JOIN (SELECT * FROM l WHERE side = 1) b
              ON a.release_id = b.release_id AND a.path = b.path)
            SELECT release_id, path, 'missing_in_mirror' AS difference FROM j WHERE b IS NULL
            UNION ALL SELECT release_id, path, 'missing_in_primary' FROM j WHERE a IS NULL
            UNION ALL SELECT release_id, path, 'bytes' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND ab IS DISTINCT FROM bb
            UNION ALL SELECT release_id, path, 'sha256' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND asha IS DISTINCT FROM bsha""",
        "p2_found": f"""
            WITH {_CELLS},
            s AS (
              SELECT load_id, column_name, count(*) AS total, count(*) FILTER (WHERE empty) AS nulls,
                     count(*) FILTER (WHERE NOT empty) AS vals, count(*) FILTER (WHERE NOT empty AND NOT coalesce(isnan(num), false)) AS proper,
                     count(DISTINCT coalesce(txt, CAST(num AS VARCHAR))) AS dist, count(*) FILTER (WHERE NOT empty AND NOT valid) AS invalid
              FROM c WHERE load_id IS NOT NULL GROUP BY load_id, column_name),
            b AS (
              SELECT s.*, p.load_id AS prior, p.total AS ptotal, p.nulls AS pnulls, p.proper AS pproper, p.dist AS pdist
              FROM s JOIN (SELECT DISTINCT load_id, prior_load_id FROM loads WHERE prior_load_id IS NOT NULL) l ON l.load_id = s.load_id
              JOIN s p ON p.load_id = l.prior_load_id AND p.column_name = s.column_name),
            h AS (SELECT load_id, column_name, txt, num, count(*) AS n FROM c WHERE NOT empty AND NOT coalesce(isnan(num), false) GROUP BY ALL),
            pair AS (
              SELECT b.load_id, b.column_name, h.txt, h.num, h.n AS a, 0 AS z, b.proper, b.pproper FROM b JOIN h ON h.load_id = b.load_id AND h.column_name = b.column_name WHERE b.proper > 0 AND b.pproper > 0
              UNION ALL
              SELECT b.load_id, b.column_name, h.txt, h.num, 0, h.n, b.proper, b.pproper FROM b JOIN h ON h.load_id = b.prior AND h.column_name = b.column_name WHERE b.proper > 0 AND b.pproper > 0),
            g AS (SELECT load_id, column_name, txt, num, proper, pproper, sum(a) AS a, sum(z) AS z FROM pair GROUP BY ALL),
            w AS (SELECT *, sum(a) OVER q AS ca, sum(z) OVER q AS cz FROM g WHERE txt IS NULL WINDOW q AS (PARTITION BY load_id, column_name ORDER BY num)),
            f AS (
              SELECT load_id, column_name, 'invalid' AS finding FROM s WHERE invalid * 50 > vals
              UNION ALL SELECT load_id, column_name, 'nulls' FROM b WHERE abs(nulls * ptotal - pnulls * total) * 100 > 15 * total * ptotal
              UNION ALL SELECT load_id, column_name, 'distinct' FROM b WHERE dist > 5 * pdist OR 5 * dist < pdist
              UNION ALL SELECT load_id, column_name, 'values' FROM w WHERE abs(ca * pproper - cz * proper) * 100 > 35 * proper * pproper
              UNION ALL SELECT load_id, column_name, 'values' FROM g WHERE txt IS NOT NULL GROUP BY load_id, column_name, proper, pproper
                        HAVING sum(abs(a * pproper - z * proper)) * 100 > 70 * proper * pproper)
            SELECT DISTINCT load_id, column_name, finding FROM f""",
        "p2_columns": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS nulls FROM runs"
            for c in ("record_id", "job_id", "case_id", "method", "information_policy", "device", "threads", "seed", "status", "pipeline_seconds", "matched_macro_f1", "onmi", "peak_tree_rss_bytes", "finished_at", "load_id")
        ),
        "p3_found": """
            WITH ok AS (SELECT file_id, payload FROM result_lines WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
            f AS (SELECT DISTINCT file_id, json_extract_string(payload, '$.record_id') AS rec, substr(t.fullkey, 3) AS path,
                    CASE WHEN t.type IN ('VARCHAR') THEN 'string' WHEN t.type = 'BOOLEAN' THEN 'boolean' WHEN t.type = 'ARRAY' THEN 'array' ELSE 'number' END AS kind, CAST(t.value AS VARCHAR) AS v
                  FROM ok, json_tree(ok.payload) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey NOT LIKE '%[%'),
            pr AS (SELECT file_id, path, min(kind) AS kind FROM f GROUP BY file_id, path),
            o AS (SELECT file_id, lag(file_id) OVER (PARTITION BY stream ORDER BY seq_no) AS prev FROM result_files),
            n AS (SELECT o.file_id, path, kind FROM o JOIN pr ON pr.file_id = o.file_id WHERE prev IS NOT NULL),
            b AS (SELECT o.file_id, path, kind FROM o JOIN pr ON pr.file_id = o.prev),
            e AS (SELECT * FROM b WHERE (file_id, path) NOT IN (SELECT file_id, path FROM n)),
            s AS (SELECT * FROM n WHERE (file_id, path) NOT IN (SELECT file_id, path FROM b)),
            ev AS (SELECT e.file_id, e.path, f.rec, f.kind || f.v AS v FROM e JOIN o ON o.file_id = e.file_id JOIN f ON f.file_id = o.prev AND f.path = e.path WHERE rec IS NOT NULL),
            sv AS (SELECT s.file_id, s.path, f.rec, f.kind || f.v AS v FROM s JOIN f ON f.file_id = s.file_id AND f.path = s.path WHERE rec IS NOT NULL),
            m AS (SELECT ev.file_id, ev.path AS old_path, sv.path AS new_path, count(DISTINCT rec) AS n, count(DISTINCT CASE WHEN ev.v = sv.v THEN rec END) AS same FROM ev JOIN sv USING (file_id, rec) GROUP BY ALL),
            r AS (SELECT file_id, old_path, new_path FROM m WHERE n = same)
            SELECT file_id, 'renamed' AS change, old_path, new_path FROM r
            UNION ALL SELECT file_id, 'removed', path, '' FROM e WHERE (file_id, path) NOT IN (SELECT file_id, old_path FROM r)
            UNION ALL SELECT file_id, 'added', '', path FROM s WHERE (file_id, path) NOT IN (SELECT file_id, new_path FROM r)
            UNION ALL SELECT n.file_id, 'retyped', n.path, n.path FROM n JOIN b ON n.file_id = b.file_id AND n.path = b.path WHERE n.kind <> b.kind""",
        "p5_found": _NESTED,
        "p5_orphans": "SELECT record_id, '' AS entity, '' AS position FROM run_records WHERE false",
        "p2_statuses": "SELECT DISTINCT status AS value FROM runs WHERE status IS NOT NULL",
        "p2_profile": _profile_sql(),
        "p2_loads": f"""
            WITH {_CELLS}
            SELECT load_id, column_name, count(*) AS n_rows, count(*) FILTER (WHERE empty) AS nulls,
                   count(DISTINCT coalesce(txt, CAST(num AS VARCHAR))) AS distinct_values,
                   count(*) FILTER (WHERE NOT empty AND NOT valid) AS invalid
            FROM c WHERE load_id IS NOT NULL GROUP BY load_id, column_name""",
    }
