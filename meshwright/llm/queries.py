"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import content, packing, percentiles, tokens
from meshwright.session import materialize, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.worse_than_reference(table(spark, d, "runs"), table(spark, d, "method_reference"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per method and metric over all days, from the days' sketches."""
    days = percentiles.sketches(percentiles.counted(percentiles.completed(table(spark, d, "runs"))), ["method", "metric", "run_date"])
    return percentiles.percentiles(percentiles.merge(days, ["method", "metric"]), ["method", "metric"], [10, 50, 90, 99])


def p4_load_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable sketch of each load, method, day and metric."""
    return percentiles.sketches(percentiles.counted(percentiles.completed(table(spark, d, "runs"))), ["load_id", "method", "run_date", "metric"])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text) decoded from the ids; null texts come back as empty ones."""
    return tokens.decode(materialize(p6_ids(spark, d), "ids"), tokens.byte_table(spark))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialize(tokens.token_counts(table(spark, d, "documents")), "sizes")
    return packing.pack(sizes, table(spark, d, "pack_containers"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used per class, with a lower bound that no packing can beat."""
    sizes = materialize(tokens.token_counts(table(spark, d, "documents")), "sizes")
    boxes = table(spark, d, "pack_containers")
    return packing.report(packing.pack(sizes, boxes), sizes, boxes)


def p7_validity(spark: SparkSession, d: str) -> DataFrame:
    """(container_class, documents, overfull, wrong): how many documents are packed, containers overfilled, documents cut wrongly."""
    sizes = materialize(tokens.token_counts(table(spark, d, "documents")), "sizes")
    boxes = table(spark, d, "pack_containers").withColumnRenamed("capacity_tokens", "cap")
    packed = materialize(packing.pack(sizes, table(spark, d, "pack_containers")), "packed")
    load = packed.groupBy("container_class", "container").agg(F.sum("tokens").alias("t")).join(boxes, "container_class")
    load = load.groupBy("container_class").agg(F.count_if(F.col("t") > F.col("cap")).alias("overfull"))
    docs = packed.groupBy("container_class", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"), F.max("piece").alias("m"))
    docs = docs.join(sizes, "doc_id").join(boxes, "container_class")
    right = (F.col("t") == F.col("tokens")) & (F.col("k") == F.col("m") + 1) & (F.col("k") == F.greatest(F.ceil(F.col("tokens") / F.col("cap")), F.lit(1)))
    docs = docs.groupBy("container_class").agg(F.count("*").alias("documents"), F.count_if(~right).alias("wrong"))
    return docs.join(load, "container_class").select("container_class", "documents", "overfull", "wrong")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return content.scored(docs, table(spark, d, "review_labels")).where("found").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return content.scored(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return content.source_rates(p8_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p4_found, p4_percentiles, p4_load_sketches, p6_ids, p6_decoded, p7_containers, p7_report, p7_validity, p8_found, p8_scores, p8_source_rates)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            WITH once AS (
              SELECT record_id, min(method) AS method, min(strftime(timezone('UTC', finished_at), '%Y-%m-%d')) AS run_date,
                     min(pipeline_seconds) AS s, min(matched_macro_f1) AS f
              FROM runs WHERE status = 'COMPLETED' AND finished_at IS NOT NULL GROUP BY record_id),
            v AS (
              SELECT method, run_date, 'pipeline_seconds' AS metric, s AS value FROM once WHERE isfinite(s) AND s >= 0
              UNION ALL
              SELECT method, run_date, 'matched_macro_f1', f FROM once WHERE isfinite(f) AND f BETWEEN 0 AND 1),
            c AS (
              SELECT v.method, v.run_date, v.metric, m.pct, m.reference_value, count(*) AS n,
                     count(*) FILTER (WHERE v.value <= m.reference_value) AS upto,
                     count(*) FILTER (WHERE v.value < m.reference_value) AS under
              FROM v JOIN (SELECT DISTINCT * FROM method_reference) m ON v.method = m.method AND v.metric = m.metric
              GROUP BY v.method, v.run_date, v.metric, m.pct, m.reference_value)
            SELECT DISTINCT method, run_date, metric, pct FROM c
            WHERE n >= 40 AND CASE WHEN metric = 'pipeline_seconds' THEN upto * 100 < pct * n ELSE under * 100 >= pct * n END""",
        "p7_validity": "SELECT container_class, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS wrong FROM pack_containers",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
