"""Percentiles per group from mergeable sketches, with an exact check near a threshold.

The sketches are randomized compactor hierarchies (KLL), built and merged by
Spark's native aggregates: buffers are sorted, alternate values move up a level
with twice the weight, and sketches of loads or days merge level by level. With
``k`` entries in the top buffer a rank is off by at most about 2.3 / k^0.97 of the
count, with 99 % probability; a group of up to k values is held exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.session import materialize

#: Entries of a sketch's top buffer: far below the counts of a day's group, so that sketches compact.
K = 200
GROUP = ["method", "run_date", "metric"]


def rank_error(k: int) -> float:
    """The normalized rank error that a sketch of size ``k`` keeps with 99 % probability."""
    return 2.296 / k**0.9723


def completed(runs: DataFrame) -> DataFrame:
    """(record_id, load_id, method, run_date, pipeline_seconds, matched_macro_f1), one row per completed record.

    Only rows of status COMPLETED (exactly) with a finished_at count; run_date is its
    UTC date, whatever the session's time zone. Deliveries of one record agree; should
    they not, the least by (load_id, values) is taken. A null record_id is one
    record. Other columns aren't read.
    """
    rows = runs.where((F.col("status") == "COMPLETED") & F.col("finished_at").isNotNull())
    fields = ["load_id", "method", "run_date", "pipeline_seconds", "matched_macro_f1"]
    day = F.date_from_unix_date(F.floor(F.unix_seconds("finished_at") / 86400).cast("int"))
    rows = rows.withColumn("run_date", day.cast("string"))
    return rows.groupBy("record_id").agg(F.min(F.struct(*fields)).alias("r")).select("record_id", "r.*")


def counted(records: DataFrame) -> DataFrame:
    """(method, run_date, load_id, metric, value): the values that count.

    pipeline_seconds must be finite and >= 0, matched_macro_f1 from 0 to 1; nulls,
    NaN and the rest are left out.
    """
    s, f = F.col("pipeline_seconds"), F.col("matched_macro_f1")
    good_s = F.when(~F.isnan(s) & (s >= 0) & (s < float("inf")), s)
    good_f = F.when(~F.isnan(f) & f.between(0, 1), f)
    cells = F.array(F.struct(F.lit("pipeline_seconds").alias("metric"), good_s.alias("value")), F.struct(F.lit("matched_macro_f1").alias("metric"), good_f.alias("value")))
    return records.select("method", "run_date", "load_id", F.inline(cells)).where(F.col("value").isNotNull())


def sketches(values: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """(by, n, sketch): one KLL sketch per group; partial sketches are merged after the shuffle."""
    made = values.groupBy(*by).agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))
    return made.withColumn("n", F.kll_sketch_get_n_double("sketch"))


def merge(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Sketches of parts (loads, days) combined into one per group; the error bound stays."""
    made = parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return made.withColumn("n", F.kll_sketch_get_n_double("sketch"))


def percentiles(sketched: DataFrame, by: list[str], pcts: list[int], k: int = K, errors: float = 1.0) -> DataFrame:
    """(by, n, pct, value, low, high): each percentile, with bounds ``errors`` rank errors away."""
    e = errors * rank_error(k)
    ranks = [min(max(p / 100.0 + d, 0.0), 1.0) for p in pcts for d in (0.0, -e, e)]
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ranks)))
    rows = sketched.where(F.col("n") > 0).select(*by, "n", at.alias("at"))
    cells = [F.struct(F.lit(p).alias("pct"), *(F.col("at")[3 * i + j].alias(c) for j, c in enumerate(("value", "low", "high")))) for i, p in enumerate(pcts)]
    return rows.select(*by, "n", F.inline(F.array(*cells)))


def worse_than_reference(runs: DataFrame, reference: DataFrame, k: int = K, least: int = 40, sure: float = 4.0) -> DataFrame:
    """(method, run_date, metric, pct) of the percentiles that are worse than their reference.

    A percentile is the smallest counted value with at least pct % of the values at
    or below it; it is worse if above the reference for pipeline_seconds, below it
    for matched_macro_f1. Groups of fewer than ``least`` values are left out; null
    references give no case, and repeated ones count once.

    The sketch brackets the percentile between the values ``sure`` rank errors to
    either side. Where the reference lies outside the bracket the case is decided;
    the groups in between, and only those, have their values on either side of it
    counted exactly.
    """
    values = materialize(counted(completed(runs)).select(*GROUP, "value"), "values")
    wanted = reference.where(F.col("reference_value").isNotNull() & F.col("pct").between(0, 100)).select("method", "metric", "pct", "reference_value").distinct()
    pcts = sorted(r["pct"] for r in wanted.select("pct").distinct().collect())  # at most 101 whole numbers
    if not pcts:
        return wanted.select("method", F.lit("").alias("run_date"), "metric", "pct")
    made = sketches(values, GROUP, k).where(F.col("n") >= least)
    asked = percentiles(made, GROUP, pcts, k, sure).join(wanted, ["method", "metric", "pct"])
    slow, ref = F.col("metric") == "pipeline_seconds", F.col("reference_value")
    above = F.when(F.col("low") > ref, True).when(F.col("high") <= ref, False)
    below = F.when(F.col("high") < ref, True).when(F.col("low") >= ref, False)
    decided = materialize(asked.select(*GROUP, "pct", "reference_value", F.when(slow, above).otherwise(below).alias("worse")), "asked")
    close = decided.where(F.col("worse").isNull()).drop("worse")
    counts = values.join(close, GROUP).groupBy(*GROUP, "pct", "reference_value").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") <= ref).alias("upto"), F.count_if(F.col("value") < ref).alias("under")
    )
    exact = counts.where(F.when(slow, F.col("upto") * 100 < F.col("pct") * F.col("n")).otherwise(F.col("under") * 100 >= F.col("pct") * F.col("n")))
    return decided.where("worse").select(*GROUP, "pct").unionByName(exact.select(*GROUP, "pct")).distinct()
