"""Comparison reports over run records that keep every planned row in the denominator.

Ratios and differences exist only where both sides completed; nothing is imputed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators.ordered import percentiles
from meshwright.session import materialize

PANEL = ["case_id", "information_policy", "device", "threads", "seed"]


def one_per_record(runs: DataFrame) -> DataFrame:
    """One row per record_id of records delivered again: the one of the latest load, then the latest finish."""
    cols = [c for c in runs.columns if c != "record_id"]
    best = F.max(F.struct(F.coalesce("load_id", F.lit(-1)).alias("_l"), F.struct(*cols).alias("r")))
    return runs.groupBy("record_id").agg(best.alias("b")).select("record_id", "b.r.*")


def chosen_attempt(runs: DataFrame) -> DataFrame:
    """The first record of each method in each panel: the least record_id; nulls in a panel's columns are values."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in PANEL]
    r = one_per_record(runs).select("record_id", "method", "status", "pipeline_seconds", "matched_macro_f1", *key)
    best = F.min(F.struct("record_id", "status", "pipeline_seconds", "matched_macro_f1"))
    return r.groupBy("method", *PANEL).agg(best.alias("b")).select("method", *PANEL, "b.*")


def sound(seconds: str = "pipeline_seconds", f1: str = "matched_macro_f1") -> Column:
    """Completed with a positive finite time and a score from 0 to 1."""
    s, f = F.col(seconds), F.col(f1)
    return F.coalesce((F.col("status") == "COMPLETED") & ~F.isnan(s) & (s > 0) & (s < float("inf")) & ~F.isnan(f) & f.between(0, 1), F.lit(False))


def paired_runs(runs: DataFrame) -> DataFrame:
    """(panel, reference, comparison, basis, ratio, delta) of all method pairs within a panel, reference < comparison.

    ``ratio`` is comparison / reference time, ``delta`` comparison - reference score;
    both null unless both completed and scored. A panel holds at most one row a method.
    """
    a = chosen_attempt(runs).withColumn("ok", sound())
    left = a.select(*PANEL, F.col("method").alias("reference"), F.col("pipeline_seconds").alias("s0"), F.col("matched_macro_f1").alias("f0"), F.col("ok").alias("ok0"))
    right = a.select(*PANEL, F.col("method").alias("comparison"), F.col("pipeline_seconds").alias("s1"), F.col("matched_macro_f1").alias("f1"), F.col("ok").alias("ok1"))
    j = left.join(right, PANEL).where("reference < comparison")
    ok = F.col("ok0") & F.col("ok1")
    basis = F.when(ok, "both_completed_and_scored").otherwise("not_both_completed_and_scored")
    return j.select(*PANEL, "reference", "comparison", basis.alias("basis"), F.when(ok, F.col("s1") / F.col("s0")).alias("ratio"), F.when(ok, F.col("f1") - F.col("f0")).alias("delta"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """(reference, comparison, planned, both, better_and_faster, median_ratio, median_delta) over all panels."""
    good = (F.col("delta") >= 0) & (F.col("ratio") < 1)
    pairs = materialize(pairs, "pairs")
    counts = pairs.groupBy("reference", "comparison").agg(
        F.count("*").alias("planned"), F.count("ratio").alias("both"), F.count_if(good).alias("better_and_faster")
    )
    key = ["reference", "comparison"]
    ratio = percentiles(pairs, key, "ratio", [0.5]).select(*key, F.col("p_0").alias("median_ratio"))
    delta = percentiles(pairs, key, "delta", [0.5]).select(*key, F.col("p_0").alias("median_delta"))
    return counts.join(ratio, key, "left").join(delta, key, "left")


def arm_comparison(runs: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(comparison, case_id, seed, status_a, status_b, delta) for a fixed list of (name, arm a, arm b).

    Every case and seed of either arm has a row; the delta of times is null unless
    both completed. Of several records of an arm the least record_id counts.
    """
    r = one_per_record(runs).where(F.col("case_id").isNotNull() & F.col("seed").isNotNull())
    r = r.groupBy("method", "case_id", "seed").agg(F.min(F.struct("record_id", "status", "pipeline_seconds")).alias("b")).select("method", "case_id", "seed", "b.*")
    out = []
    for name, a, b in pairs:
        left = r.where(F.col("method") == a).select("case_id", "seed", F.col("status").alias("status_a"), F.col("pipeline_seconds").alias("s0"))
        right = r.where(F.col("method") == b).select("case_id", "seed", F.col("status").alias("status_b"), F.col("pipeline_seconds").alias("s1"))
        j = left.join(right, ["case_id", "seed"], "full_outer")
        done = (F.col("status_a") == "COMPLETED") & (F.col("status_b") == "COMPLETED") & ~F.isnan("s0") & ~F.isnan("s1")
        out.append(j.select(F.lit(name).alias("comparison"), "case_id", "seed", "status_a", "status_b", F.when(done, F.col("s1") - F.col("s0")).alias("delta")))
    return reduce(DataFrame.unionByName, out)


def planned_runs(cases: DataFrame, methods: DataFrame, runs: DataFrame) -> DataFrame:
    """(method, planned, completed, failed, not_run) with every case planned for every method.

    A case counts as completed for a method if any of its records did, as failed if
    it has records but none completed. ``methods`` is a catalogue of a fixed number of
    rows; its names are laid out beside every case.
    """
    names = sorted(r["method"] for r in methods.where(F.col("method").isNotNull()).select("method").distinct().collect())
    plan = cases.select("case_id").distinct().select("case_id", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("method"))
    done = runs.where(F.col("case_id").isNotNull()).groupBy("case_id", "method").agg(F.max(F.coalesce(F.col("status") == "COMPLETED", F.lit(False))).alias("ok"))
    j = plan.join(done, ["case_id", "method"], "left")
    return j.groupBy("method").agg(F.count("*").alias("planned"), F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("not_run"))


def unplanned_runs(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(case_id, n) of run rows whose case isn't in the catalogue; none if the plan covers them all."""
    return runs.join(cases.select("case_id"), "case_id", "left_anti").groupBy("case_id").agg(F.count("*").alias("n"))


def panel_summary(runs: DataFrame, measure: str = "pipeline_seconds") -> DataFrame:
    """(method, device, threads, level, n, completed, low, middle, high) over grouping sets.

    Groups: all, each method, method and device, method and threads. Only sound rows
    of completed records count for low, middle (the exact median) and high.
    """
    r = one_per_record(runs).select("method", "device", "threads", F.when(sound(), F.col(measure)).alias("x"), (F.col("status") == "COMPLETED").alias("c"))
    r = materialize(r, "panel")
    counts = r.sparkSession.sql("""
        SELECT method, device, threads, grouping_id() AS level, count(*) AS n, count_if(c) AS completed, min(x) AS low, max(x) AS high
        FROM {rows}
        GROUP BY method, device, threads GROUPING SETS ((), (method), (method, device), (method, threads))""", rows=r)
    kinds = [(7, ()), (3, ("method",)), (1, ("method", "device")), (2, ("method", "threads"))]
    labels = F.array(*(F.struct(F.lit(k).cast("bigint").alias("level"), *((F.col(c) if c in own else F.lit(None).cast(r.schema[c].dataType)).alias(c) for c in ("method", "device", "threads"))) for k, own in kinds))
    middle = percentiles(r.where("x IS NOT NULL").select("x", F.inline(labels)), ["level", "method", "device", "threads"], "x", [0.5])
    a, b = counts.alias("a"), middle.alias("b")
    on = F.col("a.level") == F.col("b.level")
    for c in ("method", "device", "threads"):
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on, "left").select("a.method", "a.device", "a.threads", "a.level", "a.n", "completed", "low", F.col("p_0").alias("middle"), "high")


def status_counts(runs: DataFrame) -> DataFrame:
    """(method, status, n); null statuses are a value of their own."""
    return runs.groupBy("method", "status").agg(F.count("*").alias("n"))


def gates(pairs: DataFrame, least: int = 12) -> DataFrame:
    """(reference, comparison, seed, n, median_saving, mean_delta, passed): strata with enough complete pairs.

    Saving is 1 - ratio. Median and mean are null, and the gate undecided, unless at
    least ``least`` pairs of the stratum are planned and all of them complete; it
    passes with a saving above 0 and a mean score loss of at most 0.01.
    """
    key = ["reference", "comparison", "seed"]
    pairs = materialize(pairs.select(*key, (1 - F.col("ratio")).alias("saving"), "delta"), "pairs")
    s = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.count("saving").alias("k"), F.avg("delta").alias("md"))
    s = s.join(percentiles(pairs, key, "saving", [0.5]).select(*key, F.col("p_0").alias("ms")), key, "left")
    whole = (F.col("n") >= least) & (F.col("n") == F.col("k"))
    ms, md = F.when(whole, F.col("ms")), F.when(whole, F.col("md"))
    return s.select("reference", "comparison", "seed", "n", ms.alias("median_saving"), md.alias("mean_delta"), ((ms > 0) & (md >= -0.01)).alias("passed"))


def first_crossings(trace: DataFrame, levels: list[float]) -> DataFrame:
    """(job_id, level, epoch, elapsed): the first saved epoch whose f1 reaches each level; no interpolation.

    Repeated rows and any order are fine; null and NaN scores never cross. Jobs that
    don't reach a level have no row for it. Of rows of one epoch the least elapsed
    counts.
    """
    t = trace.where(F.col("f1").isNotNull() & ~F.isnan("f1") & F.col("epoch").isNotNull())
    t = t.select("job_id", "epoch", "elapsed", "f1", F.explode(F.array(*map(F.lit, levels))).alias("level")).where("f1 >= level")
    clean = F.when(~F.isnan("elapsed"), F.col("elapsed"))
    return t.groupBy("job_id", "level").agg(F.min(F.struct("epoch", F.coalesce(clean, F.lit(float("inf"))).alias("e"))).alias("b")).select("job_id", "level", F.col("b.epoch").alias("epoch"), F.when(F.col("b.e") < float("inf"), F.col("b.e")).alias("elapsed"))


def trace_selection(trace: DataFrame) -> DataFrame:
    """(job_id, epoch, f1): the epoch of the least loss, the earliest of equal ones; null and NaN losses never count."""
    t = trace.where(F.col("loss").isNotNull() & ~F.isnan("loss") & F.col("epoch").isNotNull())
    return t.groupBy("job_id").agg(F.min(F.struct("loss", "epoch", F.coalesce(F.when(~F.isnan("f1"), F.col("f1")), F.lit(-1.0)).alias("f"))).alias("b")).select("job_id", F.col("b.epoch").alias("epoch"), F.when(F.col("b.f") >= 0, F.col("b.f")).alias("f1"))


def trace_bounds(trace: DataFrame, every: int = 50) -> DataFrame:
    """(job_id, last, checks, gaps, low, high): bounds on a job's updates from its saved epochs.

    ``gaps`` counts checks of the grid 0, every, ... up to the last that weren't saved;
    the job ended at or after its last epoch and before the next check.
    """
    e = trace.where(F.col("epoch").isNotNull()).select("job_id", "epoch").distinct()
    s = e.groupBy("job_id").agg(F.max("epoch").alias("last"), F.count("*").alias("checks"), F.count_if(F.col("epoch") % every == 0).alias("k"))
    gaps = F.floor(F.col("last") / every).cast("bigint") + 1 - F.col("k")
    return s.select("job_id", "last", "checks", gaps.alias("gaps"), F.col("last").alias("low"), (F.col("last") + every - 1).alias("high"))


def cost_slope(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """(method, n, slope, intercept) of log10 seconds on log10 vertices over sound completed records."""
    r = one_per_record(runs).where(sound()).join(cases.where("n_vertices > 0").select("case_id", "n_vertices").distinct(), "case_id")
    y, x = F.log10("pipeline_seconds"), F.log10("n_vertices")
    return r.groupBy("method").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def workload_totals(runs: DataFrame, lengths: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(method, case_id, k, cost): time of the first k seeds of a case together; null unless all k completed.

    Of several records of a seed the least record_id counts; cases of fewer seeds
    have no row for k.
    """
    r = one_per_record(runs).where(F.col("case_id").isNotNull() & F.col("seed").isNotNull())
    r = r.groupBy("method", "case_id", "seed").agg(F.min(F.struct("record_id", "status", "pipeline_seconds", "matched_macro_f1")).alias("b")).select("method", "case_id", "seed", "b.*")
    w = Window.partitionBy("method", "case_id").orderBy("seed")
    r = r.withColumn("i", F.row_number().over(w)).withColumn("ok", sound()).select("method", "case_id", "i", "ok", "pipeline_seconds", F.explode(F.array(*map(F.lit, lengths))).alias("k")).where("i <= k")
    s = r.groupBy("method", "case_id", "k").agg(F.count("*").alias("n"), F.count_if("ok").alias("c"), F.sum("pipeline_seconds").alias("t")).where("n = k")
    return s.select("method", "case_id", "k", F.when(F.col("c") == F.col("k"), F.col("t")).alias("cost"))


def model_selection(runs: DataFrame) -> DataFrame:
    """(case_id, method, score, gap): the method of the best mean score per case and its lead over the next.

    Ties go to the first method by name; the lead is null where there is no other.
    """
    m = one_per_record(runs).where(sound()).groupBy("case_id", "method").agg(F.avg("matched_macro_f1").alias("score"))
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "method")
    r = m.withColumn("next", F.lead("score").over(w)).withColumn("i", F.row_number().over(w)).where("i = 1")
    return r.select("case_id", "method", "score", (F.col("score") - F.col("next")).alias("gap"))


def inconsistent_records(runs: DataFrame) -> DataFrame:
    """(record_id, versions) of records whose deliveries differ in more than the load."""
    fields = [c for c in runs.columns if c not in ("record_id", "load_id")]
    v = runs.select("record_id", F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in fields)).alias("h"))
    return v.groupBy("record_id").agg(F.count_distinct("h").alias("versions")).where("versions > 1")


def backend_choice(runs: DataFrame) -> DataFrame:
    """(method, completed, cost): the eligible method that completes most, then costs least, then comes first by name."""
    s = one_per_record(runs).groupBy("method").agg(F.count_if(sound()).alias("completed"), F.sum(F.when(sound(), F.col("pipeline_seconds"))).alias("cost"))
    return s.where("completed > 0").orderBy(F.desc("completed"), "cost", "method").limit(1)


def log_stages(docs: DataFrame) -> DataFrame:
    """(doc_id, position, stage, elapsed) of every ``stage='..' elapsed=..`` in a text, in order."""
    hit = r"stage='([^'\n]*)' elapsed=([0-9]+(?:\.[0-9]+)?)"
    d = docs.where(F.col("text").contains("elapsed=")).select("doc_id", F.regexp_extract_all("text", F.lit(hit), F.lit(1)).alias("s"), F.regexp_extract_all("text", F.lit(hit), F.lit(2)).alias("e"))
    z = d.select("doc_id", F.posexplode(F.arrays_zip("s", "e")).alias("position", "x"))
    return z.select("doc_id", "position", F.col("x.s").alias("stage"), F.col("x.e").cast("double").alias("elapsed"))


def quality_bins(runs: DataFrame) -> DataFrame:
    """(method, bin, n) of sound scores: [0, .5), [.5, .9), [.9, 1), 1."""
    f = F.col("matched_macro_f1")
    b = F.when(f < 0.5, "[0,.5)").when(f < 0.9, "[.5,.9)").when(f < 1, "[.9,1)").otherwise("1")
    return one_per_record(runs).where(sound()).groupBy("method", b.alias("bin")).agg(F.count("*").alias("n"))


def score_differences(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(keys, field, a, b) where two tables of scores differ by more than ``tolerance``, or one lacks the row or value."""

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields))
        return df.select(*keys, F.inline(cells))

    j = long(a, "a").join(long(b, "b"), [*keys, "field"], "full_outer")
    same = (F.col("a").isNull() & F.col("b").isNull()) | (F.abs(F.col("a") - F.col("b")) <= tolerance)
    return j.where(~F.coalesce(same, F.lit(False))).select(*keys, "field", "a", "b")


def suite_table(cases: DataFrame, part: str, fields: str, key: str = "case_id") -> DataFrame:
    """(key, place, fields...) of the objects in one list of each case's JSON ``payload``, with their place in it.

    ``fields`` is the objects' schema as text. A case whose payload isn't an object,
    or that lacks the list, gives no row; a null element keeps its place and gives none.
    """
    listed = F.from_json("payload", f"struct<{part}:array<struct<{fields}>>>")[part]
    rows = cases.select(key, F.posexplode(listed).alias("place", "row")).where(F.col("row").isNotNull())
    return rows.select(key, "place", "row.*")


def suite_mismatches(cases: DataFrame, rows: DataFrame, stored: str, derived: Column, key: str = "case_id", tolerance: float = 1e-9) -> DataFrame:
    """(key, stored, derived) of the cases whose stored value isn't what their rows give; a case without rows derives null.

    ``stored`` is a number in the payload, ``derived`` an aggregate over the flat rows.
    """
    said = cases.select(key, F.get_json_object("payload", f"$.{stored}").cast("double").alias("stored"))
    made = rows.groupBy(key).agg(derived.cast("double").alias("derived"))
    both = said.join(made, key, "left")
    same = F.abs(F.col("stored") - F.col("derived")) <= tolerance * F.greatest(F.abs("stored"), F.lit(1.0))
    return both.where(~F.coalesce(same, F.col("stored").isNull() & F.col("derived").isNull()))
