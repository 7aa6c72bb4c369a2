"""Column-level quality of a table that arrives in loads.

Row groups are profiled one a task: footers settle what they can, dictionaries give
the distinct texts, and only the other column chunks are scanned (see ``chunks``). A
first pass gives exact nulls and invalid values, bounds on distinct counts and coarse
histograms; loads that those leave open are counted value by value in a second one.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BooleanType, DatetimeType, DecimalType, DoubleType, FloatType, IntegralType, LongType, NumericType, StructType

from meshwright.operators import chunks
from meshwright.operators.footers import chunk_statistics, dictionary_values
from meshwright.session import materialize


@dataclass(frozen=True)
class Rule:
    """What is expected of a column: ``numeric`` columns have ``low`` and ``high``, others a ``vocabulary``.

    Without a vocabulary any text is valid.
    """

    column: str
    numeric: bool = True
    low: float = 0.0
    high: float = 1.0
    vocabulary: tuple[str, ...] = field(default=())

    def valid(self, value: Column) -> Column:
        if not self.numeric:
            return value.isin(*self.vocabulary) if self.vocabulary else value.isNotNull()
        return ~F.isnan(value) & (value >= self.low) & (value <= self.high)


#: Buckets per unit of ln(1 + |x|): neighbours differ by about 1 part in 2,000.
_FINE = 2048


def order_bucket(x: Column) -> Column:
    """An integer that never falls as ``x`` grows; about relative width 1 / 2048 (absolute below 1)."""
    return (F.signum(x) * F.floor(F.log1p(F.abs(x)) * _FINE)).cast("long")


def every_rule(schema: StructType, rules: list[Rule]) -> list[Rule]:
    """The rules and, for each column without one, a rule that takes every value but NaN for valid.

    Times and booleans count as numbers; what is neither number nor text is compared as text.
    """
    ruled = {r.column for r in rules}
    free = [
        Rule(f.name, isinstance(f.dataType, (NumericType, DatetimeType, BooleanType)), -math.inf, math.inf)
        for f in schema.fields
        if f.name not in ruled
    ]
    return rules + free


def _number(df: DataFrame, name: str) -> Column:
    c, kind = F.col(name), df.schema[name].dataType
    return (c.cast("timestamp") if isinstance(kind, DatetimeType) else c).cast("double")


def _beyond(df: DataFrame, name: str) -> Column:
    """The digits of whole numbers and decimals that doubles don't tell apart, else null."""
    none = F.lit(None).cast("string")
    if not isinstance(df.schema[name].dataType, (LongType, DecimalType)):
        return none
    c = F.col(name)
    exact = (c >= -(2**53)) & (c <= 2**53) if isinstance(df.schema[name].dataType, LongType) else F.lit(False)
    return F.when(c.isNotNull() & ~exact, c.cast("string"))


def _unpivot(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, column, number, text): one row per row and column; a number has text only where doubles aren't exact."""
    cells = [
        F.struct(F.lit(r.column).alias("column"), (_number(df, r.column) if r.numeric else F.lit(None).cast("double")).alias("number"), (_beyond(df, r.column) if r.numeric else F.col(r.column).cast("string")).alias("text"))
        for r in rules
    ]
    return df.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*")


def _columns(rules: list[Rule]) -> list[chunks.Column]:
    return [chunks.Column(r.column, r.numeric, r.low, r.high, frozenset(r.vocabulary)) for r in rules]


def _by_chunks(table: DataFrame, key: str, rules: list[Rule]) -> tuple[list[Rule], list[Rule]]:
    """The rules whose columns are profiled by row groups, and the others, which Spark scans."""
    if not isinstance(table.schema[key].dataType, IntegralType):
        return [], rules
    own = [r for r in rules if chunks.readable(table.schema[r.column].dataType)]
    return own, [r for r in rules if r not in own]


def _named(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """Column numbers become names."""
    return rows.withColumnRenamed("key", key).withColumn("column", F.element_at(F.array(*(F.lit(r.column) for r in rules)), F.col("at") + 1)).drop("at")


def histogram(spark: SparkSession, path: str, key: str, rules: list[Rule], keep: list[int] | None = None) -> DataFrame:
    """(key, column, number, text, n): how often each value occurs per key; null cells have both null.

    Rows with a null key belong to no load and are left out, as are keys not in
    ``keep``, if given. NaN is one value. Chunks that footers settle are not read.
    """
    table = spark.read.parquet(path)
    own, rest = _by_chunks(table, key, rules)
    parts = []
    if own:
        parts.append(_named(chunks.exact(spark, path, key, _columns(own), keep), key, own).select(key, "column", "number", "text", "n"))
    if rest:
        rows = table.where(F.col(key).isNotNull() if keep is None else F.col(key).isin(keep))
        parts.append(_unpivot(rows, key, rest).groupBy(key, "column", "number", "text").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def load_statistics(cells: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, column, total, nulls, values, proper, distinct, invalid, low, high, low_text, high_text) per key and column.

    ``proper`` counts values that are neither null nor NaN; ``low`` and ``high`` are
    their extremes in columns of numbers, ``low_text`` and ``high_text`` in others.
    """
    empty = F.col("number").isNull() & F.col("text").isNull()
    valid = F.coalesce(*(F.when(F.col("column") == r.column, r.valid(F.col("number") if r.numeric else F.col("text"))) for r in rules))
    nan = F.coalesce(F.isnan("number"), F.lit(False))
    n = F.col("n")
    return cells.groupBy(key, "column").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(empty, n).otherwise(0)).alias("nulls"),
        F.sum(F.when(~empty, n).otherwise(0)).alias("values"),
        F.sum(F.when(~empty & ~nan, n).otherwise(0)).alias("proper"),
        F.count_if(~empty).alias("distinct"),
        F.sum(F.when(~empty & ~valid, n).otherwise(0)).alias("invalid"),
        F.min(F.when(~nan, F.col("number"))).alias("low"),
        F.max(F.when(~nan, F.col("number"))).alias("high"),
        F.min(F.when(F.col("number").isNull(), F.col("text"))).alias("low_text"),
        F.max(F.when(F.col("number").isNull(), F.col("text"))).alias("high_text"),
    )


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def _pairs(cells: DataFrame, key: str, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(load, column, *by, a, b): counts of each value in a load and in the one before it.

    ``sizes`` has (load, prior, column, na, nb) of the pairs to compare.
    """
    own = cells.withColumnRenamed(key, "load").join(sizes.select("load", "column"), ["load", "column"], "left_semi").select("load", "column", *by, F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    before = cells.withColumnRenamed(key, "prior").join(sizes.select("load", "prior", "column"), ["prior", "column"]).select("load", "column", *by, F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    return own.unionByName(before).groupBy("load", "column", *by).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _gap(a: str, b: str) -> Column:
    return F.abs(_wide(a).cast("decimal(38,0)") * _wide("nb") - _wide(b).cast("decimal(38,0)") * _wide("na")).cast("decimal(38,0)")


def _most(limit: float) -> Column:
    return (F.lit(limit).cast("decimal(6,4)") * (_wide("na") * _wide("nb")).cast("decimal(32,0)")).cast("decimal(38,4)")


def bucket_gaps(counts: DataFrame, key: str, sizes: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """What counts (key, column, bucket, n) say about the gap between two loads' shares of values <= x.

    First (load, column) of the pairs whose shares differ by more than ``limit`` at
    some bucket's end. Then (load, column, bucket, na, nb, a0, b0) of the buckets of
    the others inside which they might, with what both loads have before it.
    """
    sizes = sizes.where((F.col("na") > 0) & (F.col("nb") > 0))
    level = _pairs(counts, key, sizes, ["bucket"]).join(sizes.drop("prior"), ["load", "column"])
    w = Window.partitionBy("load", "column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    level = level.withColumn("ca", F.sum("a").over(w)).withColumn("cb", F.sum("b").over(w)).withColumn("over", _gap("ca", "cb") > _most(limit))
    # a slack far above rounding error keeps the bound safe
    start = F.abs((F.col("ca") - F.col("a")) / F.col("na") - (F.col("cb") - F.col("b")) / F.col("nb"))
    level = level.withColumn("open", start + F.greatest(F.col("a") / F.col("na"), F.col("b") / F.col("nb")) > limit - 1e-9)
    level = materialize(level.where(F.col("over") | F.col("open")), "gaps")
    sure = level.where("over").select("load", "column").distinct()
    inside = level.where("open").join(sure, ["load", "column"], "left_anti")
    return sure, inside.select("load", "column", "bucket", "na", "nb", (F.col("ca") - F.col("a")).alias("a0"), (F.col("cb") - F.col("b")).alias("b0"))


def greatest_gap(cells: DataFrame, key: str, sizes: DataFrame, limit: float) -> DataFrame:
    """(load, column) of the pairs whose shares of values <= x differ by more than ``limit`` at some x.

    Two levels keep any one task small, however large a load is: counts per bucket
    of the number line give the gap at every bucket's end, and a bound on it inside;
    only values of buckets that could exceed the limit inside are then looked at.
    """
    numbers = cells.where(F.col("number").isNotNull() & ~F.isnan("number")).withColumn("bucket", order_bucket(F.col("number")))
    sure, inside = bucket_gaps(numbers.groupBy(key, "column", "bucket").agg(F.sum("n").alias("n")), key, sizes, limit)
    some = sizes.join(inside.select("load", "column").distinct(), ["load", "column"], "left_semi")
    fine = _pairs(numbers.select(key, "column", "bucket", "number", "n"), key, some, ["bucket", "number"]).join(inside, ["load", "column", "bucket"])
    v = Window.partitionBy("load", "column", "bucket").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumn("ca", F.col("a0") + F.sum("a").over(v)).withColumn("cb", F.col("b0") + F.sum("b").over(v)).where(_gap("ca", "cb") > _most(limit))
    return sure.unionByName(fine.select("load", "column")).distinct()


def category_gap(cells: DataFrame, key: str, sizes: DataFrame, limit: float) -> DataFrame:
    """(load, column) of the pairs with half the summed absolute share differences above ``limit``."""
    sizes = sizes.where((F.col("na") > 0) & (F.col("nb") > 0))
    each = _pairs(cells.where(F.col("text").isNotNull()), key, sizes, ["text"]).join(sizes.drop("prior"), ["load", "column"])
    apart = F.abs(F.col("a").cast("decimal(38,0)") * F.col("nb") - F.col("b").cast("decimal(38,0)") * F.col("na")).cast("decimal(30,0)")
    total = each.groupBy("load", "column", "na", "nb").agg(F.sum(apart).alias("apart"))
    most = (F.lit(2 * limit).cast("decimal(6,4)") * (_wide("na") * _wide("nb")).cast("decimal(32,0)")).cast("decimal(38,4)")
    return total.where(F.col("apart") > most).select("load", "column")


def findings(
    spark: SparkSession, path: str, loads: DataFrame, rules: list[Rule], key: str = "load_id", prior: str = "prior_load_id",
    invalid: float = 0.02, nulls: float = 0.15, distinct: int = 5, values: float = 0.35,
) -> DataFrame:
    """(key, column_name, finding) of the loads that aren't as they should be or as the load before.

    ``invalid``: more than that share of the non-null values breaks the column's
    rule. Against the load named in ``prior``: ``nulls`` and ``values`` are
    differences in shares, ``distinct`` is a factor. A load without rows, without a
    prior load or whose prior load has no rows is compared with nothing; if one of
    the two has no values, only ``nulls`` and ``distinct`` are compared. A load
    listed twice counts once.
    """
    table = spark.read.parquet(path)
    own, rest = _by_chunks(table, key, rules)
    numeric = [r.column for r in rules if r.numeric]
    text = [r.column for r in rules if not r.numeric]
    chain = loads.where(F.col(prior).isNotNull()).select(F.col(key).cast("long").alias("load"), F.col(prior).cast("long").alias("prior")).distinct()
    parts: list[DataFrame] = []
    if rest:
        # columns of other types: value by value
        cells = materialize(histogram(spark, path, key, rest), "cells")
        stats = load_statistics(cells, key, rest).withColumn("lo", F.col("distinct")).withColumn("hi", F.col("distinct"))
        stats = materialize(stats.select(key, "column", "total", "nulls", "values", "proper", "invalid", "lo", "hi"), "loads")
        both, found = _compared(stats, chain, key, invalid, nulls, distinct)
        sizes = _sizes(both)
        parts += [found, greatest_gap(cells, key, sizes.where(F.col("column").isin(numeric)), values).withColumn("finding", F.lit("values"))]
        parts.append(category_gap(cells, key, sizes.where(F.col("column").isin(text)), values).withColumn("finding", F.lit("values")))
    if own:
        seen = materialize(_named(chunks.bounds(spark, path, key, _columns(own)), key, own), "bounds")
        # texts are counted one by one already, so their distinct values are known
        words = seen.where(F.col("text").isNotNull()).groupBy(key, "column").agg(F.count("*").alias("k"))
        total = seen.where(F.col("bucket").isNull() & F.col("text").isNull()).join(words, [key, "column"], "left")
        stats = total.select(
            key, "column", F.col("n").alias("total"), "nulls", (F.col("n") - F.col("nulls")).alias("values"), (F.col("n") - F.col("nulls") - F.col("nan")).alias("proper"), "invalid",
            F.coalesce("k", "low").alias("lo"), F.coalesce("k", "high").alias("hi"),
        )
        both, found = _compared(materialize(stats, "loads"), chain, key, invalid, nulls, distinct)
        both = materialize(both, "both")
        sizes = _sizes(both)
        parts += [found, category_gap(seen, key, sizes.where(F.col("column").isin(text)), values).withColumn("finding", F.lit("values"))]
        sure, inside = bucket_gaps(seen.where(F.col("bucket").isNotNull()).select(key, "column", "bucket", "n"), key, sizes.where(F.col("column").isin(numeric)), values)
        parts.append(sure.withColumn("finding", F.lit("values")))
        # what the bounds leave open, counted value by value
        unsure = both.where(~_more("lo", "p_hi", distinct) & ~_more("p_lo", "hi", distinct) & (_more("hi", "p_lo", distinct) | _more("p_hi", "lo", distinct)))
        asked = unsure.select("load", "column", F.lit("distinct").alias("finding")).unionByName(inside.select("load", "column", F.lit("values").alias("finding")).distinct())
        asked = materialize(asked.join(sizes, ["load", "column"]), "asked")
        names = {r["column"] for r in asked.select("column").distinct().collect()}
        left = [r for r in own if r.column in names]
        if left:
            # ids of loads alone, at most two for each load that is open
            keep = [r["k"] for r in asked.select(F.explode(F.array("load", "prior")).alias("k")).distinct().collect()]
            cells = materialize(histogram(spark, path, key, left, keep), "cells")
            count = cells.where(F.col("number").isNotNull() | F.col("text").isNotNull()).groupBy(key, "column").agg(F.count("*").alias("k"))
            pair = asked.where("finding = 'distinct'").join(count.select(F.col(key).alias("load"), "column", F.col("k").alias("lo")), ["load", "column"], "left")
            pair = pair.join(count.select(F.col(key).alias("prior"), "column", F.col("k").alias("p_lo")), ["prior", "column"], "left").fillna(0, ["lo", "p_lo"])
            parts.append(pair.where(_more("lo", "p_lo", distinct) | _more("p_lo", "lo", distinct)).select("load", "column", "finding"))
            spread = asked.where("finding = 'values'").select("load", "prior", "column", "na", "nb")
            parts.append(greatest_gap(cells, key, spread, values).withColumn("finding", F.lit("values")))
    every = reduce(DataFrame.unionByName, parts).distinct()
    return every.select(F.col("load").alias(key), F.col("column").alias("column_name"), "finding")


def _more(a: str, b: str, factor: int) -> Column:
    return F.col(a) > factor * F.col(b)


def _sizes(both: DataFrame) -> DataFrame:
    return both.select("load", "prior", "column", F.col("proper").alias("na"), F.col("p_proper").alias("nb"))


def _compared(stats: DataFrame, chain: DataFrame, key: str, invalid: float, nulls: float, distinct: int) -> tuple[DataFrame, DataFrame]:
    """Statistics (key, column, ..., lo, hi) next to those of the load before, and the findings that are sure from them.

    ``lo`` and ``hi`` bound the number of distinct values.
    """
    own = stats.withColumnRenamed(key, "load")
    was = stats.select(F.col(key).alias("prior"), "column", *(F.col(c).alias(f"p_{c}") for c in ("total", "nulls", "proper", "lo", "hi")))
    both = own.join(chain, "load").join(was, ["prior", "column"])

    def share(c: float) -> Column:
        return F.lit(c).cast("decimal(6,4)")

    def wide(a: str, b: str) -> Column:
        return (_wide(a) * _wide(b)).cast("decimal(32,0)")

    bad = own.where(_wide("invalid") > share(invalid) * _wide("values")).select("load", "column", F.lit("invalid").alias("finding"))
    null = both.where(F.abs(wide("nulls", "p_total") - wide("p_nulls", "total")) > share(nulls) * wide("total", "p_total")).select("load", "column", F.lit("nulls").alias("finding"))
    many = both.where(_more("lo", "p_hi", distinct) | _more("p_lo", "hi", distinct)).select("load", "column", F.lit("distinct").alias("finding"))
    return both, bad.unionByName(null).unionByName(many)


#: The vocabulary of run states.
STATUSES = (
    "COMPLETED", "TIMEOUT", "ERROR", "MEMORY_LIMIT", "INVALID_OUTPUT", "INTERRUPTED",
    "LAUNCH_ERROR", "LOG_LIMIT", "BLOCKED", "NOT_RUN_BUDGET", "NOT_RUN",
)
#: The checked columns of runs.
RUN_RULES = [Rule("status", numeric=False, vocabulary=STATUSES), Rule("onmi"), Rule("peak_tree_rss_bytes", low=2.0**20, high=2.0**40)]
#: Those and the other measures whose bounds follow from what they are.
MEASURE_RULES = [*RUN_RULES, Rule("pipeline_seconds", high=sys.float_info.max), Rule("matched_macro_f1")]


def column_profile(spark: SparkSession, path: str, ranges: bool = True) -> DataFrame:
    """(column_name, n_rows, nulls, low, high): each column's null count and range.

    Footers say what they can; a column with a chunk whose null count is missing, or,
    with ``ranges``, whose extrema are missing or not exact, is scanned. ``low`` and
    ``high`` are text and leave NaN out. Of nested columns, which aren't scanned, what
    the footers leave open is null.
    """
    chunks = materialize(chunk_statistics(spark, path), "chunks")
    numeric = F.col("exact") | F.col("physical").isin("DOUBLE", "FLOAT")
    # a float's extrema don't settle its range where they may be cut short by NaN or missing
    ranged = (F.col("exact") & F.col("low").isNotNull()) | (F.col("physical").isin("DOUBLE", "FLOAT") & F.col("low_num").isNotNull() & F.col("high_num").isNotNull()) | (F.col("nulls") == F.col("num_rows"))
    whole = chunks.groupBy("column").agg(
        F.sum("num_rows").alias("n_rows"), F.when(F.count("nulls") == F.count("*"), F.sum("nulls")).alias("nulls"), F.every(F.coalesce(ranged, F.lit(False))).alias("ranged"),
        F.min(F.when(numeric, F.col("low_num"))).alias("a"), F.max(F.when(numeric, F.col("high_num"))).alias("b"),
        F.min(F.when(F.col("exact"), F.col("low"))).alias("ta"), F.max(F.when(F.col("exact"), F.col("high"))).alias("tb"),
    )
    told = F.col("ranged") if ranges else F.lit(False)
    said = whole.select(
        F.col("column").alias("column_name"), "n_rows", "nulls", F.when(told, F.coalesce(F.col("a").cast("string"), "ta")).alias("low"), F.when(told, F.coalesce(F.col("b").cast("string"), "tb")).alias("high"), "ranged"
    )
    # one row a column
    open_ = [r["column_name"] for r in said.where(F.col("nulls").isNull() | (F.lit(ranges) & ~F.col("ranged"))).select("column_name").collect()]
    table = spark.read.parquet(path)
    names = [f.name for f in table.schema.fields if f.name in set(open_)]
    said = said.drop("ranged")
    if not names:
        return said

    def extremes(c: str) -> list[Column]:
        kind = table.schema[c].dataType
        if not ranges or not isinstance(kind, AtomicType):
            return [F.lit(None).cast("string"), F.lit(None).cast("string")]
        v = F.when(~F.isnan(c), F.col(c)) if isinstance(kind, (DoubleType, FloatType)) else F.col(c)
        return [F.min(v).cast("string"), F.max(v).cast("string")]

    sums = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("s_nulls"), extremes(c)[0].alias("s_low"), extremes(c)[1].alias("s_high")) for c in names]
    scan = table.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    pick = [F.coalesce(F.col(f"s_{c}"), F.col(c)).alias(c) for c in ("nulls", "low", "high")]
    return said.join(scan, "column_name", "left").select("column_name", "n_rows", *pick)


def distinct_values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(value) of a string column, from its dictionaries."""
    return dictionary_values(spark, path, column)
