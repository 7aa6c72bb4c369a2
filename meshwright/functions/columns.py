"""Column expressions: ratios, reduced fractions, mass grids, and JSON for numbers JSON lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0, null or not finite, or a isn't a finite number."""
    x, y = a.cast("double"), b.cast("double")
    fine = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return F.when(fine & (y != 0), F.try_divide(x, y))


def reduced(num: Column, den: Column) -> Column:
    """struct(num, den) in lowest terms with den > 0; null where den is 0. Euclid's algorithm in at most 96 steps."""
    start = F.struct(F.abs(num).cast("bigint").alias("a"), F.abs(den).cast("bigint").alias("b"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(96)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    )
    g = step["a"]
    sign = F.when(den < 0, -1).otherwise(1)
    top = (sign * F.floor(F.try_divide(num, g))).cast("bigint")
    return F.when(den != 0, F.struct(top.alias("num"), F.floor(F.try_divide(F.abs(den), g)).cast("bigint").alias("den")))


def mass_grid(degree: Column, m: int, start: float = 3.0, ratio: float = 2.0, fraction: float = 0.5) -> Column:
    """array of start d ratio^j for j = 0, 1, ... up to ``fraction`` of the volume; empty for degree 0."""
    steps = F.floor(F.log(F.try_divide(F.lit(fraction * m), start * degree)) / F.log(F.lit(ratio)) + 1e-12).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda j: start * degree * F.pow(F.lit(ratio), j))
    return F.when((degree > 0) & (start * degree <= fraction * m), grid).otherwise(F.array().cast("array<double>"))


def json_number(x: Column) -> Column:
    """A double as JSON text: NaN and infinities as the strings "nan", "inf", "-inf", null as null."""
    v = x.cast("double")
    return (
        F.when(v.isNull(), "null").when(F.isnan(v), '"nan"').when(v == float("inf"), '"inf"').when(v == -float("inf"), '"-inf"').otherwise(v.cast("string"))
    )


def round_half_even(x: Column, digits: int = 0) -> Column:
    """A double rounded to some digits, ties to the even neighbour."""
    return F.bround(x, digits)
