"""Number functions whose results must not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def round6(x: Column) -> Column:
    """Six places, halves up."""
    return F.floor((x + EPSILON) * 1e6 + 0.5) / 1e6


def idf(n: Column, df: Column) -> Column:
    return F.ln((n + 1) / (df + 1)) + 1


def ordered_sum(values: Column) -> Column:
    """The sum of an array from its first element on: the same to the last bit in every run."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def sum_by(order: Column, value: Column) -> Column:
    """An aggregate: the sum of value in the order of `order`."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.cast("double").alias("v"))))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x.v)


def recursive_mean(values: Column) -> Column:
    """The mean of the positive values weighted by themselves: sum of squares by sum; 0 without any."""
    kept = F.filter(values, lambda v: v > 0)
    total = ordered_sum(kept)
    return F.when(total > 0, ordered_sum(F.transform(kept, lambda v: v * v)) / total).otherwise(0.0)
