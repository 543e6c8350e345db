"""The signal model: one row per signal, `id` and `x`, an array over a shared time grid with NULL for missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_long(rows: DataFrame, n: int, keys: tuple[str, ...] = ("id",), t: str = "t", x: str = "x") -> DataFrame:
    """Signals from rows (keys, t in 0..n-1, x); NaN and absent cells become NULL, a t outside the grid is an error."""
    value = F.when(F.isnan(x), None).otherwise(F.col(x).cast("double"))
    at = F.when(F.col(t).between(0, n - 1), F.col(t)).otherwise(F.raise_error(F.concat(F.lit("no time point "), F.coalesce(F.col(t).cast("string"), F.lit("null")), F.lit(f" in a grid of {n}"))).cast("int"))
    cells = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("t"), value.alias("v")))).alias("_m"))
    return cells.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("_m", i)).alias("x"))


def to_long(signals: DataFrame, value: str = "x") -> DataFrame:
    """Rows (keys, t, x) of all cells, missing ones included."""
    keys = [c for c in signals.columns if c != value]
    return signals.select(*keys, F.posexplode(value).alias("t", "x"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: bound to a lambda variable, it is not copied into inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def present(x: Column) -> Column:
    return F.array_compact(x)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(present(x)))


def median(x: Column) -> Column:
    """Of the values that are present; NULL without any."""
    return let(F.array_sort(present(x)), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def deviation(x: Column) -> Column:
    """Population standard deviation of the values that are present."""
    return let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def lower_quantile(values: Column, q: float) -> Column:
    """The order statistic at floor((n - 1) q) of an array."""
    return let(F.array_sort(values), lambda s: F.get(s, F.floor((F.size(s) - 1) * F.lit(q)).cast("int")))
