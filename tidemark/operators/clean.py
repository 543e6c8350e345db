"""Filters and cell-wise cleaning of signals. A missing cell counts as non-zero, as it may hold anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model, order

X = F.col


def _at_least(count, fraction: float):
    return count >= F.ceil(F.lit(fraction) * F.size("x"))


def drop_all_zero(s: DataFrame) -> DataFrame:
    return s.where(F.exists("x", lambda v: v.isNull() | (v != 0)))


def keep_nonzero_fraction(s: DataFrame, fraction: float) -> DataFrame:
    return s.where(_at_least(F.size(F.filter("x", lambda v: v.isNull() | (v != 0))), fraction))


def keep_present_fraction(s: DataFrame, fraction: float) -> DataFrame:
    return s.where(_at_least(F.size(F.array_compact("x")), fraction))


def drop_zero_at(s: DataFrame, point: int = 0) -> DataFrame:
    return s.where(F.coalesce(F.get("x", F.lit(point)) != 0, F.lit(True)))


def drop_constant(s: DataFrame, cutoff: float) -> DataFrame:
    """Keep signals whose deviation exceeds cutoff times the mean deviation of all signals."""
    s = s.withColumn("_sd", model.deviation(X("x")))
    level = s.agg(F.avg("_sd").alias("_mean"))  # one row
    return s.join(F.broadcast(level)).where(F.try_divide(X("_sd"), X("_mean")) > cutoff).drop("_sd", "_mean")


def tag_missing(s: DataFrame, value: float = 0.0) -> DataFrame:
    return s.withColumn("x", F.transform("x", lambda v: F.nullif(v, F.lit(value))))


def fill_missing(s: DataFrame, value: float = 0.0) -> DataFrame:
    return s.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(value))))


def floor_low(s: DataFrame, cutoff: float, replacement: float) -> DataFrame:
    return s.withColumn("x", F.transform("x", lambda v: F.when(v <= cutoff, F.lit(replacement)).otherwise(v)))


def impute_rows(s: DataFrame) -> DataFrame:
    """Missing cells take the median of their signal."""
    return s.withColumn("x", model.let(model.median(X("x")), lambda m: F.transform("x", lambda v: F.coalesce(v, m))))


def impute_columns(s: DataFrame) -> DataFrame:
    """Missing cells take the median of their time point (one value per point)."""
    medians = order.medians(model.to_long(s), "t", "x", "m")
    row = medians.agg(F.map_from_entries(F.collect_list(F.struct("t", "m"))).alias("_m"))
    s = s.join(F.broadcast(row))
    return s.withColumn("x", F.transform("x", lambda v, i: F.coalesce(v, F.try_element_at("_m", i)))).drop("_m")
