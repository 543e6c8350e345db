"""Bootstrap null distributions with draws from integer arithmetic, so that any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clean, model, order, spectral, transform

#: A fixed linear rule for the draw of sample s at time point t among n values.
A, B, C, P = 7919, 104729, 1299709, 2147483647


def draw(sample: Column, t: Column, n: Column) -> Column:
    mixed = F.pmod(sample * A + t * B + C, F.lit(P))
    return F.pmod(F.pmod(mixed * mixed, F.lit(P)), n)


def bootstrap(s: DataFrame, samples: int, whole_rows: bool = False) -> DataFrame:
    """Signals (id = 0..samples-1, x): every time point is drawn with replacement by itself, or whole signals are.

    Signals are numbered by id once, for all time points; a sample's cell is one equi-join on (t, number).
    """
    spark: SparkSession = s.sparkSession
    known = order.settled(order.numbered(s.select("id", "x"), None, ["id"], "r").select("r", "x"))
    n = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("w")).first()
    drawn = lambda t: draw(F.col("sample"), t, F.lit(max(n["n"], 1)).cast("long"))
    rows = spark.range(samples).select(F.col("id").alias("sample"))
    if whole_rows:
        return rows.withColumn("r", drawn(F.lit(0))).join(known, "r").select(F.col("sample").alias("id"), "x")
    grid = rows.select("sample", F.explode(F.sequence(F.lit(0), F.lit((n["w"] or 1) - 1))).alias("t"))
    cells = known.select("r", F.posexplode("x").alias("t", "x"))
    found = grid.withColumn("r", drawn(F.col("t"))).join(cells, ["t", "r"])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda c: c["x"])  # a sample has every time point once
    return found.groupBy(F.col("sample").alias("id")).agg(in_order.alias("x"))


def null_signals(s: DataFrame, samples: int, fraction: float = 0.75, reference: int = 0) -> DataFrame:
    drawn = clean.keep_nonzero_fraction(bootstrap(s, samples), fraction)
    return clean.drop_constant(transform.unit_norm(drawn, reference), 0.0)


def null_autocorrelations(s: DataFrame, times: list[float], samples: int, fraction: float = 0.75, reference: int = 0) -> DataFrame:
    return spectral.autocorrelation(null_signals(s, samples, fraction, reference), times)


def null_periodograms(s: DataFrame, times: list[float], samples: int, fraction: float = 0.75, reference: int = 0) -> DataFrame:
    return spectral.lomb_scargle(null_signals(s, samples, fraction, reference), times)


def spike_cutoffs(s: DataFrame, p: float, samples: int, fraction: float = 0.75, reference: int = 0) -> DataFrame:
    """(n_obs, hi, lo): quantiles of the largest and smallest cell, by the number of cells present."""
    return spike_limits(order.settled(null_signals(s, samples, fraction, reference)), p)


def spike_limits(null: DataFrame, p: float) -> DataFrame:
    """spike_cutoffs() from signals of the null."""
    zero = F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))
    ends = null.select(F.size(F.array_compact("x")).alias("n_obs"), F.array_max(zero).alias("mx"), F.array_min(zero).alias("mn"))
    return order.lower_quantiles(ends, "n_obs", "mx", 1 - p, "hi").join(order.lower_quantiles(ends, "n_obs", "mn", p, "lo"), "n_obs")


def cutoffs(null: DataFrame, p: float) -> DataFrame:
    """(k, cut): the lower quantile 1 - p at each index of the null's vectors; index 0 is never exceeded."""
    cells = order.settled(null.select("x")).select(F.posexplode("x").alias("k", "v"))
    cut = order.lower_quantiles(cells, "k", "v", 1 - p, "cut")
    return cut.select("k", F.when(F.col("k") == 0, F.lit(1.0)).otherwise(F.col("cut")).alias("cut"))
