"""Trend classes: the first significant lag or frequency, else a spike, else none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clean, order, resample, spectral, transform


def preprocess(s: DataFrame, fraction: float = 0.75, constant: float = 0.0, low: float = 1.0, low_as: float = 1.0, reference: int = 0) -> DataFrame:
    s = clean.drop_zero_at(clean.drop_all_zero(s), reference)
    s = clean.tag_missing(clean.keep_nonzero_fraction(s, fraction), 0.0)
    return clean.drop_constant(clean.floor_low(s, low, low_as), constant)


def spikes(s: DataFrame, cutoffs: DataFrame, highest: bool = True) -> DataFrame:
    """(id, spike): whether the extreme cell leaves the interval for the number of cells present; other numbers are left out."""
    zero = F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))
    point = F.array_max(zero) if highest else F.array_min(zero)
    rows = s.select("id", F.size(F.array_compact("x")).alias("n_obs"), point.alias("pt"))
    # at most one row for each number of cells
    return rows.join(F.broadcast(cutoffs), "n_obs").select("id", ((F.col("pt") > F.col("hi")) | (F.col("pt") < F.col("lo"))).alias("spike"))


def categorise(s: DataFrame, times: list[float], p: float = 0.05, samples: int = 100_000, fraction: float = 0.75, reference: int = 0, spectrum: bool = False, prepare: bool = True) -> DataFrame:
    """(id, trend_class): LAGk (or Fk by spectrum), SpikeMax, SpikeMin or null; every prepared signal has one row."""
    s = preprocess(s, fraction, reference=reference) if prepare else s
    s = order.settled(s)
    null = order.settled(resample.null_signals(s, samples, fraction, reference))
    unit = transform.unit_norm(s, reference)
    kernel = (lambda d: spectral.lomb_scargle(d, times, normalise=True)) if spectrum else (lambda d: spectral.autocorrelation(d, times))
    cut = resample.cutoffs(kernel(null), p)
    row = cut.agg(F.map_from_entries(F.collect_list(F.struct("k", "cut"))).alias("_cut"))  # one entry per lag
    found = kernel(unit).join(F.broadcast(row))
    above = F.transform("x", lambda v, k: (k >= 1) & F.coalesce(F.round(v, 9) > F.round(F.try_element_at("_cut", k), 9), F.lit(False)))
    first = found.select("id", F.array_position(above, True).alias("at"))
    limits = order.settled(resample.spike_limits(null, p))
    high = spikes(unit, limits).withColumnRenamed("spike", "up")
    low = spikes(unit, limits, False).withColumnRenamed("spike", "down")
    label = F.when(F.col("at") > 0, F.concat(F.lit("F" if spectrum else "LAG"), (F.col("at") - 1).cast("string"))).when(F.col("up"), "SpikeMax").when(F.col("down"), "SpikeMin")
    return first.join(high, "id", "left").join(low, "id", "left").select("id", label.alias("trend_class"))
