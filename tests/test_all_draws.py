"""Null models with the reference's number of draws, against plain Python that repeats the draws."""

import inspect
from statistics import fmean

import numpy as np

from tidemark.operators import categorize, resample
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


def brute_limits(x, samples, fraction=0.75, p=0.05):
    """n_obs -> (hi, lo) of signals x, in the order of their ids."""
    n, width = x.shape
    s = np.arange(samples, dtype=np.int64)[:, None]
    mixed = (s * resample.A + np.arange(width) * resample.B + resample.C) % resample.P
    drawn = x[(mixed * mixed) % resample.P % n, np.arange(width)]
    drawn = drawn[(np.isnan(drawn) | (drawn != 0)).sum(1) >= np.ceil(fraction * width)]
    drawn = drawn - drawn[:, :1]
    norm = np.sqrt(np.nansum(drawn * drawn, 1, keepdims=True))
    drawn = np.where(norm > 0, drawn / np.where(norm > 0, norm, 1), np.nan)
    sd = np.array([np.nanstd(r) if not np.isnan(r).all() else np.nan for r in drawn])
    drawn = drawn[sd / fmean(sd[~np.isnan(sd)]) > 0]
    count, full = (~np.isnan(drawn)).sum(1), np.nan_to_num(drawn)
    lower = lambda v, q: np.sort(v)[int(np.floor((len(v) - 1) * q))]
    return {int(k): (lower(full[count == k].max(1), 1 - p), lower(full[count == k].min(1), p)) for k in np.unique(count)}


def test_spike_limits_of_all_draws(spark):
    s = catalogue.a.sparse_signals(spark, SF)
    x = np.array([[np.nan if c is None else c for c in r.x] for r in s.orderBy("id").collect()], float)
    got = {r.n_obs: (r.hi, r.lo) for r in catalogue.QUERIES["n_spike_cutoffs_all"](spark, SF).collect()}
    want = brute_limits(x, 100_000)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)


def test_classes_take_all_draws_by_default():
    assert inspect.signature(categorize.categorise).parameters["samples"].default == 100_000
    assert {f"{n}_all" for n in ("c_classes_acf", "c_classes_pgram", "c_quantile_cutoffs", "c_spikes_max", "c_spikes_min")} <= catalogue.QUERIES.keys()
