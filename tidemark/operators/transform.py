"""Normalisations and comparisons of signals."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import model, order

X = F.col


def compare_to_point(s: DataFrame, point: str | int | float = "first") -> DataFrame:
    """Subtract the value at the first, last or given point (int), or a constant (float)."""
    if isinstance(point, float):
        ref = F.lit(point)
    else:
        at = {"first": F.lit(0), "last": F.size("x") - 1}.get(point) if isinstance(point, str) else F.lit(point)
        if at is None:
            raise ValueError(f"unknown point {point!r}")
        ref = F.get("x", at)
    return s.withColumn("x", model.let(ref, lambda r: F.transform("x", lambda v: v - r)))


def unit_norm(s: DataFrame, point: int | None = 0) -> DataFrame:
    """Relative to the reference point, divided by the Euclidean norm; constant signals become missing."""
    s = s if point is None else compare_to_point(s, point)
    return s.withColumn("x", to_unit(X("x")))


def to_unit(x: Column) -> Column:
    return model.let(x, lambda y: model.let(F.sqrt(model.total(F.transform(y, lambda v: v * v))), lambda n: F.transform(y, lambda v: F.try_divide(v, n))))


def compare_frames(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column] = lambda p, q: p - q, on: tuple[str, ...] = ("id",), merge: str | None = None) -> DataFrame:
    """Element-wise op on the signals that both frames have; `merge` first aggregates each frame per key and time point."""
    if merge:
        a, b = (_merged(f, on, merge) for f in (a, b))
    both = a.select(*on, X("x").alias("_a")).join(b.select(*on, X("x").alias("_b")), list(on))
    return both.select(*on, F.zip_with("_a", "_b", op).alias("x"))


def _merged(s: DataFrame, on: tuple[str, ...], how: str) -> DataFrame:
    cells = s.select(*on, F.posexplode("x").alias("t", "x")).groupBy(*on, "t").agg(getattr(F, how)("x").alias("x"))
    return cells.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda c: c["x"]).alias("x"))


#: Makes the median and mean absolute deviations consistent for normal data.
MEDIAN_SCALE, MEAN_SCALE = 0.6744897, 0.7978846


def _modified(x: Column, med: Column, mad: Column, mean_ad: Column) -> Column:
    return F.when(mad == 0, F.try_divide(F.lit(MEAN_SCALE) * (x - med), mean_ad)).otherwise(F.try_divide(F.lit(MEDIAN_SCALE) * (x - med), mad))


def modified_z_columns(s: DataFrame) -> DataFrame:
    """Long rows (id, t, z); deviations within each time point."""
    cells = model.to_long(s).where("x is not null")
    first = order.medians(cells, "t", "x", "med").join(cells.groupBy("t").agg(F.avg("x").alias("mu")), "t")
    cells = cells.join(F.broadcast(order.settled(first)), "t").withColumn("_off", F.abs(X("x") - X("med")))  # one row per time point
    second = order.medians(cells, "t", "_off", "mad").join(cells.groupBy("t").agg(F.avg(F.abs(X("x") - X("mu"))).alias("mean_ad")), "t")
    cells = cells.join(F.broadcast(second), "t")
    return cells.select("id", "t", _modified(X("x"), X("med"), X("mad"), X("mean_ad")).alias("z"))


def modified_z_rows(s: DataFrame) -> DataFrame:
    ends = F.struct(model.median(X("x")).alias("med"), model.mean(X("x")).alias("mu"))
    spread = lambda e: F.struct(e["med"].alias("med"), model.median(F.transform("x", lambda v: F.abs(v - e["med"]))).alias("mad"), model.mean(F.transform("x", lambda v: F.abs(v - e["mu"]))).alias("ad"))
    scored = lambda d: F.transform("x", lambda v: _modified(v, d["med"], d["mad"], d["ad"]))
    return s.withColumn("x", model.let(ends, lambda e: model.let(spread(e), scored)))


def box_cox(s: DataFrame, lam: float) -> DataFrame:
    """Positive cells only; zero, negative and missing cells stay."""
    f = (lambda v: F.ln(v)) if lam == 0 else (lambda v: (F.pow(v, F.lit(lam)) - 1) / lam)
    return s.withColumn("x", F.transform("x", lambda v: F.when(v > 0, f(v)).otherwise(v)))


def _best_lambda(logs: np.ndarray) -> float:
    """Maximum-likelihood power by golden sections on [-2, 2], widened while the maximum sits on the edge."""

    def cost(lam: float) -> float:
        y = logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam
        v = y.var()
        return -((lam - 1) * logs.sum() - len(logs) / 2 * np.log(v)) if v > 0 else np.inf

    lo, hi, g = -2.0, 2.0, (np.sqrt(5) - 1) / 2
    for _ in range(6):
        a, b = lo, hi
        for _ in range(90):
            p, q = b - g * (b - a), a + g * (b - a)
            a, b = (a, q) if cost(p) < cost(q) else (p, b)
        best = (a + b) / 2
        if lo + 1e-3 < best < hi - 1e-3:
            break
        lo, hi = lo * 2, hi * 2
    return float(best)


def box_cox_fitted(s: DataFrame) -> DataFrame:
    """Each signal by its own maximum-likelihood power, in `lam`; signals without two distinct positive values stay."""

    def run(frames):
        for f in frames:
            lams, xs = [], []
            for x in f["x"]:
                v = np.array([np.nan if c is None else c for c in x], float)
                pos = v > 0
                logs = np.log(v[pos])
                lam = _best_lambda(logs) if len(np.unique(logs)) > 1 else None
                if lam is not None:
                    v[pos] = logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam
                lams.append(lam)
                xs.append([None if np.isnan(c) else float(c) for c in v])
            yield f.assign(x=xs, lam=pd.array(lams, dtype="Float64"))

    return s.mapInPandas(run, s.withColumn("lam", F.lit(None).cast("double")).schema)


#: Aggregates that averaging and ties may name.
AGGREGATES = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "product": F.product}


def quantile_normalise(s: DataFrame, averaging: str = "mean", ties: str = "mean") -> DataFrame:
    """Long rows (id, t, x): every time point gets one distribution, the `averaging` of each rank's values over time points.

    Tied values get the `ties` aggregate of their ranks' weights. Both are names of AGGREGATES.
    """
    ranked = order.settled(order.numbered(model.to_long(s).where("x is not null"), "t", ["x", "id"], "rn"))
    weights = ranked.groupBy("rn").agg(AGGREGATES[averaging]("x").alias("w"))
    tied = ranked.join(weights, "rn").groupBy("t", "x").agg(AGGREGATES[ties]("w").alias("w"))
    return ranked.select("id", "t", "x").join(tied, ["t", "x"]).select("id", "t", X("w").alias("x"))


def landmarks(s: DataFrame, most: int = 1000) -> dict[int, np.ndarray]:
    """Ascending values by time point: all of up to `most`, else as many quantiles, straight between order statistics."""
    ranked = order.numbered(model.to_long(s).where("x is not null").select("id", "t", "x"), "t", ["x", "id"], "rn")
    sizes = ranked.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(most), X("n")) - 1), lambda k: F.when(X("n") <= most, k.cast("double")).otherwise(k * (X("n") - 1) / (most - 1))))
    wanted = sizes.select("t", at.alias("at")).withColumn("rn", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    # at most 2 * most rows of a time point
    found = ranked.join(F.broadcast(wanted), ["t", "rn"]).select("t", "at", "rn", "x").orderBy("t", "at", "rn").toArrow().to_pandas()
    out = {}
    for t, f in found.groupby("t"):
        low, high = f.groupby("at").first(), f.groupby("at").last()
        out[int(t)] = (low["x"] + (high["x"] - low["x"]) * (low.index.to_numpy() - low["rn"])).to_numpy()
    return out


def quantile_transform(s: DataFrame, target: str = "uniform", most: int | None = None) -> DataFrame:
    """Long rows (id, t, x): each time point's values through their own distribution function.

    Every value is a landmark, and the middle of its ranks is its place. With `most`, places are interpolated between
    as many landmarks of a time point, which go to every task; cells are neither grouped nor sorted by time point.
    """
    inv = np.vectorize(NormalDist().inv_cdf, otypes=[float])
    if most is None:
        return _ranked_places(s, target, inv)
    marks = s.sparkSession.sparkContext.broadcast(landmarks(s, most))

    def placed(v: np.ndarray, q: np.ndarray) -> np.ndarray:
        grid = np.linspace(0, 1, len(q))
        y = (np.interp(v, q, grid) - np.interp(-v, -q[::-1], -grid[::-1])) / 2
        y[v == q[0]], y[v == q[-1]] = 0.0, 1.0
        return inv(np.clip(y, 1e-7, 1 - 1e-7)) if target == "normal" else y

    def run(frames):
        for f in frames:
            v, t, y = f["x"].to_numpy(float), f["t"].to_numpy(), np.zeros(len(f))
            for k in np.unique(t).tolist():
                y[t == k] = placed(v[t == k], marks.value[k])
            yield f.assign(x=y)

    return model.to_long(s).where("x is not null").select("id", "t", "x").mapInPandas(run, f"id {s.schema['id'].dataType.simpleString()}, t int, x double")


def _ranked_places(s: DataFrame, target: str, inv: Callable) -> DataFrame:
    """quantile_transform() by every value's ranks; ties are counted before they are shuffled."""
    ranked = order.settled(order.numbered(model.to_long(s).where("x is not null").select("id", "t", "x"), "t", ["x", "id"], "rn"))
    ends = ranked.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))  # one row per time point
    tied = ranked.groupBy("t", "x").agg((F.min("rn") + (F.count(F.lit(1)) - 1) / 2).alias("middle")).join(F.broadcast(ends), "t")
    place = F.when(X("x") == X("x1"), 1.0).when(X("x") == X("x0"), 0.0).otherwise(X("middle") / (X("n") - 1))
    normal = F.pandas_udf(lambda y: pd.Series(inv(np.clip(y.to_numpy(float), 1e-7, 1 - 1e-7))), "double")
    tied = tied.select("t", "x", (normal(place) if target == "normal" else place).alias("y"))
    return ranked.join(tied, ["t", "x"]).select("id", "t", X("y").alias("x"))


def chop(c: Column, tolerance: float = 1e-10) -> Column:
    return F.when(F.abs(c) < tolerance, F.lit(0.0)).otherwise(c)


def common_distance(u: Column, v: Column) -> Column:
    """Euclidean distance over the positions that both have."""
    return F.sqrt(model.total(F.zip_with(u, v, lambda a, b: (a - b) * (a - b))))


def correlation(u: Column, v: Column) -> Column:
    """Pearson's correlation over the positions that both have; NULL without spread."""
    both = F.filter(F.zip_with(u, v, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda c: c["a"].isNotNull() & c["b"].isNotNull())
    sum_of = lambda c, f: F.aggregate(c, F.lit(0.0), lambda t, p: t + f(p))

    def centred(c: Column) -> Column:
        means = F.struct(F.try_divide(sum_of(c, lambda p: p["a"]), F.size(c)).alias("a"), F.try_divide(sum_of(c, lambda p: p["b"]), F.size(c)).alias("b"))
        return model.let(means, lambda m: F.transform(c, lambda p: F.struct((p["a"] - m["a"]).alias("a"), (p["b"] - m["b"]).alias("b"))))

    ratio = lambda d: F.try_divide(sum_of(d, lambda p: p["a"] * p["b"]), F.sqrt(sum_of(d, lambda p: p["a"] * p["a"]) * sum_of(d, lambda p: p["b"] * p["b"])))
    return model.let(both, lambda c: model.let(centred(c), ratio))


def concat_rows(*frames: DataFrame) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def concat_columns(a: DataFrame, b: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """Full outer: a signal that one side lacks has missing cells there."""
    none = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    both = a.select("id", X("x").alias("_a")).join(b.select("id", X("x").alias("_b")), "id", "full_outer")
    return both.select("id", F.concat(F.coalesce("_a", none(n_a)), F.coalesce("_b", none(n_b))).alias("x"))


def profile(s: DataFrame) -> DataFrame:
    """(t, level): mean over signals of what is above zero, after imputing by signal."""
    from .clean import impute_rows

    return model.to_long(impute_rows(s)).groupBy("t").agg((F.sum(F.when(X("x") > 0, X("x")).otherwise(0.0)) / F.count(F.lit(1))).alias("level"))


def histogram(s: DataFrame, bins: int) -> DataFrame:
    """(t, bin, n) of each time point between its own extremes; the largest value is in the last bin."""
    cells = model.to_long(s).where("x is not null")
    ends = cells.groupBy("t").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(X("x") - X("lo"), X("hi") - X("lo")), F.lit(0.0)) * bins))
    return cells.join(F.broadcast(ends), "t").groupBy("t", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
