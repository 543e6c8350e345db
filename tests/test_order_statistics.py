"""Numbering, quantiles and medians of few large groups, against NumPy."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, order, resample, transform


def cells(spark, n=4000, seed=1):
    r = np.random.default_rng(seed)
    f = pd.DataFrame({"t": r.integers(0, 3, n), "id": np.arange(n), "x": np.round(r.normal(size=n), 2)})
    f.loc[f["t"] == 1, "x"] = np.where(r.random((f["t"] == 1).sum()) < 0.6, 0.0, f.loc[f["t"] == 1, "x"])
    return f, spark.createDataFrame(f).repartition(5)


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_numbers_go_through_all_slices(spark, slices):
    f, df = cells(spark)
    got = order.numbered(df, "t", ["x", "id"], "r", slices).toPandas().set_index("id")["r"]
    want = f.sort_values(["x", "id"]).groupby("t").cumcount()
    assert (got[f["id"]].to_numpy() == want[f.index].to_numpy()).all()
    got = order.numbered(df, None, ["id"], "r", slices).toPandas()
    assert (got["r"] == got["id"]).all() and list(got.columns) == ["t", "id", "x", "r"]


def test_numbers_of_nothing(spark):
    assert order.numbered(spark.createDataFrame([], "t int, id long"), "t", ["id"], "r").count() == 0


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantiles(spark, q):
    f, df = cells(spark)
    got = order.lower_quantiles(df, "t", "x", q, "v").toPandas().set_index("t")["v"]
    assert got.to_dict() == f.groupby("t")["x"].apply(lambda x: np.sort(x)[int((len(x) - 1) * q)]).to_dict()


def test_brackets_hold_far_more_rows_than_marks(spark):
    """200 000 rows in a group: all order statistics between the sketch's marks are exact."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("t"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("x"))
    wanted = {f"r{k}": F.floor(F.col("n") * k / 11).cast("long") + k for k in range(12)}
    got = order.quantiles(df, "t", "x", wanted).toPandas().set_index("t")
    f = df.toPandas()
    for t in (0, 1):
        x = np.sort(f.loc[f["t"] == t, "x"].to_numpy())
        assert all(got.loc[t, f"r{k}"] == x[min(len(x) * k // 11 + k, len(x) - 1)] for k in range(12))


def test_medians_of_few_and_missing_values(spark):
    rows = [(0, 1.0), (0, 4.0), (1, 5.0), (2, None), (3, 2.0), (3, 2.0), (3, None), (3, 9.0)]
    got = order.medians(spark.createDataFrame(rows, "t int, x double"), "t", "x", "m").collect()
    assert {r.t: r.m for r in got} == {0: 2.5, 1: 5.0, 3: 2.0}


def hot(spark, n=30_000):
    return spark.range(n).select("id", F.array(*[F.when((F.col("id") + k) % 3 == 0, F.lit(0.0)).otherwise(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9973)).cast("double")) for k in range(4)]).alias("x"))


@pytest.mark.parametrize("run", [clean.impute_columns, transform.modified_z_columns, transform.quantile_normalise, transform.quantile_transform, lambda s: resample.bootstrap(s, 50)])
def test_no_task_holds_a_time_point(spark, run):
    """No window, sort or grouped Python by t alone; what is grouped by t is added up before it is shuffled."""
    s = hot(spark, 200)
    plan = run(s)._jdf.queryExecution().executedPlan().toString().split("\n")
    for line, below in zip(plan, [*plan[1:], ""], strict=True):
        assert not re.search(r"Window \[.*\], \[t#\d+\]", line) and "FlatMapGroups" not in line
        if re.search(r"Exchange hashpartitioning\(t#\d+, \d+\)", line):
            assert "Aggregate(keys=[t#" in below, "\n".join(plan)


def test_normalised_like_numpy_with_hot_ties(spark):
    s = hot(spark)
    x = np.stack(s.orderBy("id").toPandas()["x"].to_list())
    want = np.zeros_like(x)
    weights = np.sort(x, 0).mean(1)
    for t in range(x.shape[1]):
        rank = pd.Series(weights[np.argsort(np.argsort(x[:, t], kind="stable"), kind="stable")])
        want[:, t] = rank.groupby(x[:, t]).transform("mean")
    got = transform.quantile_normalise(s).toPandas().pivot(index="id", columns="t", values="x").to_numpy()
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("most", [7, 1000])
def test_quantile_transform_like_numpy(spark, most):
    s = hot(spark, 900 if most == 1000 else 500)
    x = np.stack(s.orderBy("id").toPandas()["x"].to_list())
    got = transform.quantile_transform(s, most=most).toPandas().pivot(index="id", columns="t", values="x").to_numpy()
    for t in range(4):
        v = x[:, t]
        grid = np.linspace(0, 1, min(len(v), most))
        q = np.sort(v) if len(v) <= most else np.quantile(v, grid)
        y = (np.interp(v, q, grid) - np.interp(-v, -q[::-1], -grid[::-1])) / 2
        y[v == q[0]], y[v == q[-1]] = 0, 1
        assert np.allclose(got[:, t], y, atol=1e-9)


def test_bootstrap_draws_by_number(spark):
    s = hot(spark, 300)
    x = np.stack(s.orderBy("id").toPandas()["x"].to_list())
    draw = lambda k, t: ((k * resample.A + t * resample.B + resample.C) % resample.P) ** 2 % resample.P % 300
    for whole in (False, True):
        got = resample.bootstrap(s, 40, whole).orderBy("id").toPandas()["x"]
        assert all(got[k][t] == x[draw(k, 0 if whole else t), t] for k in range(40) for t in range(4))
