"""Tables whose groups are large or whose values tie."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import adapters
from tidemark.operators import cluster, enrich, spectral, transform


def test_masses_of_few_values_are_joined_as_lists(spark, monkeypatch):
    """Rows of one mass are many pairs of short lists, not one join key."""
    monkeypatch.setattr(enrich, "PACK", 16)
    r = np.random.default_rng(5)
    q, c = np.round(r.uniform(900, 901, 300), 1), np.round(r.uniform(900, 901, 400), 1)
    queries = spark.createDataFrame(pd.DataFrame({"query": np.arange(300), "m": q}))
    masses = spark.createDataFrame(pd.DataFrame({"compound": np.arange(400), "mass": c}))
    got = enrich.match_masses(queries, masses, 120)
    want = (c[None] > q[:, None] * (1 - 120e-6)) & (c[None] < q[:, None] * (1 + 120e-6))
    assert sorted(map(tuple, got.collect())) == sorted(zip(*(k.tolist() for k in np.nonzero(want)), strict=True))
    packed = enrich._packed(masses.select(F.col("compound").alias("id"), "mass"), 30e-6).select(F.size("list").alias("n")).toPandas()["n"]
    assert packed.sum() == 400 and packed.max() <= 40 and len(packed) >= 20


def test_cells_add_events_in_their_order(spark, tmp_path):
    """0.1 + 0.7 + 0.2 depends on the order; the cell's value must not depend on how the table is cut."""
    values = [0.1, 0.7, 0.2, 1e16, -1e16, 0.3]
    f = pd.DataFrame({"event_id": np.arange(6), "ts": pd.Timestamp("2024-01-03"), "user_id": 7, "event_type": "view", "value": values})
    for k, order in enumerate((range(6), [5, 3, 0, 4, 2, 1], [2, 1, 4, 5, 0, 3])):
        spark.createDataFrame(f.iloc[list(order)]).repartition(4, F.lit(k) + F.col("event_id")).write.parquet(f"{tmp_path}/{k}/events.parquet")
        (row,) = adapters.event_signals(spark, f"{tmp_path}/{k}").collect()
        assert row.x[2] == ((((0.1 + 0.7) + 0.2) + 1e16) - 1e16) + 0.3 and row.x.count(None) == adapters.DAYS - 1


def test_every_value_is_a_landmark(spark):
    """1 500 values of a time point, a third of them tied: the middle of the ranks, not a place between a thousand landmarks."""
    x = np.random.default_rng(2).permutation(np.concatenate([np.zeros(500), np.arange(1000.0) ** 2]))
    s = spark.createDataFrame(pd.DataFrame({"id": np.arange(1500), "x": [[v] for v in x.tolist()]}))
    got = transform.quantile_transform(s).toPandas().set_index("id")["x"][np.arange(1500)].to_numpy()
    want = (pd.Series(x).rank().to_numpy() - 1) / 1499
    want[x == x.min()], want[x == x.max()] = 0, 1
    assert np.abs(got - want).max() < 1e-12


def test_copies_and_long_clusters_link_without_stored_distances(spark, monkeypatch, tmp_path):
    """Forty copies of a few signals are one leaf each; clusters longer than a slice keep their heights; nothing of n * n is written."""
    monkeypatch.setattr(cluster, "IN_MEMORY", 6)
    monkeypatch.setattr(cluster, "SLICE", 4)
    base = np.random.default_rng(3).normal(size=(30, 6)) + np.repeat([[0.0] * 6, [9.0] * 6], [25, 5], 0)
    x = base[np.random.default_rng(4).permutation(np.repeat(np.arange(30), 40))]
    points = spark.createDataFrame(list(enumerate(x.tolist())), "place long, x array<double>")
    kept, settled = [], cluster.order.settled
    monkeypatch.setattr(cluster.order, "settled", lambda df: kept.append(df.columns) or settled(df))
    for method in ("weighted", "average", "complete", "single"):
        z, want = cluster.spread_linkage(points, "euclidean", method), cluster.linkage(cluster.distances(x, "euclidean"), method)
        assert np.allclose(z[-29:, 2], want[-29:, 2]) and np.allclose(z[:-29, 2], 0) and (z[-1, 3], len(z)) == (1200, 1199)
        assert (cluster.flat(z, 2) == cluster.flat(z, 2)[0]).sum() in (1000, 200)
    assert kept == [["place", "x"]] * 4


def test_binomial_tails_of_long_lists(spark):
    """Some thousand terms of a million draws, and the sum that all of them have."""
    rows = [(n, 40_000, 1_000_000, x) for n, x in ((1_000_000, 39_000), (1_000_000, 40_000), (1_000_000, 40_900), (900, 0), (900, 60), (5, 6))]
    df = spark.createDataFrame(rows, "n long, k long, m long, x long")
    got = df.select(enrich.binomial_tail(F.col("n"), F.col("k"), F.col("m"), F.col("x")).alias("p"), "n", "x").collect()
    for r in got:
        i = np.arange(1, r.n + 1)
        steps = np.concatenate([[0.0], np.cumsum(np.log(r.n - i + 1) - np.log(i) + np.log(0.04 / 0.96))])
        assert abs(r.p - np.exp(steps + r.n * np.log(0.96))[r.x :].sum()) < 1e-7


def test_spectra_of_a_batch_are_worked_on_in_parts(spark, monkeypatch):
    """Eleven signals of one batch, two at a time: the same powers, and no array of more rows."""
    x = np.random.default_rng(6).normal(size=(11, 12)).tolist()
    s, times = spark.createDataFrame(list(enumerate(x)), "id long, x array<double>").coalesce(1), [float(t) for t in range(12)]
    whole = spectral.lomb_scargle(s, times, oversampling=10).orderBy("id").toPandas()["x"]
    width = len(whole[0])
    monkeypatch.setattr(spectral, "MOST_CELLS", 2 * width + 1)
    step = spectral._mapped(s, lambda c: spectral._arrays(np.full((len(c), 1), float(len(c))), np.zeros(len(c), bool)), width).toPandas()["x"]
    assert {v[0] for v in step} <= {1.0, 2.0}
    assert np.allclose(np.stack(spectral.lomb_scargle(s, times, oversampling=10).orderBy("id").toPandas()["x"]), np.stack(whole))


def test_frequent_keys_of_a_dictionary_stay_where_they_are(spark, monkeypatch):
    """Kinds of forty rows, asked for or not, beside keys of one row: every match, repeated rows too, and no more than these keys broadcast."""
    monkeypatch.setattr(enrich, "FREQUENT", 30)
    rows = [(f"k{i}", "abc"[i // 40] if i < 120 else f"r{i // 3}", None if i % 7 == 0 else f"n{i % 5}") for i in range(150)]
    rows += rows[:3] + rows[-2:] + [(None, None, "n1")]
    ids = ["a", "c", "k5", "k5", "k130", "r41", "n2", "k149", None, "none", "n3"]
    d, asked = spark.createDataFrame(rows, "key string, kind string, name string"), spark.createDataFrame([(i,) for i in ids], "id string")
    got = enrich.translate_all(asked, d, ["name", "key"], ["key", "kind", "name"])
    want = [(s, t, r[c], r[f]) for r in rows for c, s in enumerate(("key", "kind", "name")) if r[c] is not None and r[c] in ids for t, f in (("name", 2), ("key", 0))]
    order = lambda v: sorted(v, key=str)
    assert order(map(tuple, got.collect())) == order(want) and len(want) > 170
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1 and "< 30" in plan and ">= 30" in plan
