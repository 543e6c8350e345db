"""Lists of one mass, groups beyond one task, and cells whose sum hangs on its order."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import cluster, enrich


def test_masses_of_a_list_are_compared_once(spark, monkeypatch):
    """Few masses, many and none, repeated rows: the same pairs; what a list expands to last is not filtered row by row."""
    monkeypatch.setattr(enrich, "PACK", 16)
    monkeypatch.setattr(enrich, "FEW", 4)
    r = np.random.default_rng(8)
    q = np.concatenate([np.repeat(900.0, 70), r.uniform(900, 901, 90), [0.0, -5.0]])
    c = np.concatenate([np.repeat([900.0, 900.1, 900.9], 50), r.uniform(900, 901, 60), [-5.0]])
    queries = spark.createDataFrame(pd.DataFrame({"query": np.arange(len(q)) // 2, "m": q}))
    masses = spark.createDataFrame(pd.DataFrame({"compound": np.arange(len(c)), "mass": c}))
    found = enrich.match_masses(queries, masses, 200)
    want = (c[None] > q[:, None] * (1 - 200e-6)) & (c[None] < q[:, None] * (1 + 200e-6)) & (q[:, None] > 0)
    i, j = np.nonzero(want)
    assert sorted(map(tuple, found.collect())) == sorted(zip((i // 2).tolist(), j.tolist(), strict=True))
    runs = enrich._runs(enrich._packed(masses.select(F.col("compound").alias("id"), "mass"), 50e-6)).select(F.explode("runs").alias("r")).select("r.mass", F.size("r.ids").alias("n")).toPandas()
    assert runs["n"].sum() == len(c) - 1 and (runs["mass"] == 900.0).sum() <= 6 and runs["n"].max() > 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Filter")


def test_cuts_are_scored_from_one_pass_and_copies_count(spark, monkeypatch):
    """Silhouettes of eight cuts take the distances once, and rows that stand for several count as these."""
    monkeypatch.setattr(cluster, "IN_MEMORY", 6)
    r = np.random.default_rng(3)
    x, many = r.normal(size=(24, 4)) + np.repeat(np.eye(4) * 4, 6, 0), r.integers(1, 5, 24)
    points = spark.createDataFrame([(i, v, int(n)) for i, (v, n) in enumerate(zip(x.tolist(), many, strict=True))], "place long, x array<double>, n int")
    z = cluster.linkage(cluster.distances(x, "euclidean"))
    cuts, passes, pairs = [cluster.flat(z, k) for k in range(2, 10)], [], cluster._pairs_of_blocks
    monkeypatch.setattr(cluster, "_pairs_of_blocks", lambda *given: passes.append(1) or pairs(*given))
    got = cluster._mean_silhouettes(points, "euclidean", cuts)
    d = cluster.distances(np.repeat(x, many, 0), "euclidean")
    assert np.allclose(got, [cluster.silhouette(d, np.repeat(own, many)) for own in cuts]) and passes == [1]
    assert np.allclose(got, [cluster.silhouette(cluster.distances(x, "euclidean"), own, many) for own in cuts])


def test_copies_of_a_class_are_one_leaf(spark, monkeypatch):
    """Thirty signals, three times each, with forty to a task: copies stay together and no linkage sees them."""
    monkeypatch.setattr(cluster, "IN_MEMORY", 40)
    seen, found = [], cluster.spread_linkage
    monkeypatch.setattr(cluster, "spread_linkage", lambda *given: seen.append(1) or found(*given))
    x = np.random.default_rng(9).normal(size=(30, 5))
    rows = [("c", i + 100 * k, x[i].tolist(), (x[i] + np.arange(5.0)).tolist()) for i in range(30) for k in range(3)]
    s = spark.createDataFrame(rows, "trend_class string, id long, x array<double>, feature array<double>")
    got = {r.id: r for r in cluster.two_levels(s).collect()}
    assert not seen and sorted(r.leaf_order for r in got.values()) == list(range(90))
    for i in range(30):
        same = [got[i + 100 * k] for k in range(3)]
        assert len({(r.group, r.subgroup) for r in same}) == 1 and [r.leaf_order - same[0].leaf_order for r in same] == [0, 1, 2]


def test_leaves_of_groups_beyond_one_task_are_in_optimal_order(spark, monkeypatch):
    """The sum of neighbouring distances is the least, also where most nodes are larger than a task."""
    x = np.random.default_rng(5).normal(size=(26, 4))
    d = cluster.distances(x, "common")
    z = cluster.linkage(d)
    cost = lambda order: sum(d[a, b] for a, b in zip(order, order[1:], strict=False))
    best = cost(cluster.optimal_leaves(z, d))
    monkeypatch.setattr(cluster, "IN_MEMORY", 11)
    monkeypatch.setattr(cluster, "SLICE", 4)
    points = spark.createDataFrame(list(enumerate(x.tolist())), "place long, x array<double>")
    got = cluster.spread_order(points, z, "common")
    assert sorted(got) == list(range(26)) and abs(cost(got) - best) < 1e-9 < cost(cluster.leaves(z)) - best
    spans = lambda order: {frozenset(order[i:j]) for i in range(26) for j in range(i + 1, 27)}
    under = {v: frozenset([v]) for v in range(26)}
    for step, (a, b) in enumerate(z[:, :2].astype(int)):
        under[26 + step] = under[a] | under[b]
    assert set(under.values()) <= spans(got)
