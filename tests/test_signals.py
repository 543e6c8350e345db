"""Worked values of the signal operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import categorize, clean, cluster, community, model, spectral, transform, visibility

N = None
ROWS = {
    1: [0.5, 2, 3], 2: [0, 2, 6], 3: [7, 3, 0], 4: [2, 2, 8], 5: [1, N, N], 6: [6, 0, 0], 7: [0, 0, 0], 8: [3, 3, 3.1], 9: [3, 2, N], 10: [4, N, 4],
}


def frame(spark, rows):
    return spark.createDataFrame([(k, [None if v is None else float(v) for v in x]) for k, x in rows.items()], "id long, x array<double>")


def out(s):
    return {r.id: [v if v is None else round(v, 6) for v in r.x] for r in s.collect()}


def near(a, b, tol=2e-6):
    return len(a) == len(b) and all((p is None) == (q is None) and (p is None or abs(p - q) <= tol) for p, q in zip(a, b, strict=True))


def test_cleaning_chain(spark):
    s = clean.drop_all_zero(frame(spark, ROWS))
    assert sorted(out(s)) == [1, 2, 3, 4, 5, 6, 8, 9, 10]
    s = clean.drop_zero_at(s)
    assert sorted(out(s)) == [1, 3, 4, 5, 6, 8, 9, 10]
    s = clean.drop_constant(s, 0.2)
    assert sorted(out(s)) == [1, 3, 4, 6, 9]
    s = clean.keep_nonzero_fraction(s, 0.6)
    assert sorted(out(s)) == [1, 3, 4, 9]
    s = clean.keep_present_fraction(s, 0.8)
    assert sorted(out(s)) == [1, 3, 4]
    s = clean.tag_missing(s.unionByName(frame(spark, {11: [2, 0, 6]})))
    assert out(s)[3] == [7, 3, None] and out(s)[11] == [2, None, 6]
    assert out(clean.floor_low(clean.fill_missing(s), 1.0, 1.0)) == {1: [1, 2, 3], 3: [7, 3, 1], 4: [2, 2, 8], 11: [2, 1, 6]}


LAST = {1: [1, 2, 3], 3: [7, 3, 1], 4: [2, 2, 8], 11: [2, 1, 6]}


def test_transforms(spark):
    s = frame(spark, LAST)
    z = {}
    for r in transform.modified_z_columns(s).collect():
        z.setdefault(r.id, {})[r.t] = r.z
    want = {1: [-1.348979, 0, -0.404694], 3: [6.744897, 1.348979, -0.944286], 4: [0, 0, 0.944286], 11: [0, -1.348979, 0.404694]}
    assert all(near([z[k][t] for t in range(3)], v) for k, v in want.items())
    unit = out(transform.unit_norm(s))
    assert near(unit[1], [0, 0.447214, 0.894427]) and near(unit[3], [0, -0.5547, -0.83205]) and near(unit[11], [0, -0.242536, 0.970143])
    q = {}
    for r in transform.quantile_normalise(frame(spark, {1: [5, 4, 3], 2: [2, 1, 4], 3: [3, 4, 6], 4: [4, 2, 8]})).collect():
        q.setdefault(r.id, {})[r.t] = r.x
    want = {1: [5.666667, 5.166667, 2], 2: [2, 2, 3], 3: [3, 5.166667, 4.666667], 4: [4.666667, 3, 5.666667]}
    assert all(near([q[k][t] for t in range(3)], v) for k, v in want.items())
    assert out(transform.unit_norm(frame(spark, {1: [2, 2, 2]})))[1] == [None] * 3
    with pytest.raises(ValueError):
        transform.compare_to_point(s, "middle")


def test_box_cox(spark):
    got = transform.box_cox_fitted(frame(spark, {1: np.exp(np.linspace(0, 3, 40)).tolist(), 2: [1, 1, None], 3: [-1, 0, 5]})).collect()
    lam = {r.id: r.lam for r in got}
    assert lam[2] is None and lam[3] is None and abs(lam[1]) < 0.2
    x = out(transform.box_cox(frame(spark, {1: [4, 0, -2, None]}), 0.5))[1]
    assert x == [2, 0, -2, None]


TIMES = [float(t) for t in range(12)]
WAVE = [math.cos(2 * math.pi * t / 6) + 0.1 * t for t in TIMES]


def test_spectra(spark):
    gap = [None if t == 3 else v for t, v in enumerate(WAVE)]
    s = frame(spark, {1: WAVE, 2: gap})
    assert near(spectral.frequencies(TIMES), [0.099174, 0.198347, 0.297521, 0.396694, 0.495868, 0.595041])
    p = out(spectral.lomb_scargle(s, TIMES))
    assert near(p[1], [0.903914, 3.320928, 0.382473, 0.136194, 0.247703, 0.086447])
    assert near(p[2], [0.360082, 2.42612, 0.508788, 1.158771, 0.403856, 0.840377])
    a = out(spectral.autocorrelation(s, TIMES))
    assert near(a[1], [1, 0.21991, -0.451121, -0.704669, -0.388387, 0.081014])
    assert near(a[2], [1, -0.132001, -0.399189, -0.567678, -0.341539, 0.082672])
    assert [len(spectral.frequencies([float(t) for t in range(n)])) for n in (10, 12, 14, 15, 16, 24, 26)] == [5, 6, 7, 6, 8, 12, 13]


def pairs(text):
    return {(int(p[0]), int(p[1])) for p in text.split()}


def test_visibility(spark):
    s = frame(spark, {1: [3, 1, 2, 5, 2, 2, 4, 0]})
    points = visibility.points(s)
    assert points.collect() == visibility.nodes(model.to_long(s)).collect()
    got = lambda e: {(r.i, r.j) for r in e.collect()}
    natural = pairs("01 02 03 12 13 23 34 35 36 45 46 56 67")
    flat = pairs("01 02 03 12 23 34 36 45 56 67")
    assert got(visibility.edges(points)) == natural
    assert got(visibility.edges(points, "horizontal")) == flat
    assert got(visibility.edges(points, "horizontal", through=True)) == flat | pairs("35 46")
    assert got(visibility.dual_edges(points)) == natural
    below = points.withColumn("x", F.transform("x", lambda v: -v))
    assert got(visibility.edges(below)) == pairs("01 12 14 15 17 23 24 27 34 45 47 56 57 67")
    line = visibility.points(frame(spark, {1: [0, 1, 2, 3]}))
    assert len(got(visibility.edges(line))) == 3 and len(got(visibility.edges(line, through=True))) == 6


def test_communities(spark):
    x = [math.cos(0.5 * t) * 3 for t in range(30)]
    points = visibility.points(frame(spark, {1: x, 2: [1.0]}))
    for method in community.METHODS:
        rows = community.communities(points, method, weight="distance", two_sided=True).collect()
        assert sorted((r.id, r.node) for r in rows) == [(1, i) for i in range(30)] + [(2, 0)]
        assert len({r.community for r in rows if r.id == 1}) >= (1 if method == "path" else 2)


def test_betweenness_of_a_path():
    e = community.Graph(5, np.arange(4), np.arange(1, 5), np.ones(4))
    node, links = community.betweenness(e, np.ones(5, bool))
    assert node.tolist() == [0, 3, 4, 3, 0] and links == {(0, 1): 4, (1, 2): 6, (2, 3): 6, (3, 4): 4}
    assert community.backbone(e, community.shortest(e)) == [0, 1, 2, 3, 4]


def test_linkage_and_groups():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.1, (6, 3)), r.normal(5, 0.1, (5, 3)), r.normal(-5, 0.1, (4, 3))])
    d = cluster.distances(x, "euclidean")
    for method in ("single", "complete", "average", "weighted"):
        z = cluster.linkage(d, method)
        labels = cluster.flat(z, 3)
        assert len(set(labels)) == 3 and len(set(labels[:6])) == len(set(labels[6:11])) == len(set(labels[11:])) == 1
        assert sorted(cluster.leaves(z)) == sorted(cluster.optimal_leaves(z, d)) == list(range(15))
        cost = lambda o: sum(d[a, b] for a, b in zip(o, o[1:], strict=False))
        assert cost(cluster.optimal_leaves(z, d)) <= cost(cluster.leaves(z)) + 1e-9
        assert z[-1, 3] == 15
    assert cluster.silhouette(d, labels) > 0.8
    gap = np.where(r.random(x.shape) < 0.2, np.nan, x)
    c = cluster.distances(gap, "common")
    both = ~np.isnan(gap[0]) & ~np.isnan(gap[7])
    assert abs(c[0, 7] - np.sqrt(((gap[0] - gap[7])[both] ** 2).sum())) < 1e-9


def test_classes_are_disjoint(spark):
    r = np.random.default_rng(3)
    rows = {i: (np.cos(2 * np.pi * np.arange(12) / 12 + i) * 20 + 40 + r.normal(0, 1, 12)).tolist() for i in range(10)}
    rows |= {i: (r.random(12) * 20 + 30).tolist() for i in range(10, 40)}
    got = categorize.categorise(frame(spark, rows), TIMES, samples=100).collect()
    assert sorted(x.id for x in got) == list(range(40))
    assert all(x.trend_class is None or x.trend_class.startswith(("LAG", "Spike")) for x in got)
    assert sum((x.trend_class or "").startswith("LAG") for x in got if x.id < 10) >= 8
