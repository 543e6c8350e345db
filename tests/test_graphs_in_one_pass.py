"""Visibility in one pass and sparse path search, against every pair and every path."""

import itertools
import time

import numpy as np
import pytest

from tidemark.operators import community, visibility


def brute(t, x, kind, through):
    out = []
    for i, j in itertools.combinations(range(len(x)), 2):
        line = lambda k, i=i, j=j: x[i] + (x[j] - x[i]) * (t[k] - t[i]) / (t[j] - t[i]) if kind == "natural" else min(x[i], x[j])
        if all(x[k] < line(k) - (kind == "natural") * 1e-9 or (through and x[k] <= line(k) + 1e-9 * (kind == "natural")) for k in range(i + 1, j)):
            out.append((i, j))
    return out


@pytest.mark.parametrize("through", [False, True])
@pytest.mark.parametrize("kind", visibility.KINDS)
def test_edges_of_every_pair(kind, through):
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 9, 25):
        for spread in (2, 4, 1000):
            t, x = np.cumsum(r.integers(1, 3, n)).astype(float), r.integers(-spread, spread, n).astype(float)
            i, j = visibility.FIND[kind](t, x, through)
            assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == brute(t, x, kind, through)


def test_dual_weights():
    t, x = np.arange(4.0), np.array([1.0, -3.0, 2.0, -1.0])
    for kind in visibility.KINDS:
        up = dict(zip(zip(*visibility.graph(t, x, kind)[:2], strict=True), [1] * 9, strict=False))
        down = dict(zip(zip(*visibility.graph(t, -x, kind)[:2], strict=True), [1] * 9, strict=False))
        i, j, w = visibility.dual(t, x, kind)
        assert {(a, b): c for a, b, c in zip(i, j, w, strict=True)} == {k: 1 if k in up else -1 for k in up | down}


def test_bars_of_both_sides(spark):
    p = visibility.points(spark.createDataFrame([(1, [1.0, None, -3.0, 2.0, -1.0]), (2, [None, None, None, None, 4.0]), (3, None)], "id long, x array<double>"))
    rows = [(r.id, r.i, r.j, r.xi, r.xj, r.level, r.side) for r in visibility.bars(p, "horizontal", two_sided=True).orderBy("i", "j").collect()]
    assert rows == [(1, 0, 1, 1.0, -3.0, 0.0, 1), (1, 0, 2, 1.0, 2.0, 1.0, 1), (1, 1, 2, -3.0, 2.0, 0.0, 1), (1, 1, 3, -3.0, -1.0, -1.0, -1), (1, 2, 3, 2.0, -1.0, 0.0, 1)]
    assert {(r.id, r.node, r.degree) for r in visibility.degrees(p, "horizontal").collect()} == {(1, 0, 2), (1, 1, 2), (1, 2, 3), (1, 3, 1)}


def test_no_join_and_no_window(spark):
    s = spark.createDataFrame([(1, [1.0, 2.0])], "id long, x array<double>")
    for f in (visibility.edges, visibility.dual_edges, visibility.degrees, visibility.bars, community.of_series):
        plan = f(visibility.points(s))._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Join", "Window", "Exchange"))


def random_graph(n, seed, tree=False):
    r = np.random.default_rng(seed)
    ends = {tuple(sorted(p)) for p in [(k, int(r.integers(0, k))) for k in range(1, n)] + ([] if tree else [tuple(r.choice(n, 2, replace=False).tolist()) for _ in range(n)])}
    i, j = np.array(sorted(ends)).T
    return community.Graph(n, i, j, r.integers(1, 6, len(i)))


def floyd(g, unit=False):
    d = np.full((g.n, g.n), np.inf)
    np.fill_diagonal(d, 0)
    d[g.i, g.j] = d[g.j, g.i] = 1 if unit else g.w
    for k in range(g.n):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return d


def count(g):
    """Betweenness by listing every shortest path."""
    d, node, links = floyd(g, True), np.zeros(g.n), dict.fromkeys([(min(p), max(p)) for p in zip(g.i.tolist(), g.j.tolist(), strict=True)], 0.0)

    def paths(a, b):
        return [[a]] if a == b else [[a, *p] for v in g.near(a)[0].tolist() if d[v, b] == d[a, b] - 1 for p in paths(v, b)]

    for a, b in itertools.combinations(range(g.n), 2):
        every = paths(a, b) if np.isfinite(d[a, b]) else []
        for p in every:
            node[p[1:-1]] += 1 / len(every)
            for e in itertools.pairwise(p):
                links[min(e), max(e)] += 1 / len(every)
    return node, links


@pytest.mark.parametrize("seed", range(5))
def test_lengths_and_betweenness(seed, monkeypatch):
    monkeypatch.setattr(community, "PAIRS", 100)
    g = random_graph(14, seed)
    assert (community.shortest(g) == floyd(g)).all()
    node, links = community.betweenness(g, np.ones(g.n, bool))
    want = count(g)
    assert np.allclose(node, want[0]) and links == pytest.approx(want[1])


@pytest.mark.parametrize("seed", range(6))
def test_splits_count_only_changed_sources_again(seed):
    """Like counting everything again after each edge."""
    g = random_graph(16, seed, tree=seed % 2 == 0)
    got = community.by_edge_splits(g, 4)
    while (part := community.parts(g)).max() + 1 < 4:
        links = count(g)[1]
        a, b = max(sorted(links), key=lambda e: round(links[e], 9))
        g = g.without(edge=int(np.flatnonzero((np.minimum(g.i, g.j) == a) & (np.maximum(g.i, g.j) == b))[0]))
    assert got.tolist() == part.tolist()


def test_two_thousand_points():
    x = np.cumsum(np.random.default_rng(1).normal(size=2000))
    g = community.Graph(2000, *visibility.graph(np.arange(2000.0), x, "natural", "distance"))
    began = time.process_time()
    own = community.by_path_length(g, "left")
    assert len(own) == 2000 and own.max() > 0 and time.process_time() - began < 60
    began = time.process_time()
    assert community.by_betweenness(g, 2).max() == 1 and time.process_time() - began < 90
