"""Communities, corrections, drivers, the choice of k and time grids by worked values."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import cluster, community, enrich, model, subjects, transform, visibility
from tidemark.streaming import ingest


def line(lengths):
    n = len(lengths) + 1
    return community.Graph(n, np.arange(n - 1), np.arange(1, n), np.array(lengths, float))


def test_cutoff_compares_with_the_median_of_all_path_lengths():
    # lengths 1, 1, 5, 1: all pairs are 1, 1, 1, 2, 5, 6, 6, 7, 7, 8, their median 5.5; hubs are all nodes
    edge = line([1, 1, 5, 1])
    d = community.shortest(edge)
    assert sorted(d[np.triu_indices(5, 1)]) == [1, 1, 1, 2, 5, 6, 6, 7, 7, 8]
    # sorted ends and hub distances are 1, 1, 1, 1, 5, 8 with the widest gap from 1 to 5
    assert community._gap_cut(d, [0, 1, 2, 3, 4]) == 1
    assert community.by_path_length(edge).tolist() == [0, 0, 1, 2, 2]
    # 1, 2, 6: pairs 1, 2, 3, 6, 8, 9 with median 4.5; the widest gap of 1, 1, 2, 6, 9 starts at 2, above the hubs' own median
    edge = line([1, 2, 6])
    assert community._gap_cut(community.shortest(edge), [0, 1, 2, 3]) == 2
    # one gap is kept: of 4 and 4 no cut lies under the median
    assert community._gap_cut(np.array([[0, 4.0], [4, 0]]), [0, 1]) == 4


def test_betweenness_looks_at_the_mirrored_series(spark):
    x = [0.0, 5.0, 1.0, 6.0, 0.5, 5.0, 0.0]
    points = visibility.nodes(spark.createDataFrame([(1, float(i), v) for i, v in enumerate(x)], "id long, t double, x double"))
    got = [r.community for r in community.of_series(points, "betweenness", least=2).orderBy("node").collect()]
    ends = []
    for i in range(7):
        for j in range(i + 1, 7):
            if all((-x[k] - -x[i]) / (k - i) <= (-x[j] - -x[i]) / (j - i) for k in range(i + 1, j)):
                ends.append((i, j))
    node, _ = community.betweenness(community.Graph(7, *zip(*ends, strict=True), np.ones(len(ends))), np.ones(7, bool))
    cut = int(np.round(node, 9).argmax())
    assert got == [int(i >= cut) if cut else 0 for i in range(7)]


def test_ties_are_visible_in_edge_splits(spark):
    points = visibility.nodes(spark.createDataFrame([(1, float(i), 1.0) for i in range(3)], "id long, t double, x double"))
    assert visibility.edges(points, through=True).count() == 3 and visibility.edges(points).count() == 2
    assert [r.community for r in community.of_series(points, "edges", least=2).orderBy("node").collect()] in ([0, 1, 1], [0, 0, 1])


def test_automatic_correction_by_list(spark):
    bridge = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t"), ("d", "u")], "id string, term string")
    rows = [("p", "a", "x"), ("p", "a", "y"), ("p", "a", "y"), ("p", "b", "x"), ("q", "b", "x"), ("q", "c", "x")]
    lists = spark.createDataFrame(rows, "list_name string, id string, label string")
    found = lambda how: {(r.list_name, r.k_family, r.m_total) for r in enrich.enrich(lists, bridge, multiple_lists=True, correction=how).collect()}
    assert found("auto") == {("p", 9, 12), ("q", 3, 4)} and found("auto_all") == {("p", 9, 12), ("q", 9, 12)} and found(2) == {("p", 6, 8), ("q", 6, 8)}
    assert {r.m_total for r in enrich.enrich(lists, bridge, correction="auto").collect()} == {4}
    with pytest.raises(ValueError):
        enrich.enrich(lists, bridge, correction="some")


def test_tail_is_exact(spark):
    cases = [(1, 3, 2, 10), (2, 3, 2, 10), (5, 40, 60, 500), (0, 3, 3, 5), (900, 1000, 2000, 3000), (30, 1000, 20000, 1000000)]
    got = enrich.hypergeometric(spark.createDataFrame(cases, "x_hits long, n_list long, k_family long, m_total long")).collect()
    for r in got:
        x, n, k, m = (int(v) for v in r[:4])
        want = sum(math.comb(k, i) * math.comb(m - k, n - i) for i in range(x, min(n, k) + 1)) / math.comb(m, n)
        assert r.p_value == pytest.approx(want, rel=1e-6)


def test_drivers(spark):
    genes = spark.createDataFrame([("hsa:a", "p1"), ("hsa:b", "p1"), ("hsa:c", "p2"), ("hsa:a", "p3"), ("hsa:c", "p3")], "id string, term string")
    compounds = spark.createDataFrame([("a", "m1"), ("b", "m1")], "id string, term string")
    data = {"one": ["a", "b"], "two": [["a", "note"]]}
    rows = enrich.kegg_analysis(data, "All", genes, compounds, only_significant=False).collect()
    # p2 has one id and is too short
    assert {(r.analysis, r.list_name, r.term) for r in rows} == {("Genomic", "one", "p1"), ("Genomic", "one", "p3"), ("Genomic", "two", "p1"), ("Genomic", "two", "p3"), ("Molecular", "one", "m1"), ("Molecular", "two", "m1")}
    assert {r.m_total for r in rows if r.analysis == "Genomic"} == {3}
    with pytest.raises(ValueError):
        enrich.kegg_analysis(data, "Other", genes)
    clusters = spark.createDataFrame([("LAG1", "a", 1, 1), ("LAG1", "b", 1, 2), (None, "b", 1, 1)], "trend_class string, id string, group int, subgroup int")
    terms = spark.createDataFrame([("p1", "name", "space")], "term string, name string, namespace string")
    go = enrich.go_analysis(clusters, genes.withColumn("id", F.substring("id", 5, 9)), terms, only_significant=False).collect()
    assert {(r.list_name, r.term, r.name) for r in go} == {("LAG1:1:1", "p1", "name"), ("LAG1:1:1", "p3", None), ("LAG1:1:2", "p1", "name"), (":1:1", "p1", "name")}


def test_dictionary_union(spark):
    old = spark.createDataFrame([("h", "a", 1), ("m", "b", 2)], "species string, id string, v int")
    new = spark.createDataFrame([("h", "c", 3)], "species string, id string, v int")
    assert sorted(map(tuple, enrich.union_dictionaries(old, new).collect())) == [("h", "c", 3), ("m", "b", 2)]


def test_choice_of_k(spark):
    scores = {k: 0.5 + 0.4 * math.exp(-((k - 8) ** 2) / 4) + (0.6 if k == 3 else 0) for k in range(2, 16)}
    assert cluster.best_k(scores) == 8  # the peak at 3 is too low a number
    assert cluster.best_k({k: 1.0 / k for k in range(2, 12)}) == 5
    r = np.random.default_rng(0)
    rows = [(i, (np.array([10.0 * (i % 3), 5.0 * (i % 3 == 1)]) + r.normal(0, 0.1, 2)).tolist()) for i in range(60)]
    s = spark.createDataFrame(rows, "id long, x array<double>")
    best, found = cluster.optimise_k(s, [2, 3, 4])
    assert best == 3 and found[3] > 0.9
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, cluster int")
    line = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [4.0])], "id long, x array<double>")
    # (4 - 1) / 4, (3 - 1) / 3 and 0 for the singleton
    assert cluster.euclidean_silhouette(line, labels) == pytest.approx((0.75 + 2 / 3) / 3)


def test_elbow_by_hand():
    z = np.zeros((8, 4))
    z[:, 2] = [1, 1.1, 1.2, 1.3, 1.4, 1.5, 6, 7]
    # from the top 7, 6, 1.5, 1.4, 1.3, 1.2; second differences -3.5, 4.4, 0, 0
    assert cluster.elbow(z) == 2


def test_classes_flow(spark):
    x = [[math.sin(0.3 * (i + 1) * t) for t in range(12)] for i in range(6)]
    s = spark.createDataFrame(list(enumerate(x)), "id long, x array<double>")
    classes = spark.createDataFrame([(0, "LAG1"), (1, "LAG1"), (2, "LAG9"), (3, "SpikeMax"), (4, None), (5, "SpikeMax")], "id long, trend_class string")
    rows = cluster.class_clusters(s, classes, s, lags=3).collect()
    assert {(r.trend_class, r.id) for r in rows} == {("LAG1", 0), ("LAG1", 1), ("SpikeMax", 3), ("SpikeMax", 5)}
    assert all(list(r.x) == x[r.id] == list(r.feature) for r in rows)


def test_quantile_aggregates(spark):
    s = spark.createDataFrame([(1, [1.0, 4.0]), (2, [1.0, 9.0]), (3, [7.0, 2.0])], "id long, x array<double>")
    got = {(r.id, r.t): r.x for r in transform.quantile_normalise(s, "max", "sum").collect()}
    # ranks of the first point 1, 1, 7 and of the second 2, 4, 9 give weights 2, 4, 9
    assert got == {(1, 0): 6.0, (2, 0): 6.0, (3, 0): 9.0, (3, 1): 2.0, (1, 1): 4.0, (2, 1): 9.0}
    even = transform.quantile_transform(spark.createDataFrame([(i, [v]) for i, v in enumerate([1.0, 2.0, 2.0, 5.0])], "id long, x array<double>"))
    assert sorted(round(r.x, 9) for r in even.collect()) == [0.0, 0.5, 0.5, 1.0]


def test_gaps_are_linked_with_none(spark):
    rows = [("a", 1, [1.0, 2.0, 4.0]), ("b", 1, [1.0, 2.0, None]), ("a", 2, [1.0, 2.0, 4.0]), ("b", 2, [1.0, 2.0, 5.0])]
    s = spark.createDataFrame(rows, "subject string, id long, x array<double>")
    for f, cut in ((subjects.links_by_distance, 2.0), (subjects.links_by_correlation, 0.5)):
        assert [(r.linked, r.common, r.ids) for r in f(s, cut).collect()] == [(1, 2, [2])]
        assert [(r.linked, r.common) for r in f(s, cut, complete=False).collect()] == [(2, 2)]


def test_points_outside_the_grid_are_errors(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 5, 2.0)], "id long, t int, x double")
    assert model.from_long(rows, 6).first().x == [1.0, None, None, None, None, 2.0]
    with pytest.raises(PySparkException):
        model.from_long(rows, 5).collect()


def test_stream_cells_of_two_months(spark):
    events = spark.createDataFrame([(1, datetime(2024, 1, 31, 5), 1.0), (1, datetime(2024, 1, 31, 6), 1.0), (1, datetime(2024, 2, 2), 3.0), (2, datetime(2024, 2, 1), 4.0)], "user_id long, ts timestamp, value double")
    got = {r.id: r.x for r in ingest.signals(ingest.daily_cells(events)).collect()}
    assert got == {1: [2.0, None, 3.0], 2: [None, 4.0, None]}
