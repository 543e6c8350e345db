import hashlib

import numpy as np
import pytest

from tidemark.llm import vectorcodes


def nearest(q, entries):
    d = ((q[:, None].astype(object) - entries[None]) ** 2).sum(2)
    return [min(range(len(entries)), key=lambda e: (row[e], e)) for row in d], [min(row) for row in d]


@pytest.mark.parametrize(("entries", "width", "spread"), [(1, 3, 5), (16, 8, 4000), (16, 2, 3), (40, 4, 2), (256, 3, 9)])
def test_tree_finds_the_lowest_of_the_nearest(entries, width, spread):
    r = np.random.default_rng(entries)
    e, q = r.integers(-spread, spread, (entries, width)), r.integers(-spread, spread, (500, width))
    at, d = vectorcodes.Tree(e).nearest(q)
    index, least = nearest(q, e)
    assert at.tolist() == index and d.tolist() == least


def test_equal_bounds_are_visited():
    e = np.array([[4, 0], [0, 0], [4, 0], [0, 0], [8, 0]])
    assert vectorcodes.Tree(e, leaf=1).nearest(np.array([[2, 0], [6, 0], [0, 0], [2, 7]]))[0].tolist() == [0, 0, 1, 0]


def test_a_tree_prunes():
    r = np.random.default_rng(3)
    tree = vectorcodes.Tree(r.integers(-4000, 4000, (256, 2)))
    seen = []
    bound = tree.bound
    tree.bound = lambda node, q: seen.append(len(q)) or bound(node, q)
    tree.nearest(r.integers(-4000, 4000, (1000, 2)))
    assert sum(seen) < 1000 * len(tree.kids) / 3


def plain(rows):
    """(code, error) by id, and the digest, by loops over Python's integers."""
    import math

    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v in kept[:16]] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((gap(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        found = [[near(v, p)[1] for p in range(8)] for _, v in kept]
        for p in range(8):
            for k in range(len(books[p])):
                mine = [part(v, p) for (_, v), f in zip(kept, found, strict=True) if f[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    last = {i: [near(v, p) for p in range(8)] for i, v in kept}
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in last.items()}, digest


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string")


def test_like_plain_python(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=16).round(2).tolist(), None if i % 3 == 0 else i % 4) for i in range(60)]
    rows += [(100, None, 1), (101, [None] + [0.0] * 15, 1), (102, [float("nan")] * 16, 1), (103, [float("-inf")] * 16, None), (104, rows[5][1], 2)]
    found, digest = plain(rows)
    out = {x.vec_id: x for x in vectorcodes.report(vectors(spark, rows)).collect()}
    assert {i: (x.code, x.error) for i, x in out.items()} == found
    assert {x.codebooks_sha256 for x in out.values()} == {digest}
    label = {i: lab for i, _, lab in rows}
    for i, x in out.items():
        assert x.label_error == sum(e for j, (_, e) in found.items() if label[j] == label[i])


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(i, [float((i * k) % 7) for k in range(8)], i % 5 if i % 2 else None) for i in range(50)]
    key = lambda d: sorted(map(tuple, d.collect()))
    want = key(vectorcodes.report(vectors(spark, rows)))
    monkeypatch.setattr(vectorcodes, "MOST_LABELS", 2)
    assert key(vectorcodes.report(vectors(spark, rows))) == want


def test_edges(spark):
    one = [0.5, -0.5] * 4
    assert vectorcodes.report(vectors(spark, [(1, one, 0)]).limit(0)).count() == 0
    out = vectorcodes.report(vectors(spark, [(7, one, 0), (7, one, 0), (None, [1e300] * 8, 0), (8, [1.0] * 5, 1), (9, [], 1), (3, None, 1)])).collect()
    # both first entries are equal: all rows go to the lower one, which then moves to the far row without an id
    assert sorted((x.vec_id or 0, x.code, x.error) for x in out if x.code) == [(0, "00" * 8, 0), (7, "01" * 8, 0), (7, "01" * 8, 0)]
    assert sorted(x.vec_id for x in out if x.code is None) == [8, 9]
    assert {x.code for x in vectorcodes.report(vectors(spark, [(None, one, 0)])).collect()} == {None}
    assert {x.error for x in vectorcodes.report(vectors(spark, [(1, [1.0] * 5, 0), (2, one, 0)])).collect()} == {None}
