import random
import re

import pytest

from tidemark.llm import jaccard


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(docs, k, num, den):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def corpus(seed, size):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([3, 5, 8, 10, 11, 12, 15, 20, 26, 40, 90, 160]))] for _ in range(12)]
    common = [f"c{i}" for i in range(14)]
    docs = []
    for i in range(size):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            act, at = r.randrange(3), r.randrange(len(w) + 1)
            if act == 0:
                w.insert(at, f"n{r.randrange(999)}")
            elif act == 1 and at < len(w):
                w[at] = f"n{r.randrange(999)}"
            else:
                w = w[:at] if at > len(w) - 3 else w
        if r.random() < 0.25:
            w = common + w
        docs.append((i + 1, (" " if r.random() < 0.5 else "\n").join(w).title() if r.random() < 0.3 else " ".join(w)))
    return docs + [(900, None), (901, ""), (902, " \t"), (903, "é"), (904, "É"), (905, "é"), (906, "long " * 4000)]


@pytest.mark.parametrize(("k", "num", "den", "boundary"), [(4, 85, 100, None), (4, 85, 100, 16), (5, 80, 100, None), (1, 80, 100, 12)])
def test_against_brute_force(spark, k, num, den, boundary):
    docs = corpus(k, 150)
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, node int, key string")
    got = sorted(map(tuple, jaccard.join(d, k, num, den, boundary, gate_bits=1 << 16).collect()))
    assert got == brute(docs, k, num, den)


def test_empty_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "A  b c d e"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(d).collect())) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert jaccard.join(d.limit(0)).count() == 0


def test_subset_sizes_cover_every_link():
    m = jaccard.Measure(85, 100)
    for a in range(1, 24):
        for b in range(1, a + 1):
            o = m.overlap(a, b)
            linked = o <= b
            assert linked == (m.least_size(a) <= b)
            if linked and not a == b == o:
                assert o in m.subset_sizes(a, 24) and o in m.subset_sizes(b, 24)


def test_long_lists_of_unlinked_sets(spark, monkeypatch):
    """Sets that share most shingles but aren't linked stay apart, and those that are linked aren't missed, whatever the parts."""
    from tidemark.llm import shared

    monkeypatch.setattr(shared, "LIST_PART", 7)
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        w = list(base)
        for at in r.sample(range(120), 7 if i % 2 else 2):
            w[at] = f"n{i}-{at}"
        docs.append((i, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(d, 1).collect())) == brute(docs, 1, 85, 100)
    assert sorted(map(tuple, jaccard.join(d, 4).collect())) == brute(docs, 4, 85, 100)


def test_sketches_of_several_widths_are_lower_bounds():
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import shared

    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 9000).astype(np.uint64)
    sets = [base[:n] for n in (50, 60, 1500, 2100, 2400, 7000, 8800)] + [np.concatenate([base[:1500], base[8000:8700]])]
    raw = pa.array([shared.parity_sketch(s, 16 if len(s) <= 1800 else 64 if len(s) <= 7200 else 256) for s in sets], pa.binary())
    sketches = shared._Sketches(raw)
    every = np.arange(len(sets))
    far = sketches.far(every, every)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert far[i, j] <= len(np.setxor1d(a, b)) and far[i, i] == 0
    assert (sketches.paired(shared._Sketches(raw.take(pa.array(every[::-1])))) == far[every, every[::-1]]).all()


def test_ids_that_are_null_or_repeated(spark):
    near = " ".join(f"w{i}" for i in range(60))
    docs = [(None, near), (None, near + " x"), (None, "y " + near), (7, "a b c d e"), (7, "f g h i j"), (8, "a b c d e"), (None, None), (9, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.groups(d).collect()
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.doc_id is None) == [(0, None), (57, None), (58, None), (58, None)]
    assert sum(r.leads for r in rows if r.doc_id is None and r.n_shingles) == 1
    assert sorted((r.doc_id, r.component_id, r.leads) for r in rows if r.doc_id is not None) == [(7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True)]
    named = spark.createDataFrame([("b", "a b c d e"), ("a", "a b c d e")], "doc_id string, text string")
    assert {tuple(r) for r in jaccard.join(named).collect()} == {("a", 2, "a"), ("b", 2, "a")}


def roots(docs, k, num, den):
    return [(d, low) for d, _, low in brute(docs, k, num, den)]


def test_large_sets_that_are_nearly_linked_bring_no_payloads(spark, monkeypatch):
    """Sets of 1 700 shingles that agree in 0.72 of them pass the narrow sketches; none of them may go on to be dealt with its payload."""
    from tidemark.llm import shared

    r = random.Random(3)
    base, docs = [f"w{i}" for i in range(1700)], []
    for i in range(16):
        w = list(base)
        for at in r.sample(range(1700), 140):
            w[at] = f"n{i}-{at}"
        docs.append((i, " ".join(w)))
    docs.append((16, docs[5][1].replace("w1", "v1", 40)))
    dealt, spanning = [], shared._spanning

    def counted(members, *rest):
        dealt.append(members.select("node").distinct().count())
        return spanning(members, *rest)

    monkeypatch.setattr(shared, "_spanning", counted)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x.doc_id, x.component_id) for x in jaccard.groups(d, 1, 80, 100).collect())
    assert got == roots(docs, 1, 80, 100) and (16, 5) in got and (15, 15) in got
    assert sum(dealt) <= 2


def test_groups_dealt_in_turns(spark, monkeypatch):
    """A turn deals a bounded share of what the parts of groups repeat, and all turns together miss no link."""
    from tidemark.llm import shared

    for name, value in (("LIST_PART", 5), ("GROUP_PART", 4), ("DEALT", 0.5)):
        monkeypatch.setattr(shared, name, value)
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", 0)
    turns, in_turns = {}, shared._in_turns

    def counted(scratch, n, name, deal):
        turns[name] = max(n, turns.get(name, 0))
        return in_turns(scratch, n, name, deal)

    monkeypatch.setattr(shared, "_in_turns", counted)
    docs = []
    for chain in range(3):  # a text is linked with the two before and after it only
        w = [f"w{i}" for i in range(120)]
        for i in range(16):
            for at in range(4 * i, 4 * i + 4):
                w[at] = f"c{chain}n{i}-{at}"
            docs.append((16 * chain + i, " ".join(w)))
    docs = docs[16:] + docs[:16]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(d, 1).collect())) == brute(docs, 1, 85, 100)
    assert turns["groups"] > 2 and turns["links"] > 2
