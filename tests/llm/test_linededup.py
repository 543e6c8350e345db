import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text("ab", max_size=12), st.text("abé", max_size=12), st.integers(0, 4))
def test_banded_distance(a, b, k):
    assert linededup.within(a, b, k) == (distance(a, b) <= k)


def brute(docs, edits, least):
    lines = [(d, i, x) for d, t in dict.fromkeys(docs) if t is not None for i, x in enumerate(t.split("\n")) if len(x) >= least]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, _, x) in enumerate(lines):
        for j in range(i):
            y = lines[j][2]
            if abs(len(x) - len(y)) <= edits and find(i) != find(j) and (x == y or max(len(x), len(y)) < 999 and distance(x, y) <= edits):
                root[find(i)] = find(j)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    first = {}
    for i, r in enumerate(lines):
        k = find(i)
        first[k] = min(first.get(k, r), r, key=order)
    gone = {}
    for i, r in enumerate(lines):
        if r[:2] != first[find(i)][:2]:
            gone.setdefault(r[0], set()).add((r[1], r[2]))
    out = []
    for d, t in docs:
        ls = t.split("\n") if t is not None else []
        keep = [x for i, x in enumerate(ls) if (i, x) not in gone.get(d, ())]
        out.append((d, len(ls), len(ls) - len(keep), None if t is None else "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("edits", "least"), [(2, 32), (1, 10), (3, 20), (0, 5)])
def test_against_brute_force(spark, edits, least):
    r = random.Random(edits)
    base = ["".join(r.choices("abcdé ", k=r.choice([4, 9, 10, 20, 31, 32, 33, 50, 90]))) for _ in range(14)]

    def vary(x):
        x = list(x)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
            at, act = r.randrange(len(x) + 1), r.randrange(3)
            x[at : at + (act > 0)] = r.choice("xyzé") if act < 2 else ""
        return "".join(x)

    docs = [(i, "\n".join(vary(r.choice(base)) for _ in range(r.randint(0, 6)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, base[8] + "\n" + base[7]), (103, "long " * 3000), (104, "long " * 3000), (5, docs[5][1]), (5, docs[5][1])]
    d = spark.createDataFrame([(a, b, "x", 3) for a, b in docs], "doc_id long, text string, key string, n_lines int")
    got = sorted(((x.doc_id, x.n_lines, x.n_removed, x.text) for x in linededup.dedup(d, edits, least, 1 << 14).collect()), key=str)
    assert got == brute(docs, edits, least)


def test_empty_table(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_batches_of_pairs_agree_with_single_pairs():
    r = random.Random(5)
    for edits in (0, 1, 2, 3, 5):
        a, b = [], []
        for _ in range(300):
            x = "".join(r.choices("abé", k=r.randrange(60)))
            y = list(x)
            for _ in range(r.randrange(2 * edits + 2)):
                at, act = r.randrange(len(y) + 1), r.randrange(3)
                y[at : at + (act > 0)] = r.choice("abc") if act < 2 else ""
            a.append(x)
            b.append("".join(y) if r.random() < 0.9 else "".join(r.choices("abé", k=r.randrange(60))))
        want = [linededup.within(x, y, edits) for x, y in zip(a, b, strict=True)]
        assert linededup.within_many(a, b, linededup.Budget(edits, 0)).tolist() == want and any(want)


def test_ids_that_are_null_repeated_or_text(spark):
    line = "the very same line of more than thirty-two characters"
    d = spark.createDataFrame([(None, line + "\nfirst text"), (None, line + "\nsecond text"), (7, "a line of its own, again and again\nx"), (7, "a line of its own, again and again\ny")], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in linededup.dedup(d).collect()]
    assert sorted(got, key=str) == [(7, 0), (7, 1), (None, 0), (None, 1)]
    named = d.selectExpr("concat('d', cast(coalesce(doc_id, 1) as string)) as doc_id", "text")
    assert sum(r.n_removed for r in linededup.dedup(named).collect()) == 2
