import random
import re
from collections import Counter

import pytest

from tidemark.llm import substring


def brute(docs, window):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, cut, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("window", "anchor", "bits"), [(35, 6, 1 << 26), (35, 6, 1 << 8), (8, 3, 1 << 16), (5, 5, 1 << 16)])
def test_against_brute_force(spark, window, anchor, bits):
    r = random.Random(window + bits)
    word = lambda n: f"w{r.randrange(n)}"
    passages = [[word(10**6) for _ in range(r.choice([20, 34, 35, 36, 60, 150]))] for _ in range(8)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(r.randint(0, 4)):
            p = list(r.choice(passages))
            if r.random() < 0.5:
                p[r.randrange(len(p))] = word(10**6)
            if r.random() < 0.4:
                a = r.randrange(len(p))
                p = p[a:] + [word(10**6)]
            w += p + [word(5) for _ in range(r.randint(0, 30))]
        docs.append((i, r.choice([" ", "\n ", "\t"]).join(w)))
    docs += [(500, None), (501, ""), (502, "same " * 300), (503, "a b " * 60), (504, "a b " * 60), (505, docs[5][1]), (505, docs[5][1]), (506, "é " * 36)]
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, key string, spans int")
    assert sorted(map(tuple, substring.strip(d, window, anchor, bits).collect())) == brute(docs, window)


def test_empty_table(spark):
    assert substring.strip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_that_repeat_by_chance_are_not_held(spark, monkeypatch):
    """Minimizers that recur without a longer passage give no rows, and no table but the result stays."""
    r = random.Random(4)
    phrases = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(20)]
    texts = [" ".join(x for i in range(30) for x in (r.choice(phrases), *(f"d{d}i{i}w{j}" for j in range(9)))) for d in range(40)]
    passage = " ".join(f"s{i}" for i in range(50))
    texts = [*texts, texts[0] + " " + passage, texts[1] + " " + passage + " end"]
    rows, made = {}, []
    keep = substring.Scratch.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        rows[name] = out.count()
        made.append(self)
        return out

    monkeypatch.setattr(substring.Scratch, "keep", kept)
    docs = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    assert substring.repeated_spans(substring._keyed(docs)).count() == 0
    # a path or edge that passes a gate of 8 million bits by chance is still one of a few
    assert rows["paths"] <= 5 and rows["edges"] <= 5
    assert len(made[-1].live) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, substring.strip(docs).collect())) == brute(list(enumerate(texts)), 35)


def test_digests_are_of_the_words_at_their_coordinates():
    from hashlib import blake2b

    import numpy as np
    import pyarrow as pa

    texts = ["a  bb\tccc", "d e", "", "f\n\n g ", " h", None, "é à\r\n ü"]
    part, offs = substring.wh.strings(pa.array(texts))
    starts, ends, first = substring.wh.words(part, offs, substring.wh.SPACE_WORDS)
    spans, want = [], []
    for t, x in zip(texts, first, strict=False):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                spans.append((x + i, x + j))
                want.append(blake2b(" ".join(w[i:j]).encode(), digest_size=16).digest())
    begin, end = np.array(spans).T
    assert substring.digests(part, starts, ends, begin, end) == want
    assert substring.digests(part, starts, ends, begin[:0], end[:0]) == []


def test_neighbours_are_joined_from_branch_to_branch(spark):
    # 1 2 3 always follow each other; 4 comes after 3 or alone; 5 has two ways in; 6 is never a neighbour, but for a gap
    rows = [(0, n, "x", at, 2) for n, at in ((1, 0), (2, 2), (3, 4), (4, 6), (5, 8), (6, 11))]
    rows += [(0, n, "y", at, 2) for n, at in ((1, 3), (2, 5), (3, 7), (5, 9), (4, 20), (6, 30))]
    rows += [(1, n, "x", at, 1) for n, at in ((1, 0), (2, 1), (4, 2))] + [(1, n, "z", at, 1) for n, at in ((1, 7), (2, 8))]
    rows += [(0, 7, "d", 0, 3)] * 2 + [(0, 8, "d", 3, 3)] * 2
    nodes = spark.createDataFrame(rows, "kind int, node long, key string, at int, n int")
    got = sorted(map(tuple, substring.compacted(nodes).collect()))
    want = [("x", 0, 6), ("x", 6, 2), ("x", 8, 2), ("x", 11, 2), ("y", 3, 6), ("y", 9, 2), ("y", 20, 2), ("y", 30, 2)]
    want += [("x", 0, 2), ("x", 2, 1), ("z", 7, 2)] + [("d", 0, 3)] * 2 + [("d", 3, 3)] * 2
    assert got == sorted(want)
    assert substring.compacted(nodes.limit(0)).count() == 0
