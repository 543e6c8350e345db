import random
import re

import pytest

from tidemark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        windows += [(str(i), tuple(w[k : k + 10])) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    who.add(i)
        out.append((d, len(w), len(hit), sorted(who)))
    return out


def case():
    r = random.Random(3)
    vocab = ["the", "Of", "à", "ß1", "x"] + [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(vocab, k=n))) for i, n in enumerate([1, 2, 4, 9, 10, 11, 14, 14, 0, 30])] + [(77, None), (4, "The of"), (10, "!!")]
    docs = [(i, ". ".join(r.choices(vocab, k=r.randint(0, 60)))) for i in range(40)] + [(100, None), (100, ""), (101, "z " * 3000)]
    docs += [(200 + i, f"lead {items[i % 10][1]} MID {(items[(i + 3) % 10][1]).upper()}") for i in range(20)] + [(200, docs[3][1])] * 2
    return docs, items


@pytest.mark.parametrize("block", [100_000, 7])
def test_against_brute_force(spark, block):
    docs, items = case()
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id long, text string, items string")
    i = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, spans int")
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(d, i, block=block).collect())
    assert got == sorted(brute(docs, items))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [(r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(d, i.limit(0)).collect()] == [(0, 0, False)]
    assert decontaminate.report(d.limit(0), i).count() == 0


@pytest.mark.parametrize("block", [100_000, 7])
def test_clean_rows_stay_whatever_their_ids(spark, block):
    docs, items = case()
    docs = [(None if k % 3 == 0 else k % 4, t) for k, (_, t) in enumerate(docs)] + [(None, None), (1, "")]
    d = spark.createDataFrame([(a, k, b, "clash") for k, (a, b) in enumerate(docs)], "doc_id long, n_hit long, text string, items string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.clean(d, i, block=block)
    hit = {k for k, (_, _, n, _) in enumerate(brute(docs, items)) if n}
    assert got.columns == d.columns and 0 < len(hit) < len(docs)
    assert sorted(got.collect(), key=lambda r: r.n_hit) == [r for r in d.collect() if r.n_hit not in hit]


def test_very_long_text(spark):
    d = spark.createDataFrame([(1, "z " * 2_000_000 + "a b c"), (2, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [(r.doc_id, r.n_hit) for r in decontaminate.report(d, i).orderBy("doc_id").collect()] == [(1, 3), (2, 0)]
    assert [r.doc_id for r in decontaminate.clean(d, i).collect()] == [2]
