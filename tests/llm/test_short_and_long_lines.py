"""Exact copies of short lines, and edits that grow with the length, against every pair of lines."""

import random

import corpus_pipeline as cp
from tidemark.llm import linededup


def allowed(n):
    if n < linededup.LEAST:
        return 0
    edits, at = linededup.EDITS, linededup.GROWS
    while n >= at:
        edits, at = edits + 1, at * 2
    return edits


def brute(docs):
    lines = [(d, i, x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n")) if len(x) >= linededup.LEAST or x.strip()]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, _, x) in enumerate(lines):
        for j in range(i):
            y = lines[j][2]
            if find(i) != find(j) and (x == y or linededup.within(x, y, allowed(min(len(x), len(y))))):
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(lines):
        first[find(i)] = min(first.get(find(i), r[:2]), r[:2])
    gone = {r[:2] for i, r in enumerate(lines) if r[:2] != first[find(i)]}
    return {(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in docs}


def corpus():
    r = random.Random(5)
    base = ["".join(r.choices("abcdé ", k=k)) for k in (3, 8, 31, 32, 60, 127, 128, 254, 255, 256, 257, 300, 510, 511, 512, 514, 700, 1023, 1025)]

    def vary(x):
        x = list(x)
        for _ in range(r.choice([0, 0, 1, 2, 3, 4, 5, 6])):
            at, act = r.randrange(len(x) + 1), r.randrange(3)
            x[at : at + (act > 0)] = r.choice("xyzé") if act < 2 else ""
        return "".join(x)

    docs = [(i, "\n".join(r.choice([vary, str])(r.choice(base)) for _ in range(r.randint(0, 5)))) for i in range(70)]
    return [*docs, (100, None), (101, ""), (102, "\n\n"), (103, "All rights reserved.\n \n\t\nAll rights reserved."), (104, "All rights reserved.\n \nAnd."), (105, "And,")]


def test_every_line_takes_part(spark):
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(docs)
    assert {(x.doc_id, x.text) for x in linededup.dedup(d, gate_bits=1 << 14).collect()} == want
    assert (104, " \nAnd.") in want and (103, "All rights reserved.\n \n\t") in want


def test_pipeline_stage(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    docs = [(r.doc_id, r.text) for r in table.collect()]
    got = {(r.doc_id, r.text) for r in cp.drop_repeated_lines(spark, table, "").collect()}
    # documents that lose all they had leave
    assert got == {(d, t) for d, t in brute(docs) if (d, t) in docs or t.strip()}
