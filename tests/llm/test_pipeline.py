"""The pipeline stage by stage against plain Python over a small corpus with planted cases."""

import re

import pytest

import corpus_pipeline as cp
from test_short_and_long_lines import brute as brute_lines


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    rows = [tuple(r) for r in table.collect()]
    top = max(r[0] for r in rows) + 1
    long = max(rows, key=lambda r: len(r[1] or ""))
    words = long[1].split()
    rows += [(top, None, None, "s", 0), (top + 1, "1234 !!", None, "s", 7), (top + 2, "", "en", "s", 0)]
    rows += [(top + 3, " ".join(["fresh", *words]), long[2], "s", 1), (top + 4, " ".join([*words, "late"]), long[2], None, 1)]
    spark.createDataFrame(rows, table.schema).write.parquet(str(root / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(cp.STAGES)
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)

    first = keep(stages["language_id"](spark, docs, sf))
    assert first.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()}
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert gone.isdisjoint(letters) and {r.doc_id for r in docs.collect()} - letters <= gone

    second = keep(stages["line_dedup"](spark, first, sf))
    want = brute_lines([(r.doc_id, r.text) for r in first.collect()])
    before = {r.doc_id: r.text for r in first.collect()}
    # documents that lose all they had leave
    assert {(r.doc_id, r.text) for r in second.collect()} == {(d, t) for d, t in want if t == before[d] or re.search(r"\S", t)}

    third = keep(stages["ngram_jaccard"](spark, second, sf))
    sets = {}
    for r in second.collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in third.collect()} == {d for d in ids if find(d) == d}

    fourth = keep(stages["decontamination"](spark, third, sf))
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {" ".join(w[i : i + 10]) for w in (cut(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if w for i in range(max(1, len(w) - 9))}
    hit = {r.doc_id for r in third.collect() if any(f" {w} " in f" {' '.join(cut(r.text))} " for w in windows)}
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect()} - hit

    last = stages["byte_bpe"](spark, fourth, sf).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth.collect()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_near_copies_without_ids(spark, sf):
    text = " ".join(f"w{i}" for i in range(80))
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(None, text, "en", "s", 1), (None, text + " x", "en", "s", 1), (5, "y " + text, "en", "s", 1), (None, "a text of its own, with no copy", "en", "s", 1), (6, "one two three four five six", "en", "s", 1), (6, "quite another text under this id", "en", "s", 1)]
    got = [(r.doc_id, r.text) for r in cp.keep_one_near_copy(spark, spark.createDataFrame(rows, schema), sf).collect()]
    assert sorted(got, key=str) == sorted([(r[0], r[1]) for r in rows[2:]], key=str)


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 0 and out.where("not round_trip").count() == 0


def test_empty(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_clean_documents_that_share_an_id_with_a_hit_stay(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first()["text"]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(None, f"lead {item}", "en", "s", 1), (None, "zq zq zq", "en", "s", 2), (7, item, "en", "s", 3), (7, "zq zz", "en", None, 4), (8, "zz zq", "en", "s", 5), (8, "zz zq", "en", "s", 5), (9, None, None, None, None)]
    out = cp.drop_contaminated(spark, spark.createDataFrame(rows, schema), sf)
    assert out.columns == cp.COLUMNS and sorted(map(tuple, out.collect()), key=str) == sorted([rows[k] for k in (1, 3, 4, 5, 6)], key=str)


def test_very_long_documents(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    base = next(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and length(text) > 500").collect())
    long = "\n".join(f"{base} {i}" for i in range(300))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").unionByName(spark.createDataFrame([(10**6, long, "en", "s", len(long))], schema))
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), schema)
    assert docs.where(f"doc_id = {10**6}").count() <= 1
    assert all(r.round_trip for r in cp.encode(spark, docs, sf).collect())
