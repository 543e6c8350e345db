import zlib
from collections import Counter

from tidemark.llm import sharding

SCHEMA = "doc_id long, text string, source string, shard int"


def test_mixture_and_law(spark):
    rows = [(i, f"text {i}" * (i % 7), "hot" if i % 3 else f"s{i % 5}", -1) for i in range(3000)]
    out = sharding.interleave(spark.createDataFrame(rows, SCHEMA), slice_rows=50).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(v) for v in by.values()]
    assert sorted(by) == list(range(24)) and max(sizes) - min(sizes) <= 1
    share = Counter(x[2] for x in rows)
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
        for source, n in Counter(rows[r.doc_id][2] for r in v).items():
            assert abs(n - share[source] / 24) <= len(share)
    text = {x[0]: (x[1] or "").encode() for x in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.grown_shard is None for r in out)


def test_slices_do_not_change_the_result(spark):
    docs = spark.createDataFrame([(i, "x", "a" if i % 2 else None, 0) for i in range(500)], SCHEMA)
    a, b = (sorted(map(tuple, sharding.interleave(docs, slice_rows=n).collect())) for n in (7, 10_000))
    assert a == b


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None, 0), (1, None, None, 0), (None, "é", "", 0), (2, "", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sharding.interleave(docs, shards=2).collect()
    assert len(out) == 4 and Counter(r.shard for r in out) == {0: 2, 1: 2}
    assert {(r.doc_id, r.size) for r in out} == {(1, 8), (None, 10), (2, 8)}
    assert sharding.interleave(docs.limit(0)).count() == 0


def test_very_long_texts_and_ties(spark):
    long = "é" * 3_000_000
    rows = [(1, long, "a", 0), (2, long, "a", 0), (3, "x", "a", 0), (3, "x", "a", 0)]
    out = sharding.interleave(spark.createDataFrame(rows, SCHEMA), shards=4).collect()
    assert sorted((r.doc_id, r.size) for r in out) == [(1, 6_000_008), (2, 6_000_008), (3, 9), (3, 9)]
    assert sorted((r.shard, r.slot) for r in out) == [(s, 0) for s in range(4)]
    assert {r.text_crc32 for r in out if r.doc_id < 3} == {zlib.crc32(long.encode())}
