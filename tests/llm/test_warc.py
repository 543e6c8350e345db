import hashlib

import numpy as np
import pytest

from tidemark.llm import warc

MAGIC = "WARC/1.0\r\n"


def brute(pages):
    full = [(i, (h or "").encode()) for i, _, h in pages]
    out = []
    for i, b in full:
        same = [j for j, c in full if c == b and j is not None]
        origin = max(same) if len(b) >= 1000 and len([1 for _, c in full if c == b]) > 1 and same else None
        again = origin is not None and origin != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", origin if again else None))
    return sorted(out, key=str)


def nasty():
    inner = f"{MAGIC}WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "é" * 700
    return [
        (1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "u", MAGIC), (5, "u", inner), (6, "u", inner * 3 + "tail"), (7, "u", "\r\n\r\n" + inner),
        (8, "u", big), (9, "u", big), (12, "u", big), (10, "u", "x" * 999), (11, "u", "x" * 999), (13, "u", "Content-Length: 9\r\n\r\n"), (14, "u", inner[:-4]), (15, "u", "w" * 300_000), (None, "u", "no id"),
    ]


@pytest.mark.parametrize("rows", [nasty(), nasty()[:1], nasty()[3:7] * 2])
def test_round_trip(spark, rows):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == brute(rows)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0


def test_splits_and_plain_files(spark, tmp_path):
    rows = nasty() + [(100 + i, "u", f"page {i} " + MAGIC * (i % 3)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = warc.read(spark, str(tmp_path / "w"))
        got = sorted((r.record_id, r.block_bytes, r.block_digest) for r in found.collect() if r.record_type == "response")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted((f"<urn:x-page:{'null' if i is None else i}>", n, d) for i, n, d, kind, _ in brute(rows) if kind == "response")
    assert got == want


def test_chain_rejects_what_is_not_reached():
    m = len(MAGIC)
    # the first record claims 40 bytes after its magic and holds a magic 12 bytes in; the second claims 20
    sizes, lengths = np.array([0, 12, 40 - 12 - m, 20]), np.array([-1, 40, 3, 20])
    reached, pieces, whole = warc.chain(sizes, lengths)
    assert reached.tolist() == [False, True, False, True] and pieces[1] == 2 and pieces[3] == 1 and whole[[1, 3]].all()
    assert not warc.chain(np.array([3, 20]), np.array([-1, 20]))[0].any()


def test_scans_with_other_splits_agree(spark, tmp_path):
    rows = nasty() + [(100 + i, "u", f"page {i} " + MAGIC * (i % 3)) for i in range(300)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"), compression="none")
    found = warc.read(spark, str(tmp_path / "w"))  # its candidates are read; the parts of long records aren't yet
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((r.record_id, r.block_bytes, r.block_digest) for r in found.collect() if r.record_type == "response")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((f"<urn:x-page:{'null' if i is None else i}>", n, d) for i, n, d, kind, _ in brute(rows) if kind == "response")
