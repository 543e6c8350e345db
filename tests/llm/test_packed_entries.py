"""Entries and probes of the line join go many to a row; what is made of them is what rows of their own would give."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import linededup
from tidemark.llm.shared import PackedGate, parity_sketch, parity_sketches


def test_segments_are_not_rows_of_their_own(spark):
    r = random.Random(3)
    lines = ["".join(r.choices("abcdé ", k=r.randrange(40, 400))) for _ in range(400)]
    d = spark.createDataFrame([(i, "\n".join(lines[i * 40 : i * 40 + 40])) for i in range(10)], "id long, text string")
    d = d.withColumn("key", F.col("id")).repartition(2)
    found = linededup._entries(d, linededup.Budget(None, linededup.LEAST)).collect()
    packed = [x for x in found if x["count"] is not None]
    assert len(found) - len(packed) == len(lines) and len(packed) <= 2
    # a segment more than edits for every line
    want = sum(3 if len(x) < linededup.GROWS else 4 for x in lines)
    assert sum(x["count"] for x in packed) == want and all(len(x["keys"]) == len(x["nodes"]) == 2 * len(x["sizes"]) == 8 * x["count"] for x in packed)


def some_keys(spark):
    r = np.random.default_rng(4)
    pool = np.append(r.integers(0, 1 << 64, 300, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64))
    rows = []
    for size in (500, 0, 1, 700, 3):
        keys = pool[r.integers(0, len(pool), size)]
        # half of the keys have one node each
        nodes = np.where(keys % 2 == 0, keys + np.uint64(7), r.integers(0, 1 << 64, size, dtype=np.uint64))
        rows.append((keys, nodes))
    packed = spark.createDataFrame([(bytearray(k.tobytes()), bytearray(n.tobytes())) for k, n in rows], "keys binary, nodes binary").repartition(3)
    return packed, np.concatenate([k for k, _ in rows]), np.concatenate([n for _, n in rows])


def test_keys_of_several_nodes(spark):
    packed, keys, nodes = some_keys(spark)
    of = {}
    for k, n in zip(keys.tolist(), nodes.tolist(), strict=True):
        of.setdefault(k, set()).add(n)
    got = [x.key % (1 << 64) for x in linededup._met(spark, packed).collect()]
    want = {k for k, n in of.items() if len(n) > 1}
    assert len(got) == len(set(got)) and set(got) == want and 100 < len(want) < len(of)


def test_gate_holds_the_packed_keys(spark):
    packed, keys, _ = some_keys(spark)
    for bits in (1 << 8, 1 << 14):
        want = np.zeros(bits, np.uint8)
        want[(keys & np.uint64(bits - 1)).astype(np.int64)] = 1
        got = PackedGate(spark, packed.select("keys"), bits).table.value
        assert (np.unpackbits(got.view(np.uint8), bitorder="little") == want).all()


def test_sketches_of_many_sets():
    r = np.random.default_rng(5)
    counts = r.integers(0, 40, 9000)
    tokens = r.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    each = np.split(tokens, np.cumsum(counts)[:-1])
    assert parity_sketches(tokens, counts, 4) == [parity_sketch(x, 4) for x in each]
