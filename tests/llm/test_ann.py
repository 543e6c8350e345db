import numpy as np

from tidemark.llm import ann


def brute(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x * q).sum(1)
            rows = sorted((-v, j) for v, j in zip(s.tolist(), ids, strict=True) if j != i)
            out[i] = [(j, -v) for v, j in rows[:k]]
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    p = df.toPandas()
    want = brute(p["vec_id"].tolist(), np.stack(p["embedding"]).astype(float), 20, 20)
    got = ann.neighbours(df, block=150, queries=10).toPandas()
    hit = total = 0
    for q, rows in want.items():
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (mine["score"].diff().dropna() <= 0).all()
        hit += len({j for j, _ in rows} & set(mine["vec_id"]))
        total += len(rows)
    assert set(got["query_id"]) == set(want) and hit / total >= 0.9


def test_norms_copies_and_ties(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 8)) * r.random((400, 1)) * 9
    x[100:250] = x[7]
    ids = list(range(400))
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>, label int")
    got = ann.neighbours(df, k=20, every=50, block=90, queries=3).toPandas()
    want = brute(ids, x, 20, 50)
    hit = sum(len({j for j, _ in v} & set(got[got["query_id"] == q]["vec_id"])) for q, v in want.items())
    assert hit >= 0.9 * 20 * len(want)
    mine = got[got["query_id"] == 100].sort_values("rank")
    assert mine["score"].is_monotonic_decreasing


def test_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [None, 1.0], 1), (7, [], 1), (None, [1.0, 1.0], 1), (20, [1.0, 0.0], 2), (40, [1.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    got = sorted(map(tuple, ann.neighbours(df).collect()))
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert ann.neighbours(df.limit(0)).count() == 0


def test_production_parameters_recall():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    index = ann.Index(ids, x, float(np.linalg.norm(x, axis=1).max()))
    want = brute(ids.tolist(), x, 20, 20)
    hit = verified = 0
    for i, q in zip(ids.tolist(), x, strict=True):
        if i % 20 == 0:
            found, scores = index.search(q, i, 20)
            assert (np.diff(scores) <= 0).all() and i not in found
            hit += len({j for j, _ in want[i]} & set(found.tolist()))
            verified += index.verified
    assert hit >= 0.9 * 20 * len(want) and 0 < verified <= 0.9 * len(want) * len(x)


def test_more_lines_and_small_steps_verify_a_part(monkeypatch):
    for name, value in (("PROJECTIONS", 120), ("THRESHOLD", 0.79), ("STEP", 1.12)):
        monkeypatch.setattr(ann, name, value)
    x = np.random.default_rng(2).standard_normal((ann.BLOCK, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.Index(np.arange(len(x)), x, 1.0)
    hit = verified = 0
    for i in range(40):
        found, _ = index.search(x[i], i, 20)
        near = np.argsort(-(x @ x[i]), kind="stable")
        hit += len(set(near[near != i][:20].tolist()) & set(found.tolist()))
        verified += index.verified
    assert hit >= 0.9 * 20 * 40 and verified < 0.3 * 40 * len(x)


def test_repeated_ids_and_tie_order(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [0.5, -9.0]), (4, [0.5, 3.0])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=9).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 3, 0.5), (0, 2, 4, 0.5), (0, 3, 4, 0.5), (0, 4, 5, 0.5)]


def test_blocks_and_parts_stream_past_one_index_each(spark, monkeypatch):
    """Whatever the cut into tasks, batches and lengths, small blocks find what one search of all finds with all verified."""
    monkeypatch.setattr(ann, "MOST_TASKS", 3)
    r = np.random.default_rng(8)
    rows = [(i, r.standard_normal(5 + i % 2).tolist(), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, ann.neighbours(df, k=200, every=20, block=40, queries=4).select("query_id", "vec_id").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # k exceeds the candidates of a length, so every one of them is found
    assert got == sorted((q, i) for q in range(0, 300, 20) for i in range(q % 2, 300, 2) if i != q)
