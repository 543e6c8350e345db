import zlib

import numpy as np
import pandas as pd

from tidemark.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_presence_is_a_set_of_ngrams():
    bits, known = langid.presence(["abc abc", "ABC,  abc!", "", "12 !", "é"])
    assert (bits[0] == bits[1]).sum() >= langid.WIDTH - 3 and known.tolist() == [True, True, False, False, True]
    assert not bits[2].any() and not bits[3].any()


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.report(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(out) == docs.count()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    rest = out[out["held_out"] & out["lang"].notna()]
    assert (rest["lang"] == rest["lang_pred"]).mean() > 0.95
    assert out["score"].between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en", "x"), (3, "der hund und die katze sind nicht da", "de", "x"), (4, None, "en", "x"), (5, "  12 ", None, "x"), (None, "the dog", None, "x"), (6, "", "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in langid.report(docs).collect()}
    assert out[4].lang_pred == out[5].lang_pred == out[6].lang_pred == "und" and out[4].score == 0
    assert out[None].lang_pred in ("en", "de") and out[None].held_out is False
    assert {r.lang_pred for r in langid.report(docs.where("lang is null")).collect()} == {"und"}
    assert langid.report(docs.limit(0)).count() == 0


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    n1 = label.sum()
    return (rank[label].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    rest = out[out["held_out"]]
    assert auc(rest["score"].to_numpy(), rest["quality"].to_numpy() == 1) > 0.9
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()


def test_rules_compile_to_the_same_scores(spark):
    r = np.random.default_rng(1)
    x = r.random((400, len(quality.STATISTICS)))
    y = (x[:, 2] > 0.5) ^ (x[:, 4] > 0.7)
    model = quality.fit(x, y)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list(quality.STATISTICS)))
    got = np.array([v[0] for v in df.select(model.column()).collect()])
    assert np.allclose(np.sort(got), np.sort(model.score(x)), atol=1e-12)
    assert auc(model.score(x), y) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "a b c\n" * 30000, "z"), (None, "q", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.report(docs, labels).collect()) == 4
    assert {r.score for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.report(docs.limit(0), labels).count() == 0


def test_thousands_of_languages(spark):
    """Dirty labels: the frequent languages are learned, whatever else stands in the column."""
    rows = [(i, "the cat sat on the mat and the dog ran to them" if i % 2 else "der hund und die katze sind nicht da gewesen", "en" if i % 2 else "de") for i in range(400)]
    rows += [(1000 + i, f"word{i} qx{i} the", f"label {i}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.held_out())
    assert len(model.languages) == langid.MOST_LANGUAGES and {"en", "de"} <= set(model.languages)
    out = {r.doc_id: r.lang_pred for r in langid.classify(docs.where("doc_id < 400").select("doc_id", "text"), model).collect()}
    assert all(out[i] == ("en" if i % 2 else "de") for i in range(400))
