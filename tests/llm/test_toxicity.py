import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def texts(rows):
    rows = [np.array(r, np.int64) for r in rows]
    return t.Texts(rows, np.arange(len(rows)) % t.CLASSIFIERS)


def test_risk_may_be_negative_and_its_estimate_is_unbiased():
    r = np.random.default_rng(1)
    toxic, clean, prior = r.normal(1, 1, 200_000), r.normal(-1, 1, 200_000), 0.3
    mixed = np.where(r.random(200_000) < prior, r.permutation(toxic), clean)
    up, down = t.risk(toxic, mixed, prior)
    assert up == pytest.approx(prior * np.log1p(np.exp(-toxic)).mean(), rel=1e-9)
    assert down == pytest.approx((1 - prior) * np.log1p(np.exp(clean)).mean(), abs=4e-3)
    assert t.risk(np.full(3, 9.0), np.full(9, -9.0), prior)[1] < 0


def test_steps_are_slopes_of_the_risk(monkeypatch):
    """One step from one batch moves every weight against the numerical slope; beyond zero it goes back up the difference."""
    toxic, unlabelled, prior = texts([[0], [0, 1], [2]]), texts([[1], [2], [0], [], [3], [3, 1]]), 0.4
    monkeypatch.setattr(t, "EPOCHS", 1)
    monkeypatch.setattr(t, "BATCHES", 1)
    monkeypatch.setattr(t, "DECAY", 0.0)
    x0 = np.append(np.zeros(4), np.log(prior / (1 - prior)))

    def value(x, back):
        p, u = (s.scored(np.arange(len(s)), x[:-1], x[-1]) for s in (toxic, unlabelled))
        up, down = t.risk(p, u, prior)
        return -down if back else up + down

    for back in (False, True):
        if back:
            monkeypatch.setattr(t, "risk", lambda *a: (0.0, -1.0))
        real = t.risk
        w, b = t.fit_one(toxic, unlabelled, np.arange(3), np.arange(6), 4, prior, 0)
        monkeypatch.undo() if back else None
        slope = np.array([(value(x0 + e, back) - value(x0 - e, back)) / 2e-6 for e in np.eye(5) * 1e-6])
        assert (np.sign(np.round(x0 - np.append(w, b), 6)) == np.sign(np.round(slope, 6))).all()
        assert real is not None


def test_chances_ascend_and_hold_the_prior():
    r = np.random.default_rng(2)
    n, prior = 20_000, 0.2
    toxic = r.normal(2, 1, n)
    mixed = np.where(r.random(n) < prior, r.normal(2, 1, n), r.normal(-1, 1, n))
    at, chance = t.chances(toxic, mixed, prior)
    assert (np.diff(at) >= 0).all() and (np.diff(chance) >= 0).all() and chance.min() >= 0 and chance.max() <= 1
    density = lambda g, m: np.exp(-((g - m) ** 2) / 2)
    for g in (-1.0, 0.0, 0.5, 1.0, 2.0):
        real = prior * density(g, 2) / (prior * density(g, 2) + (1 - prior) * density(g, -1))
        assert np.interp(g, at, chance) == pytest.approx(real, abs=0.06)


def test_chances_of_plain_cases():
    at, chance = t.chances(np.array([3.0, 3.0]), np.array([0.0, 0.0, 3.0, 0.0]), 0.25)
    assert at.tolist() == [0, 0, 3, 3] and chance.tolist() == [0, 0, 1, 1]
    at, chance = t.chances(np.array([0.0]), np.array([1.0]), 0.25)
    assert chance.tolist() == [0.25, 0.25] and at.tolist() == [0, 1]


def test_scores_like_plain_python():
    r = np.random.default_rng(3)
    vocabulary = ["idiot", "réêou", "x9", "trash"]
    hashes = t.wh.word_hashes(*(lambda b: (np.frombuffer(b, np.uint8), *map(np.array, zip(*[(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", b)], strict=True))))(" ".join(vocabulary).encode()), fold=True)
    order = np.argsort(hashes)
    weights = r.normal(size=(3, 4))
    model = t.Model(hashes[order], weights[:, order], np.array([-1.0, -2.0, -0.5]), np.array([-4.0, 4.0]), np.array([0.1, 0.9]))
    given = ["An IDIOT, idiot; Trash", "réêou-x9", None, "", "trash" * 2, "x9 " * 300_000 + "idiot"]
    got = model.scores(pa.array(given, pa.string()))
    for text, score in zip(given, got.tolist(), strict=True):
        words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        g = -3.5 / 3 + sum(weights[:, vocabulary.index(w)].mean() for w in words if w in vocabulary)
        assert score == pytest.approx(0.999 * np.interp(g, [-4, 4], [0.1, 0.9]) + 0.001 / (1 + np.exp(-g)), abs=1e-12)


@pytest.fixture(scope="module")
def found(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels, t.report(docs, labels).toPandas().sort_values("doc_id").reset_index(drop=True)


def test_held_out(found):
    docs, labels, out = found
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]).all()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.7)).all() and len(out) == docs.count()
    rest = out.merge(labels.toPandas(), on="doc_id").query("held_out")
    toxic, rank = rest["toxic"] == 1, rest["score"].rank()
    n1 = toxic.sum()
    assert (rank[toxic].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(rest) - n1)) > 0.85
    assert rest.loc[~toxic, "predicted"].sum() == 0 and rest.loc[toxic, "predicted"].mean() > 0.4


def test_held_out_labels_and_other_columns_are_never_read(spark, found):
    docs, labels, out = found
    flipped = labels.toPandas()
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in flipped["doc_id"]]
    flipped.loc[held, "toxic"] = 1 - flipped.loc[held, "toxic"]
    other = docs.selectExpr("doc_id", "text", "'en' as lang", "doc_id as score", "1 as predicted")
    again = t.report(other, spark.createDataFrame(flipped)).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(out, again)


def test_edges(spark):
    rows = [(i, f"the cat {'foul' if i % 2 else 'fair'} number {i}", "x") for i in range(300)] + [(1000, None, "x"), (1000, "", "x"), (None, "foul foul", "x"), (1001, "a b c\n" * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (4, None, 0), (1000, 0, 0), (6, 0, 1), (6, 1, 1)], "doc_id long, toxic int, quality int")
    out = {(r.doc_id, r.held_out): r for r in t.report(docs, labels).collect()}
    assert out[None, False].predicted == 1 and t.report(docs, labels).count() == len(rows)
    assert all(r.predicted == (r.doc_id % 2) for r in out.values() if r.doc_id is not None and r.doc_id < 300)
    assert out[1000, zlib.crc32(b"1000") % 3 == 1].predicted == 0
    assert {r.score for r in t.report(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in t.report(docs, labels.where("toxic = 0")).collect()} == {0.5}
    only = {r.doc_id: r.score for r in t.report(docs, labels.where("toxic = 1")).collect()}
    assert only[1] > only[2] and t.report(docs.limit(0), labels).count() == 0
    t.report(docs.where("doc_id = 1"), labels).collect()
