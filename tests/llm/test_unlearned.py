"""Texts in a language that was not learned leave the pipeline's language stage; nearly all of learned ones stay."""

import random

import pytest

import corpus_pipeline as cp
from tidemark.llm import langid

POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
RUSSIAN = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."


def gibberish(words):
    r = random.Random(words)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(words))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_unlearned_languages_leave(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    top = table.agg({"doc_id": "max"}).first()[0]
    texts = [POLISH, FINNISH, RUSSIAN, gibberish(40), gibberish(400)]
    planted = spark.createDataFrame([(top + 1 + i, t, None, "s", len(t)) for i, t in enumerate(texts)], table.schema)
    got = {r.doc_id for r in cp.identify_language(spark, table.unionByName(planted), "").select("doc_id").collect()}
    assert not got & set(range(top + 1, top + 1 + len(texts)))
    letters = {r.doc_id for r in table.collect() if any(c.isalpha() for c in r.text or "")}
    # the limits are estimates: a learned text in a thousand may pass them
    assert got <= letters and 1000 * len(letters - got) <= len(letters) + 999


def test_answers_without_strict_are_unchanged(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(table, ~langid.held_out())
    names, scores = model.predict([POLISH, RUSSIAN, ""])
    assert names[0] in model.languages and names[1] in model.languages and names[2] == langid.UNKNOWN
    assert min(scores[:2]) >= 1 / len(model.languages)
    assert model.predict([POLISH, RUSSIAN, ""], strict=True)[0] == [langid.UNKNOWN] * 3
