"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled ones train linear classifiers over the presence of words. With the share of toxic
texts (the class prior) known, the risk on clean texts is that on unlabelled ones less the prior times that on toxic
ones scored as clean. On a finite sample that difference may fall below zero, which is the sign of overfitting; such a
step then goes back up the difference instead (Kiryo et al., 2017). Nothing is learned from labels that say clean, but
for the prior. Each classifier leaves out a part of the sample. The parts left out tell the chance that a score stands
for: the prior times the share of toxic texts at that score over the share of unlabelled ones, made ascending.

Only words that confirmed texts hold clearly more often than unlabelled ones are features; they are counted by Spark
over the sample. Every text is then scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import Scratch, trimmed

#: The bounds of the training sample: confirmed toxic texts, and unlabelled ones.
MOST_TOXIC, MOST_UNLABELLED = 8_000, 24_000
#: Features: words of at least LEAST_TEXTS confirmed texts whose share there is over LEAST_SIGMAS deviations above that in unlabelled ones.
LEAST_TEXTS, LEAST_SIGMAS, MOST_WORDS = 3, 6.0, 4_096
CLASSIFIERS, EPOCHS, BATCHES, RATE, DECAY = 5, 60, 8, 0.05, 2e-4
#: The part of a score that keeps texts of the same chance apart.
RANKED = 1e-3
#: The prior where no label says clean, and the bounds of any.
PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.1, 1e-3, 0.9
PREDICT_FROM = 0.7


def held_out() -> Column:
    """Rows whose labels are never read: crc32 of the id as text leaves 1 by 3. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, text of each word, hash) of runs of texts, a word once for each text."""
    for i, j, part, offs in wh.pieces(*wh.strings(column)):
        starts, ends, first = wh.words(part, offs, wh.ALNUM_WORDS)
        h, owner = wh.word_hashes(part, starts, ends, fold=True), np.repeat(np.arange(j - i), np.diff(first))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield i, j, owner[new], h[new]


def _features(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of h are features, their numbers); words are the features' hashes, ascending."""
    at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
    some = words[at] == h if len(words) else np.zeros(len(h), bool)
    return some, at[some]


def _clip(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Features as ascending word hashes; a row of weights and an offset for each classifier; the chances at some of their mean scores."""

    words: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    at: np.ndarray
    chance: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """The texts' chances to be toxic, from the mean of the classifiers."""
        w, total = self.weights.mean(0), np.full(len(column), self.offsets.mean())
        for i, j, owner, h in _words(column):
            some, at = _features(self.words, h)
            total[i:j] += np.bincount(owner[some], w[at], j - i)
        return (1 - RANKED) * np.interp(total, self.at, self.chance) + RANKED * _clip(total)


class Texts:
    """Texts as sorted pairs (text, feature), and their folds."""

    def __init__(self, rows: list[np.ndarray], fold: np.ndarray):
        self.fold = fold
        self.first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.first) - 1

    def once(self) -> np.ndarray:
        """Whether a text counts for the chances: the first with its features, and all without any, so that copies of one text weigh as one."""
        seen: set[bytes] = set()
        keep = np.ones(len(self), bool)
        for i, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            key = self.at[a:b].tobytes()
            keep[i] = not key or key not in seen
            seen.add(key)
        return keep

    def take(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in texts, feature) of the pairs of some texts."""
        size = np.diff(self.first)[texts]
        return np.repeat(np.arange(len(texts)), size), self.at[wh.ranges(self.first[:-1][texts], size)]

    def scored(self, texts: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
        place, at = self.take(texts)
        return b + np.bincount(place, w[at], len(texts))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of toxic texts, estimated risk of clean ones) of the logistic loss, from scores before the logistic function; the second may be negative."""
    loss = lambda g: np.logaddexp(0, -g).mean()
    return prior * loss(positive), loss(-unlabelled) - prior * loss(-positive)


def fit_one(toxic: Texts, unlabelled: Texts, p_rows: np.ndarray, u_rows: np.ndarray, features: int, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """(weights, offset) of one classifier from some rows, by Adam over shuffled batches that have their share of both kinds."""
    r = np.random.default_rng(seed)
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, min(BATCHES, len(p_rows), len(u_rows)))
    for _ in range(EPOCHS):
        for p, u in zip(np.array_split(r.permutation(p_rows), batches), np.array_split(r.permutation(u_rows), batches), strict=True):
            (po, pf), (uo, uf) = toxic.take(p), unlabelled.take(u)
            gp, gu = w[-1] + np.bincount(po, w[pf], len(p)), w[-1] + np.bincount(uo, w[uf], len(u))
            # slopes by the scores: of toxic texts as toxic, and of the estimated risk of clean ones
            up, clean_p, clean_u = prior * (_clip(gp) - 1) / len(p), -prior * _clip(gp) / len(p), _clip(gu) / len(u)
            if risk(gp, gu, prior)[1] >= 0:
                dp, du = up + clean_p, clean_u
            else:
                dp, du = -clean_p, -clean_u
            slope = np.append(np.bincount(pf, dp[po], features) + np.bincount(uf, du[uo], features), dp.sum() + du.sum())
            slope[:-1] += DECAY * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def chances(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(scores, chances there): runs of equal chance by pooling neighbours that don't ascend, straight lines between runs."""
    score = np.concatenate([positive, unlabelled])
    toxic, every = np.repeat([prior / len(positive), 0.0], [len(positive), len(unlabelled)]), np.repeat([0.0, 1 / len(unlabelled)], [len(positive), len(unlabelled)])
    value, which = np.unique(score, return_inverse=True)
    runs: list[tuple[float, float, float, float]] = []  # first and last score, toxic and all mass
    for v, t, e in zip(value.tolist(), np.bincount(which, toxic).tolist(), np.bincount(which, every).tolist(), strict=True):
        first = v
        while runs and runs[-1][2] * e >= t * runs[-1][3]:
            first, _, t0, e0 = runs.pop()
            t, e = t + t0, e + e0
        runs.append((first, v, t, e))
    chance = [1.0 if e <= t else t / e for _, _, t, e in runs]
    return np.array([x for first, last, _, _ in runs for x in (first, last)]), np.repeat(chance, 2)


def fit(words: np.ndarray, toxic: Texts, unlabelled: Texts, prior: float) -> Model:
    """CLASSIFIERS classifiers, each without the texts of its fold, and the chances that the texts left out tell."""
    if not len(toxic) or not len(unlabelled):
        return Model(words[:0], np.zeros((1, 0)), np.zeros(1), np.zeros(1), np.full(1, 0.5))
    found, left, once = [], ([], []), (toxic.once(), unlabelled.once())
    for k in range(CLASSIFIERS):
        rows = [np.flatnonzero(t.fold != k) for t in (toxic, unlabelled)]
        rows = [r if len(r) else np.arange(len(t)) for r, t in zip(rows, (toxic, unlabelled), strict=True)]
        w, b = fit_one(toxic, unlabelled, *rows, len(words), prior, k)
        found.append((w, b))
        for texts, scores, keep in zip((toxic, unlabelled), left, once, strict=True):
            scores.append(texts.scored(np.flatnonzero((texts.fold == k) & keep), w, b))
    return Model(words, np.stack([w for w, _ in found]), np.array([b for _, b in found]), *chances(*map(np.concatenate, left), prior))


def _counted(sample: DataFrame) -> DataFrame:
    """(word, p, u): texts of sample(y, text) with the word, confirmed and unlabelled."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, owner, h in _words(b.column(1)):
                word, which = np.unique(h, return_inverse=True)
                p = np.bincount(which, y[i:j][owner], len(word)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(wh.signed(word)), pa.array(p), pa.array(np.bincount(which, minlength=len(word)) - p)], names=["word", "p", "u"])

    return sample.select("y", "text").mapInArrow(run, "word long, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def vocabulary(sample: DataFrame, toxic: int, unlabelled: int) -> np.ndarray:
    """Hashes of the words that tell, ascending: the MOST_WORDS of the most deviations, of equal ones the smaller hash."""
    a, b = F.col("p") / max(1, toxic), F.col("u") / max(1, unlabelled)
    pooled = (F.col("p") + F.col("u")) / max(1, toxic + unlabelled)
    sigmas = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / max(1, toxic) + 1 / max(1, unlabelled)))
    told = _counted(sample).where(F.col("p") >= LEAST_TEXTS).withColumn("z", F.coalesce(sigmas, F.lit(0.0))).where(F.col("z") >= LEAST_SIGMAS)
    found = told.orderBy(F.desc("z"), "word").limit(MOST_WORDS).select("word").toArrow()["word"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _drawn(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` of the distinct ids, those of the least hashes; a share by hash is taken first, so that few are sorted."""
    share = min(1.0, 1.5 * most / max(1, ids.count()))
    draw = F.xxhash64("doc_id", F.lit(13))
    few = ids.where(F.pmod(draw, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return few.distinct().orderBy(F.pmod(draw, F.lit(1 << 20)), draw, "doc_id").limit(most)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """((doc_id, y, text), prior): confirmed toxic texts and unlabelled ones, none held out, one text for an id.

    The prior is the share of toxic among the labels that are not held out.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") >= 1).alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("share")).first()["share"]
    prior = PRIOR if share is None or share == 1 else min(max(share, LEAST_PRIOR), MOST_PRIOR)
    toxic = _drawn(known.where("toxic").select("doc_id"), MOST_TOXIC).select("doc_id", F.lit(1).alias("y"))
    rest = _drawn(docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()), MOST_UNLABELLED).select("doc_id", F.lit(0).alias("y"))
    # at most MOST_TOXIC + MOST_UNLABELLED ids
    rows = docs.join(F.broadcast(toxic.unionAll(rest)), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), prior


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most MOST_TOXIC texts that labels(doc_id, toxic) confirm and MOST_UNLABELLED others."""
    drawn, prior = sample(docs, labels)
    scratch = Scratch(docs.sparkSession, "toxicity")
    drawn = scratch.keep(drawn, "sample")
    sizes = {r["y"]: r["count"] for r in drawn.groupBy("y").count().collect()}
    words = vocabulary(drawn, sizes.get(1, 0), sizes.get(0, 0)) if sizes.get(1) else np.zeros(0, np.uint64)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[bytes] = []
            for i, j, owner, h in _words(b.column(2)):
                some, at = _features(words, h)
                ends = np.searchsorted(owner[some], np.arange(j - i + 1))
                rows += [at[x:y].astype(np.int16).tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["doc_id", "y", "features"])

    kind = drawn.schema["doc_id"].dataType.simpleString()
    table = drawn.select("doc_id", "y", "text").mapInArrow(run, f"doc_id {kind}, y int, features binary")
    # an id is in the same fold as a confirmed and as an unlabelled text
    table = table.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(CLASSIFIERS))).toArrow().sort_by([("doc_id", "ascending")])
    y, fold, features = table["y"].to_numpy(), table["fold"].to_numpy(), [np.frombuffer(f, np.int16) for f in table["features"].to_pylist()]
    texts = [Texts([features[i] for i in np.flatnonzero(y == k)], fold[y == k]) for k in (1, 0)]
    scratch.close()
    return fit(words, *texts, prior)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text of docs(doc_id, text); a null text counts as empty."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text), learned from labels(doc_id, toxic).

    A null or empty text has no words and a score like any text without telling words. Repeated rows score alike, ids
    may repeat or be null (such rows are scored, not learned from), and columns other than these are ignored. An id that
    is labelled both ways is toxic. Without a confirmed text all score 0.5. An empty table gives no rows.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    scored = classify(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
