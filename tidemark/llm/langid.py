"""Language identification with string kernels.

A text is the set of its letter n-grams (n = 1, 2, 3; presence, not counts), hashed into BUCKETS places per order. The
blended-spectrum kernel of two texts is the mean over the orders of the normalised number of shared n-grams. LANDMARKS
labelled texts give a Nystroem feature map, kernel ridge regression fits one score per language against the rest, and
a batch of texts is scored by two matrix products: with the landmarks' sets, and with the weights.

The scores of the languages sum to the same number for any text, so the best one says nothing about texts in a language
that was not learned. Those are told by the share of their 2- and 3-grams that no learned text of the predicted language
has; how large that share is for a text of the language comes from the learned texts, each against the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import small_batches, trimmed

BUCKETS = (512, 2048, 4096)
WIDTH = sum(BUCKETS)
LANDMARKS = 256
#: The bound of the training sample: labelled texts per language, and in all.
PER_LANGUAGE, MOST_TEXTS = 500, 6_000
#: Languages that are learned, the most frequent ones; each has a landmark at least.
MOST_LANGUAGES = 256
RIDGE = 1e-3
#: A text is foreign if its unseen share is over SLACK times that which SHARE_OVER of the learned texts exceed, by over MOST_STRAY n-grams.
SHARE_OVER, SLACK, MOST_STRAY = 0.001, 1.5, 2
UNKNOWN = "und"
U = np.uint64
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x WIDTH booleans, whether a text has a letter); runs of other characters count as one blank."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int64), sizes)
    is_letter = letters()[points]
    out = np.zeros((len(low), WIDTH), bool)
    flat = out.reshape(-1)
    keep = is_letter.copy()
    if len(points):
        # a blank stands for each run of non-letters between letters
        keep[1:] |= ~is_letter[1:] & is_letter[:-1] & (row[1:] == row[:-1])
    code, row = np.where(is_letter, points, 32)[keep].astype(U), row[keep]
    any_letter = np.zeros(len(low), bool)
    any_letter[row[code != 32]] = True
    base, h = 0, np.zeros(len(code), U)
    with np.errstate(over="ignore"):
        for order, places in enumerate(BUCKETS):
            n = len(code) - order
            if n <= 0:
                break
            h = (h[:n] + code[order:] + U(1)) * U(_SEEDS[order])
            h ^= h >> U(29)
            place = ((h >> U(20)) & U(places - 1)).astype(np.int64) + base
            if order:
                same = row[:n] == row[order:]
                flat[row[:n][same] * WIDTH + place[same]] = True
            else:
                letter = code != 32
                flat[row[letter] * WIDTH + place[letter]] = True
            base += places
    return out, any_letter


def normalised(bits: np.ndarray) -> np.ndarray:
    """Rows whose products are the blended kernel."""
    x, base = bits.astype(np.float32), 0
    for places in BUCKETS:
        part = x[:, base : base + places]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1.0) * len(BUCKETS))
        base += places
    return x


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    #: (languages x places of 2- and 3-grams), and the unseen share that a text of each language may have
    seen: np.ndarray
    stray: np.ndarray

    def foreign(self, bits: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether texts have more n-grams that their language lacks than its own texts do."""
        grams = bits[:, BUCKETS[0] :].astype(np.float32)
        size = grams.sum(1)
        unseen = size - (grams @ self.seen.T)[np.arange(len(best)), best]
        return unseen > self.stray[best] * size + MOST_STRAY

    def predict(self, texts: list[str], strict: bool = False) -> tuple[list[str], np.ndarray]:
        """(languages, scores); if strict, texts in a language that was not learned are unknown too."""
        bits, known = presence(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        f = (normalised(bits) @ self.landmarks.T).astype(np.float64) @ self.weights + self.offset
        best = f.argmax(1)
        score = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)
        if strict:
            known = known & ~self.foreign(bits, best)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def fit(bits: np.ndarray, names: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((0, WIDTH), np.float32), np.zeros((0, 0)), np.zeros(0), np.zeros((0, WIDTH - BUCKETS[0]), np.float32), np.zeros(0))
    y = np.array([languages.index(x) for x in names])
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(languages))])
    x = normalised(bits)
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ marks.T).astype(np.float64) @ root
    # each language weighs the same, however many texts it has
    share = 1.0 / np.maximum(np.bincount(y, minlength=len(languages)), 1)[y]
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    mean, middle = (phi * share[:, None]).sum(0) / share.sum(), (target * share[:, None]).sum(0) / share.sum()
    p, t = phi - mean, target - middle
    beta = np.linalg.solve(p.T @ (p * share[:, None]) + ridge * np.eye(p.shape[1]), p.T @ (t * share[:, None]))
    weights, offset = root @ beta, middle - mean @ beta
    best = ((x @ marks.T).astype(np.float64) @ weights + offset).argmax(1)
    return Model(languages, marks, weights, offset, *_vocabulary(bits, y, best, len(languages)))


def _vocabulary(bits: np.ndarray, y: np.ndarray, best: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(seen, stray): the 2- and 3-grams of each language, and its limit of unseen ones; a text does not vouch for itself."""
    grams = bits[:, BUCKETS[0] :]
    count = np.stack([grams[y == k].sum(0) for k in range(languages)])
    stray = np.ones(languages)
    for k in range(languages):
        shares = []
        for i in np.flatnonzero(best == k):
            had = count[k][grams[i]]
            shares.append((had <= (y[i] == k)).mean() if len(had) else 0.0)
        if shares:
            stray[k] = SLACK * np.quantile(shares, 1 - SHARE_OVER, method="higher")
    return (count > 0).astype(np.float32), stray


def _groups(texts: list[str], most: int = 64, chars: int = 1 << 19) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and (len(group) >= most or size + len(t) > chars):
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def train(docs: DataFrame, allowed: Column) -> Model:
    """Fit on a bounded sample of the rows with a language, a text with a letter, and `allowed`; whole texts are used.

    Of more than MOST_LANGUAGES languages the most frequent are learned, ties by name; texts in others are never sampled.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)).alias("draw"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "lang").limit(MOST_LANGUAGES).collect()
    each = min(PER_LANGUAGE, MOST_TEXTS // max(1, len(counts)))
    shares = [(r["lang"], int((1 << 30) * min(1.0, 1.2 * each / r["c"] + 1e-6))) for r in counts]
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share int"))  # MOST_LANGUAGES rows at most

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = 0, b.column(1).to_pylist()
            for group in _groups(texts):
                bits, known = presence(group)
                packed = np.packbits(bits, axis=1)
                keep = np.flatnonzero(known)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(group)).take(pa.array(keep)), b.column(2).slice(at, len(group)).take(pa.array(keep)), pa.array([packed[i].tobytes() for i in keep], pa.binary())], names=["lang", "draw", "bits"])
                at += len(group)

    found = rows.join(shares, "lang").where("draw < share").select("lang", "text", "draw").mapInArrow(run, "lang string, draw long, bits binary").toArrow().to_pandas() if counts else None
    if found is None or not len(found):
        return fit(np.zeros((0, WIDTH), bool), [])
    found = found.sort_values(["draw", "bits"], kind="stable").groupby("lang", sort=False).head(each)
    bits = np.unpackbits(np.frombuffer(b"".join(found["bits"]), np.uint8).reshape(len(found), -1), axis=1)[:, :WIDTH].astype(bool)
    return fit(bits, found["lang"].tolist())


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 on division by 4. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, model: Model, strict: bool = False) -> DataFrame:
    """docs with lang_pred and score (0 to 1) for the whole text of every row.

    Texts that are null or without a letter are `und` with score 0, as is every text if nothing could be learned. If
    strict, so are texts in a language that was not learned, and gibberish.
    Columns that already have these names are replaced; repeated rows get equal answers; empty tables stay empty.
    """
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            for group in _groups([t or "" for t in b.column(at).to_pylist()]):
                n, s = shared.value.predict(group, strict)
                names += n
                scores += s.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that are not held out."""
    model = train(docs, ~held_out())
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
