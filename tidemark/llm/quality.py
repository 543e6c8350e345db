"""Quality classification by a sparse ensemble of rules.

Every text is reduced to a row of statistics. Boosted shallow trees over the labelled rows are taken apart: each path
from a root is a rule, a conjunction of comparisons of statistics. A logistic regression with an L1 penalty over all
rules keeps few of them, and those are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import Scratch, trimmed

#: The bound of the training sample, in labelled rows.
MOST_LABELS = 20_000
TREES, DEPTH, SHRINK, BINS, LEAF = 40, 3, 0.3, 64, 10
LASSO = 2e-4
PREDICT_FROM = 0.3
STATISTICS = ("log_bytes", "log_words", "letters", "digits", "blanks", "marks", "signs", "capitals", "word_bytes", "distinct", "adjacent", "commonest", "bigrams", "line_repeats", "line_words", "ends_marked", "bangs", "bars", "links")
_CLASS = {
    "letters": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)],
    "digits": [*range(0x30, 0x3A)],
    "blanks": [0x20, *range(0x09, 0x0E)],
    "marks": [*b".,;:!?'\"-()"],
    "signs": [*b"#$%&*+/<=>@[\\]^_`{|}~"],
}
U = np.uint64


def _classes() -> np.ndarray:
    out = np.full(256, len(_CLASS), np.uint8)
    for i, codes in enumerate(_CLASS.values()):
        out[codes] = i
    return out


def _per_text(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _groups_of(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, most frequent value's count) for each owner."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    lead = np.flatnonzero(new)
    size = np.diff(np.append(lead, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, owner[lead], size)
    return np.bincount(owner[lead], minlength=n).astype(float), top


def measure(part: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """texts x STATISTICS for a run of texts. An empty text has zeros throughout."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    over = np.maximum(size, 1)
    text = np.repeat(np.arange(n), np.diff(offs))
    kinds = np.bincount(text * 8 + _classes()[part], minlength=8 * n).reshape(n, 8)[:, : len(_CLASS)] / over[:, None]
    upper = (part >= 0x41) & (part <= 0x5A)
    bytes_first = offs
    starts, ends, first = wh.words(part, offs, wh.SPACE_WORDS)
    h = wh.word_hashes(part, starts, ends, fold=True)
    words = np.diff(first).astype(float)
    many = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(first))
    distinct, top = _groups_of(h, owner, n)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    pairs = wh.window_hashes(h, 2)
    inside = owner[1:] == owner[:-1] if len(h) > 1 else np.zeros(0, bool)
    pair_distinct, _ = _groups_of(pairs[inside], owner[1:][inside], n) if len(h) > 1 else (np.zeros(n), None)
    not_line = np.ones(256, bool)
    not_line[0x0A] = False
    ls, le, lf = wh.words(part, offs, not_line)
    lh = wh.word_hashes(part, ls, le, fold=False)
    lines = np.diff(lf).astype(float)
    line_distinct, _ = _groups_of(lh, np.repeat(np.arange(n), np.diff(lf)), n)
    last = part[ends - 1] if len(ends) else part[:0]
    single = ends - starts == 1
    letters = np.maximum(kinds[:, 0] * over, 1)
    columns = [
        np.log1p(size), np.log1p(words), *kinds.T, _per_text(upper, bytes_first) / letters, _per_text(ends - starts, first) / many, distinct / many, _per_text(same, first) / many,
        top / many, np.where(words > 1, pair_distinct / np.maximum(words - 1, 1), 1.0) * (words > 0), np.where(lines > 0, 1 - line_distinct / np.maximum(lines, 1), 0), words / np.maximum(lines, 1),
        _per_text(np.isin(last, np.frombuffer(b".,;:!?#$%&*)", np.uint8)), first) / many, _per_text(part == 0x21, bytes_first) / many, _per_text(single & (last == 0x7C), first) / many, _per_text(part == 0x2F, bytes_first) / many,
    ]
    return np.stack(columns, 1)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of every whole text; a null text counts as empty."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(part, offs) for _, _, part, offs in wh.pieces(*wh.strings(b.column(1)))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=["doc_id", *STATISTICS])

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, cut) of each comparison


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> set[Rule]:
    """The rules of all paths of boosted regression trees on the logistic gradient."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(k, c, "left") for k, c in zip(cuts, x.T, strict=True)], 1)  # x <= cuts[b] iff bin <= b
    f, rules, r = np.zeros(len(y)), set(), np.random.default_rng(5)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, w = y - p, np.maximum(p * (1 - p), 1e-6)
        sample = r.random(len(y)) < 0.7
        level: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        leaves = []
        for _ in range(depth):
            below = []
            for path, rows in level:
                used = rows[sample[rows]]
                best = None
                for j, k in enumerate(cuts):
                    if len(k) == 0 or len(used) < 2 * LEAF:
                        continue
                    sg = np.bincount(binned[used, j], g[used], len(k) + 1).cumsum()
                    sw = np.bincount(binned[used, j], w[used], len(k) + 1).cumsum()
                    sn = np.bincount(binned[used, j], minlength=len(k) + 1).cumsum()
                    gain = sg[:-1] ** 2 / (sw[:-1] + 1) + (sg[-1] - sg[:-1]) ** 2 / (sw[-1] - sw[:-1] + 1) - sg[-1] ** 2 / (sw[-1] + 1)
                    gain[(sn[:-1] < LEAF) | (sn[-1] - sn[:-1] < LEAF)] = -1
                    b = int(gain.argmax())
                    if gain[b] > 1e-3 and (best is None or gain[b] > best[0]):
                        best = (gain[b], j, b)
                if best is None:
                    leaves.append(rows)
                    continue
                _, j, b = best
                low = binned[rows, j] <= b
                for above, part in ((False, rows[low]), (True, rows[~low])):
                    rule = (*path, (j, above, float(cuts[j][b])))
                    rules.add(tuple(sorted(rule)))
                    below.append((rule, part))
            level = below
        for rows in [*leaves, *[rows for _, rows in level]]:
            if len(rows):
                f[rows] += SHRINK * np.clip(g[rows].sum() / (w[rows].sum() + 1), -4, 4)
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] > cut) if above else (x[:, j] <= cut) for j, above, cut in rule])


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and offset of the L1-penalised logistic regression, by accelerated proximal gradient steps."""
    mean = a.mean(0)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 1e-3)  # of columns of zeros and ones
    z = a.astype(np.float32)
    z -= mean.astype(np.float32)
    z /= spread.astype(np.float32)
    n, m = z.shape
    v = np.ones(m, np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1 / (0.25 * max(np.linalg.norm(z @ v) ** 2, n) / n * 1.05)
    w, b, w0, b0, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
        e = (1 / (1 + np.exp(-np.clip(z @ wy.astype(np.float32) + by, -40, 40))) - y).astype(np.float32)
        w0, b0, t = w, b, t1
        w = wy - step * (z.T @ e) / n
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = by - step * float(e.mean())
    return w / spread, float(b - (w / spread) @ mean)


@dataclass
class Ensemble:
    rules: list[tuple[Rule, float]]
    offset: float

    def column(self) -> Column:
        """The score as one expression over the columns of STATISTICS."""
        total = F.lit(self.offset)
        for rule, weight in self.rules:
            test = reduce(lambda p, q: p & q, [(F.col(STATISTICS[j]) > F.lit(cut)) if above else (F.col(STATISTICS[j]) <= F.lit(cut)) for j, above, cut in rule])
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.offset + sum((holds(r, x) * w for r, w in self.rules), np.zeros(len(x))))))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Without labels every text scores 0.5; with one class only, all score as that class does."""
    if len(y) == 0 or y.min() == y.max():
        return Ensemble([], 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
    rules = sorted(grow(x, y.astype(float)))
    if not rules:
        p = y.mean()
        return Ensemble([], float(np.log(p / (1 - p))))
    a = np.stack([holds(r, x) for r in rules], 1)
    _, lead = np.unique(np.packbits(a, axis=0).T, axis=0, return_index=True)  # rules that hold for the same rows are one
    lead.sort()
    w, b = lasso(a[:, lead], y.astype(float))
    return Ensemble([(rules[i], float(v)) for i, v in zip(lead.tolist(), w.tolist(), strict=True) if v], b)


def held_out() -> Column:
    """Rows whose labels are never read: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame) -> Ensemble:
    """Fit on at most MOST_LABELS rows of stats with a label in labels(doc_id, quality) that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    draw = F.xxhash64("doc_id", F.lit(7))
    known = known.orderBy(draw, "doc_id").limit(MOST_LABELS)
    rows = stats.join(known, "doc_id").orderBy("doc_id", *STATISTICS).limit(MOST_LABELS).toArrow().to_pandas()  # ids may repeat
    return fit(rows[list(STATISTICS)].to_numpy(float), (rows["y"] >= 1).to_numpy())


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text).

    A null or empty text has zero statistics and a score like any other. Repeated rows score alike, ids may repeat or
    be null, and columns other than these are ignored. An empty table gives no rows.
    """
    stats = Scratch(docs.sparkSession, "quality").keep(statistics(docs), "statistics")
    model = train(stats, labels.select("doc_id", "quality"))
    scored = stats.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
