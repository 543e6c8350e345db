"""Vector code compression: product quantisation in whole numbers, with a kd-tree per codebook.

A vector is scaled, floored to integers and cut into equal parts; each part position has a codebook. A round
broadcasts one kd-tree for each codebook (ENTRIES entries of a part's length, so its size doesn't follow the data).
Tasks look up the nearest entry of every part by branch and bound, add the parts up by entry in integers, and send one
row for each entry they met; Spark adds those, and the driver gets one row per entry. Integer sums come out the same in
whatever order tasks end or are run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, trimmed

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a kd-tree's leaf.
LEAF = 2
#: A scaled component beyond this counts as this, so that squared distances of a vector fit 64 bits.
FARTHEST = 1 << 26
#: Labels whose totals are broadcast (some 2 MB); more are joined by a shuffle.
MOST_LABELS = 1 << 16


class Tree:
    """A kd-tree over the rows of `entries`, integers, with bounding boxes."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries = entries
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        if len(entries):
            self._grow(np.arange(len(entries)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        at, points = len(self.kids), self.entries[rows]
        self.low.append(points.min(0))
        self.high.append(points.max(0))
        self.kids.append(None)
        self.members.append(rows)
        wide = self.high[at] - self.low[at]
        axis = int(wide.argmax())
        if len(rows) > leaf and wide[axis]:
            order = rows[np.argsort(points[:, axis], kind="stable")]
            half = len(order) // 2
            self.kids[at] = (self._grow(np.sort(order[:half]), leaf), self._grow(np.sort(order[half:]), leaf))
        return at

    def bound(self, node: int, q: np.ndarray) -> np.ndarray:
        """Squared distance from each row of q to the node's box: no entry of the node is nearer."""
        gap = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        return (gap * gap).sum(1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of q; of equal ones the lower index.

        All rows go down the tree together, a node with those that still need it. A first descent to the nearer box
        gives each row a distance to beat. A node whose bound only equals it is visited too, as it may hold the same
        distance under a lower index.
        """
        n = len(q)
        best, near = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.entries))

        def look(node: int, rows: np.ndarray) -> None:
            for e in self.members[node].tolist():
                gap = q[rows] - self.entries[e]
                d = (gap * gap).sum(1)
                better = (d < best[rows]) | ((d == best[rows]) & (e < near[rows]))
                best[rows[better]], near[rows[better]] = d[better], e

        def descend(node: int, rows: np.ndarray) -> None:
            while self.kids[node] is not None and len(rows):
                one, two = self.kids[node]
                right = self.bound(two, q[rows]) < self.bound(one, q[rows])
                descend(two, rows[right])
                node, rows = one, rows[~right]
            if len(rows):
                look(node, rows)

        def visit(node: int, rows: np.ndarray) -> None:
            rows = rows[self.bound(node, q[rows]) <= best[rows]]
            if not len(rows):
                return
            if self.kids[node] is None:
                look(node, rows)
            else:
                for kid in self.kids[node]:
                    visit(kid, rows)

        if n and self.kids:
            every = np.arange(n)
            descend(0, every)
            visit(0, every)
        return near, best


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the vectors that are not null and hold only finite numbers; v has floor(scale * x)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select("vec_id", "label", x.alias("x")).where("x is not null")
    rows = rows.where(~F.exists("x", lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))))
    cut = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(float(-FARTHEST))), F.lit(float(FARTHEST)))).cast("int")
    return rows.select("vec_id", "label", F.transform("x", cut).alias("v"))


def _parts(column: pa.Array, length: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that length, rows x parts x components)."""
    fits = np.flatnonzero(np.asarray(column.value_lengths()) == length)
    flat = column.take(pa.array(fits)).flatten().to_numpy().astype(np.int64)
    return fits, flat.reshape(len(fits), parts, length // parts)


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """parts x entries x components: the parts of the vectors with the smallest ids, ties by components, null ids never."""
    first = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).toArrow()["v"].to_pylist()
    length = len(first[0]) if first else 0
    if not length or length % parts:
        return np.zeros((parts, 0, 0), np.int64)
    same = np.array([v for v in first if len(v) == length], np.int64)
    return same.reshape(len(same), parts, length // parts).transpose(1, 0, 2).copy()


def improve(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after a round: entries become the floored mean of the parts next to them, unused entries stay."""
    parts, _, width = codebooks.shape
    trees = rows.sparkSession.sparkContext.broadcast([Tree(c) for c in codebooks])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(trees.value[0].entries)
        sums, count = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for b in batches:
            _, x = _parts(b.column(0), parts * width, parts)
            for p, tree in enumerate(trees.value):
                near, _ = tree.nearest(x[:, p])
                np.add.at(sums[p], near, x[:, p])
                count[p] += np.bincount(near, minlength=size)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), *[pa.array(np.ascontiguousarray(c)) for c in sums[p, e].T]], names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    names = ["n", *[f"s{i}" for i in range(width)]]
    sums = rows.select("v").mapInArrow(run, "part int, entry int, " + ", ".join(f"{c} long" for c in names))
    total = sums.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]).toArrow().to_pandas()
    out = codebooks.copy()
    if len(total):
        out[total["part"], total["entry"]] = total[names[1:]].to_numpy(np.int64) // total["n"].to_numpy(np.int64)[:, None]
    trees.unpersist()
    return out


def encode(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error); code has two hex digits for each part, error is the squared distance of all parts."""
    parts, _, width = codebooks.shape
    trees = rows.sparkSession.sparkContext.broadcast([Tree(c) for c in codebooks])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits, x = _parts(b.column(2), parts * width, parts) if width else (np.zeros(0, np.int64), None)
            code, error = np.full(len(b), None, object), np.zeros(len(b), np.int64)
            if len(fits):
                found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees.value)]
                code[fits] = [row.tobytes().hex() for row in np.stack([near for near, _ in found], 1).astype(np.uint8)]
                error[fits] = sum(d for _, d in found)
            none = np.ones(len(b), bool)
            none[fits] = False
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error, mask=none)], names=["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"{kinds}, code string, error long")


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of vectors(vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components are left out; all others have a row each, whether
    their ids repeat or are null. The first codebooks come from the smallest ids; with fewer vectors than entries they
    have as many as there are vectors. Components beyond FARTHEST / scale count as that. A vector that is not as long
    as that of the smallest id, or can't be cut into equal parts, has neither code nor error and takes no part in the
    codebooks; so have all where no row has an id. An empty table gives no rows and empty codebooks. Columns other than
    the three are ignored. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError(f"{entries} entries; a code has two hex digits a part")
    rows = Scratch(vectors.sparkSession, "codes").keep(whole(vectors, scale), "whole")
    codebooks = first_codebooks(rows, parts, entries)
    for _ in range(rounds if codebooks.size else 0):
        codebooks = improve(rows, codebooks)
    return encode(rows, codebooks), codebooks


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that compress() codes.

    label_error is the error of all rows of the same label, of those without a label together; rows without a code
    count for nothing.
    """
    codes, codebooks = compress(vectors)
    codes = Scratch(vectors.sparkSession, "codes").keep(codes, "codes")
    total = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if total.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        total = F.broadcast(total)
    found = codes.join(total, codes["label"].eqNullSafe(total["_label"]))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 8) -> str:
    """The same in SQL, for vectors of parts * width components: a row for each part, and a table of entries for each round."""
    kept = f"""kept as materialized (
      select vec_id, label, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as v
      from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0)"""
    cut = f"cut as materialized (select vec_id, label, p, v[{width} * p + 1 : {width} * p + {width}] as x from kept cross join (select unnest(range({parts})) as p) g)"
    start = f"b0 as materialized (select p, e, x from (select p, x, row_number() over (partition by p order by vec_id) - 1 as e from cut) f where e < {entries})"
    gap = " + ".join(f"(c.x[{i}] - b.x[{i}]) * (c.x[{i}] - b.x[{i}])" for i in range(1, width + 1))
    near = lambda k: f"a{k} as materialized (select vec_id, any_value(label) as label, p, any_value(x) as x, min(struct_pack(d := d, e := e)) as m from (select c.vec_id, c.label, c.p, c.x, b.e, {gap} as d from cut c join b{k} b using (p)) group by vec_id, p)"
    floored = lambda i: f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*)"
    move = lambda k: f"b{k + 1} as materialized (select b.p, b.e, coalesce(n.x, b.x) as x from b{k} b left join (select p, m.e as e, [{', '.join(f'cast({floored(i)} as bigint)' for i in range(1, width + 1))}] as x from a{k} group by p, m.e) n on n.p = b.p and n.e = b.e)"
    steps = [kept, cut, start, *[s for k in range(rounds) for s in (near(k), move(k))], near(rounds)]
    return f"""with {', '.join(steps)},
      book as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as h from b{rounds}),
      found as (select vec_id, any_value(label) as label, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error from a{rounds} group by vec_id)
      select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from found cross join book"""


ORACLE = _oracle()
