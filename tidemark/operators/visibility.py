"""Visibility graphs of signals, each in one pass over the signal's arrays: no pairs of points are joined, nothing is shuffled.

Natural graphs keep the steepest slope seen so far from a point; horizontal ones keep a stack of the points that nothing
has hidden yet. Points are (id, t, x): the times and values of the cells that are present, as arrays in order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

X = F.col
KINDS, WEIGHTS = ("natural", "horizontal"), (None, "time", "tan", "distance")


def points(signals: DataFrame, times: list[float] | None = None) -> DataFrame:
    """(id, t, x) of signals(id, x): the cells that are present, at their places in the grid or at the given times."""
    at = (lambda i: i.cast("double")) if times is None else (lambda i: F.get(F.array(*[F.lit(float(t)) for t in times]), i))
    cells = F.filter(F.transform("x", lambda v, i: F.struct(at(i).alias("t"), v.cast("double").alias("x"))), lambda c: c["x"].isNotNull())
    cells = F.coalesce(cells, F.array().cast("array<struct<t: double, x: double>>"))
    return signals.select("id", cells.alias("_c")).select("id", X("_c.t").alias("t"), X("_c.x").alias("x"))


def nodes(cells: DataFrame) -> DataFrame:
    """The same of cells (id, t, x), a row each."""
    c = F.array_sort(F.collect_list(F.struct(X("t").cast("double").alias("t"), X("x").cast("double").alias("x"))))
    return cells.where("x is not null").groupBy("id").agg(c.alias("_c")).select("id", X("_c.t").alias("t"), X("_c.x").alias("x"))


def natural(t: np.ndarray, x: np.ndarray, through: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with i < j: points whose line of sight no point between reaches, or passes if `through`."""
    left, right = [], []
    for i in range(len(x) - 1):
        slope = (x[i + 1 :] - x[i]) / (t[i + 1 :] - t[i])
        steepest = np.maximum.accumulate(slope)[:-1]
        seen = slope[1:] >= steepest if through else slope[1:] > steepest
        j = i + 1 + np.concatenate([[0], 1 + np.flatnonzero(seen)])
        left.append(np.full(len(j), i))
        right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def horizontal(t: np.ndarray, x: np.ndarray, through: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with i < j: points between which all are lower than both, or none is higher than either if `through`."""
    left, right, stack, v = [], [], [], x.tolist()
    for j, high in enumerate(v):
        k = len(stack)
        while k:
            i = stack[k - 1]
            left.append(i)
            right.append(j)
            if v[i] > high:
                break
            k -= 1
            if v[i] < high or not through:
                del stack[k]
                if v[i] == high:
                    break
        stack.append(j)
    return np.array(left, int), np.array(right, int)


FIND = {"natural": natural, "horizontal": horizontal}


def weigh(t: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, weight: str | None) -> np.ndarray:
    dt, dx = np.abs(t[j] - t[i]), np.abs(x[j] - x[i])
    if weight is None:
        return np.ones(len(i))
    return {"time": lambda: dt, "tan": lambda: dx / dt + 1e-8, "distance": lambda: np.sqrt(dt * dt + dx * dx)}[weight]()


def graph(t: np.ndarray, x: np.ndarray, kind: str = "natural", weight: str | None = None, through: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, w) of one signal."""
    i, j = FIND[kind](t, x, through)
    return i, j, weigh(t, x, i, j, weight)


def dual(t: np.ndarray, x: np.ndarray, kind: str = "natural", weight: str | None = None, through: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges seen from above, and from below with a negative weight where only there or heavier; see dual_edges()."""
    n = max(len(x), 1)
    i, j, w = graph(t, x, kind, weight, through)
    found = dict(zip((i * n + j).tolist(), w.tolist(), strict=True))
    if kind == "horizontal" or (x < 0).any():
        i, j, w = graph(t, -x, kind, weight, through)
        for k, d in zip((i * n + j).tolist(), w.tolist(), strict=True):
            if found.get(k, 0.0) < d:
                found[k] = -d
    at = np.array(sorted(found), int)
    return at // n, at % n, np.array([found[k] for k in at.tolist()], float)


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def per_signal(p: DataFrame, run: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(id and the columns of schema) that run(t, x) gives for each signal, as many rows as it likes."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            found = [run(t, x) for t, x in zip(_rows(b.column(1)), _rows(b.column(2)), strict=True)]
            size = [len(f[names[0]]) for f in found]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(b)), size)))
            columns = [pa.array(np.concatenate([f[c] for f in found]) if found else [], k) for c, k in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", *names])

    return p.select("id", "t", "x").mapInArrow(batches, f"id {p.schema['id'].dataType.simpleString()}, {schema}")


def edges(p: DataFrame, kind: str = "natural", weight: str | None = None, through: bool = False) -> DataFrame:
    """(id, i, j, w) with i < j. Points between that touch the line of sight block it unless `through`."""
    return per_signal(p, lambda t, x: dict(zip("ijw", graph(t, x, kind, weight, through), strict=True)), "i long, j long, w double")


def dual_edges(p: DataFrame, kind: str = "natural", weight: str | None = None, through: bool = False) -> DataFrame:
    """Edges seen from above, and from below with a negative weight where only there or heavier.

    Of natural graphs only signals with a negative value are looked at from below.
    """
    return per_signal(p, lambda t, x: dict(zip("ijw", dual(t, x, kind, weight, through), strict=True)), "i long, j long, w double")


def degrees(p: DataFrame, kind: str = "natural", through: bool = False) -> DataFrame:
    """(id, node, degree) of the nodes that have an edge."""

    def run(t: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        d = np.bincount(np.concatenate(FIND[kind](t, x, through)), minlength=len(x))
        return {"node": np.flatnonzero(d), "degree": d[d > 0]}

    return per_signal(p, run, "node long, degree long")


def bars(p: DataFrame, kind: str = "natural", two_sided: bool = False) -> DataFrame:
    """(id, i, j, xi, xj, level, side): edges with the heights at which a bar chart draws them, both ends and the level.

    The level lies at the end nearer zero where both are on one side, else at zero. side is 1, or -1 for an edge of the
    dual graph, if two_sided, that is seen from below.
    """

    def run(t: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        i, j, w = (dual if two_sided else graph)(t, x, kind)
        a, b = x[i], x[j]
        level = np.where((a > 0) & (b > 0), np.minimum(a, b), np.where((a < 0) & (b < 0), np.maximum(a, b), 0.0))
        return {"i": i, "j": j, "xi": a, "xj": b, "level": level, "side": np.sign(w).astype(int)}

    return per_signal(p, run, "i long, j long, xi double, xj double, level double, side int")
