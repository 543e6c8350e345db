"""Line deduplication by a segment-partition edit join.

Two lines are near copies if so many insertions, deletions or substitutions of characters turn one into the other as
the shorter may have: none under LEAST characters (exact copies only; blank lines stay), EDITS from there, and one more
at GROWS characters and at each doubling of that. A line that may have e edits is cut into e + 1 segments; e edits leave
one of them whole, so a near copy holds it at one of a few places, which follow from the two lengths. Every line is
entered under its own segments (with length and number) and probes the segments that lines of its length and shorter
ones in reach would have; only probes for segments that may exist leave their task. Lines that meet are verified by a
banded bit-parallel edit distance. Of each class of connected lines only the first occurrence, by document and line,
stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from . import wordhash as wh
from .shared import Gate, KeyGate, PackedGate, Scratch, components, gate_size, parity_sketches, resolve_lists, runs_of, test_bits, trimmed

EDITS, LEAST, GROWS = 2, 32, 256
PIVOT_ROUNDS = 1
#: Words of 64 bits of the sketch that rules out pairs.
SKETCH_WORDS = 4
NODES = 0x11E6
#: Keys that are broadcast (8 MB of them); more are joined by a shuffle.
MOST_SENT = 1 << 20
#: Entries that are packed into one row, and buckets of keys for each shuffle partition.
PACKED, SPREAD = 1 << 16, 4
U = np.uint64
_PIECE = 1 << 20
_BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


@dataclass(frozen=True)
class Budget:
    """Edits that a pair may be apart, by the length of its shorter line; the same for all lengths if `edits` is given."""

    edits: int | None
    least: int

    @property
    def exact(self) -> bool:
        """Whether shorter lines than `least` are compared as well, as they are."""
        return self.edits is None

    def of(self, n: np.ndarray) -> np.ndarray:
        n = np.asarray(n)
        if self.edits is not None:
            return np.full(n.shape, self.edits)
        # frexp gives the number of binary digits
        return np.where(n < self.least, 0, EDITS + np.maximum(np.frexp(np.maximum(n, 1) / (GROWS // 2))[1] - 1, 0))

    def column(self, n: Column) -> Column:
        if self.edits is not None:
            return F.lit(self.edits)
        digits = F.length(F.bin(F.floor(n / (GROWS // 2))))
        return F.when(n < self.least, 0).otherwise(EDITS + F.greatest(digits - 1, F.lit(0)))


def within(a: str, b: str, edits: int) -> bool:
    """Whether at most `edits` edits turn a into b: Myers' bit vectors over a diagonal band of 2 * edits + 1 cells."""
    if abs(len(a) - len(b)) > edits:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the common prefix, by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[-mid:] == b[-mid:] else (lo, mid - 1)
    if lo:
        a, b = a[:-lo], b[:-lo]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    return _banded(a, b, edits)


def _banded(a: str, b: str, edits: int) -> bool:
    """Levels of a bit-parallel band: bit r of level e says that e edits reach diagonal r - edits at this many characters of a.

    A level holds one bit for each of the 2 * edits + 1 diagonals (j - i, with i characters of a and j of b used), so a
    step over one character of a takes a few word operations per level: a match or a substitution stays on the
    diagonal, dropping the character of a moves one diagonal down, and characters of b are added along the level below.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    where: dict[str, int] = {}  # positions of each character of b, shifted so that bit j + edits is position j
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << (j + edits)
    inside = ((1 << len(b)) - 1) << edits
    reach = ((1 << (len(b) + 1)) - 1) << edits
    levels, below = [], 0
    for e in range(edits + 1):
        x = 1 << edits if e == 0 else (below | below << 1) & mask & reach
        levels.append(x)
        below = x
    for i, c in enumerate(a):
        match, room, ends = (where.get(c, 0) >> i) & mask, (inside >> i) & mask, (reach >> (i + 1)) & mask
        fresh, old_below, new_below = [], 0, 0
        for old in levels:
            x = (old & match) | (old_below & room) | (old_below >> 1) | (new_below << 1)
            x &= mask & ends
            fresh.append(x)
            old_below, new_below = old, x
        levels = fresh
        if not levels[-1]:
            return False
    return bool(levels[-1] >> (len(b) - len(a) + edits) & 1)


#: Pairs that are worth a batch, and characters of one.
BATCH, BATCH_SIZE = 24, 1 << 21


def within_many(a: list[str], b: list[str], budget: Budget) -> np.ndarray:
    """within() of each pair, by the edits that its shorter line may have; pairs of similar lengths go together."""
    n, m = (np.array([len(x) for x in v], np.int64) for v in (a, b))
    edits, out = budget.of(np.minimum(n, m)), np.zeros(len(a), bool)
    close = np.abs(n - m) <= edits
    for e in np.unique(edits[close]).tolist():
        rows = np.flatnonzero(close & (edits == e))
        rows = rows[np.argsort(n[rows], kind="stable")]
        while len(rows):
            # as many as fit at the length of the longest
            fit = max(1, int(np.searchsorted(np.arange(1, len(rows) + 1) * n[rows], BATCH_SIZE, "right")))
            some, rows = rows[:fit], rows[fit:]
            if len(some) >= BATCH:
                out[some] = _banded_many([a[k] for k in some.tolist()], [b[k] for k in some.tolist()], e)
            else:
                out[some] = [within(a[k], b[k], e) for k in some.tolist()]
    return out


def _points(lines: list[str], size: int, before: int, fill: int) -> np.ndarray:
    """Code points, a line a column, from row `before` on."""
    out = np.full((len(lines), size), fill, np.uint32)
    for k, x in enumerate(lines):
        out[k, before : before + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(out.T)


def _banded_many(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """The levels of _banded for many pairs at once: each level is one 64-bit word a pair."""
    n, m = (np.array([len(x) for x in v], np.int64) for v in (a, b))
    width, long = 2 * edits + 1, int(n.max())
    one, full = np.uint64(1), np.uint64((1 << width) - 1)
    x, y = _points(a, long, 0, 0xFFFFFFFE), _points(b, long + width + edits, edits, 0xFFFFFFFF)
    powers = (one << np.arange(width, dtype=np.uint64))[:, None]

    def inside(i: int, size: np.ndarray) -> np.ndarray:
        """Bits of the diagonals on which position i - edits + bit is in 0 .. size - 1."""
        top = np.clip(size - i + edits, 0, width).astype(np.uint64)
        return ((one << top) - one) & ~np.uint64((1 << max(0, min(width, edits - i))) - 1)

    levels, below, start = [], None, inside(0, m + 1)
    for _ in range(edits + 1):
        below = np.full(len(a), 1 << edits, np.uint64) if below is None else (below | below << one) & start
        levels.append(below)
    out, alive = (n == 0) & (m <= edits), np.arange(len(a))
    for i in range(long):
        match = ((y[i : i + width] == x[i]) * powers).sum(0, dtype=np.uint64)
        room, ends = inside(i, m), inside(i + 1, m + 1)
        fresh, old_below, new_below = [], None, None
        for old in levels:
            z = old & match
            if old_below is not None:
                z |= (old_below & room) | (old_below >> one) | (new_below << one)
            z &= ends & full
            fresh.append(z)
            old_below, new_below = old, z
        levels = fresh
        over = n == i + 1
        if over.any():
            out[alive[over]] = (levels[-1][over] >> (m[over] - n[over] + edits).astype(np.uint64)) & one == one
        if i % 16 == 15:
            go = (levels[-1] != 0) & (n > i + 1)
            if not go.any():
                break
            if go.mean() < 0.7:
                alive, n, m, levels, x, y = alive[go], n[go], m[go], [v[go] for v in levels], np.ascontiguousarray(x[:, go]), np.ascontiguousarray(y[:, go])
    return out


def _lines(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, start, characters, code points) of the lines of a run of texts."""
    points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = offs - np.searchsorted(np.flatnonzero((part & 0xC0) == 0x80), offs)
    breaks = np.flatnonzero(points == 0x0A)
    text_of = np.searchsorted(first, breaks, "right") - 1
    n = np.diff(first) > 0
    begin = np.concatenate([first[:-1][n], breaks + 1])
    owner = np.concatenate([np.flatnonzero(n), text_of])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.append(begin[1:] - 1, len(points))
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = first[1:][owner[last]]
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return owner, number, begin, end - begin, points


@cache
def _point_hashes() -> np.ndarray:
    """A hash of every code point (9 MB, of which texts touch little)."""
    return wh.mix(np.arange(0x110000, dtype=U), 0xC0DE)


class _Hasher:
    def __init__(self, points: np.ndarray):
        self.up, self.down = wh._BYTE_POWERS.get(len(points) + 1)
        self.run = np.zeros(len(points) + 1, U)
        run = self.run[1:]
        np.take(_point_hashes(), points, out=run, mode="clip")
        with np.errstate(over="ignore"):
            run *= self.up[: len(points)]
            np.cumsum(run, out=run)

    def get(self, start: np.ndarray, size: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return wh.mix((self.run[start + size] - self.run[start]) * self.down[start] + np.asarray(salt, U) * U(0x9E3779B97F4A7C15))


def segment(length: np.ndarray, i: np.ndarray | int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of lines of these lengths; the last ones are longer by one where they don't divide."""
    base, more = length // (edits + 1), length % (edits + 1)
    plain = edits + 1 - more
    return i * base + np.maximum(0, i - plain), base + (i >= plain)


@cache
def _places(edits: int, shorter: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, move) at which a line shorter by so many characters may have a segment whole; its own place first of equal lengths."""
    found = []
    for i in range(edits + 1):
        low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
        found += [(i, move) for move in range(low, high + 1)]
    return tuple(np.array(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2


def _signatures(start: np.ndarray, length: np.ndarray, h: _Hasher, budget: Budget, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys): the segments of each line (own), or the substrings that it probes for (multi-match-aware places)."""
    if not len(length):
        return
    for shorter in range(1 if own else int(budget.of(length).max()) + 1):
        other = length - shorter
        allowed = np.where(other >= budget.least, budget.of(np.maximum(other, 0)), -1)
        for edits in np.unique(allowed[allowed >= shorter]).tolist():
            rows = np.flatnonzero(allowed == edits)
            i, move = _places(edits, shorter)
            if shorter == 0:
                i, move = i[(move == 0) == own], move[(move == 0) == own]
            at, size = segment(other[rows][:, None], i[None], edits)
            place = at + move
            r, c = np.nonzero((place >= 0) & (place + size <= length[rows][:, None]))
            ok = rows[r]
            yield ok, h.get(start[ok] + place[r, c], size[r, c], (other[ok] * 64 + i[c]) * 2 + 1)


def _long_lines(batches: Iterator[pa.RecordBatch], column: int, least: int, short: bool = False):
    """The lines of `least` characters or more; with short, also shorter ones that are not blank."""
    for b in batches:
        for at, _, part, offs in wh.pieces(*wh.strings(b.column(column)), _PIECE):
            owner, number, start, length, points = _lines(part, offs)
            h = _Hasher(points)
            fine = length >= least
            some = np.flatnonzero(~fine & (length > 0)) if short else ()
            if len(some):
                marks = ~_BLANK[np.minimum(points[wh.ranges(start[some], length[some])], len(_BLANK) - 1)]
                fine[some] = np.logical_or.reduceat(marks, np.cumsum(length[some]) - length[some])
            keep = np.flatnonzero(fine)
            owner, number, start, length = owner[keep], number[keep], start[keep], length[keep]
            yield b, at, owner, number, start, length, points, h, h.get(start, length, 0)


def _batch(names: list[str], kinds: dict[str, pa.DataType], **columns: pa.Array) -> pa.RecordBatch:
    """A batch of the given columns; the others are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kinds[c]) for c in names], names=names)


def _packed(found: list[tuple[np.ndarray, np.ndarray]], node: np.ndarray, length: np.ndarray) -> Iterator[dict[str, pa.Array]]:
    """The entries or probes (rows, keys) of some lines, many in a row: as rows of their own they would cost more than all else."""
    if not found:
        return
    rows, key = (np.concatenate(v) for v in zip(*found, strict=True))
    node, size = node[rows], length[rows].astype(np.int32)
    for at in range(0, len(key), PACKED):
        some = slice(at, at + PACKED)
        columns = {"count": pa.array([len(key[some])], pa.int32())}
        yield columns | {c: pa.array([v[some].tobytes()], pa.binary()) for c, v in (("keys", key), ("nodes", node), ("sizes", size))}


def _unpacked(column: pa.Array, kind: type = U) -> np.ndarray:
    buf, offs = wh.strings(column)
    return np.frombuffer(buf[offs[0] : offs[-1]].tobytes(), kind)


def _entries(docs: DataFrame, budget: Budget) -> DataFrame:
    """In one reading of docs(text, key, id): an occurrence (node, key, id, line) of every line, and packed entries (count, keys, nodes, sizes), each line's once a piece."""
    kind = docs.schema["id"].dataType
    packed = [StructField("count", IntegerType()), *(StructField(c, BinaryType()) for c in ("keys", "nodes", "sizes"))]
    schema = StructType([StructField("node", LongType()), StructField("key", LongType()), StructField("id", kind), StructField("line", IntegerType()), *packed])

    @trimmed
    def run(batches):
        for b, at, owner, number, start, length, _, h, node in _long_lines(batches, 0, budget.least, budget.exact):
            nothing = {"node": pa.int64(), "key": b.column(1).type, "id": b.column(2).type, "line": pa.int32(), "count": pa.int32(), "keys": pa.binary(), "nodes": pa.binary(), "sizes": pa.binary()}
            rows = pa.array(at + owner)
            yield _batch(schema.names, nothing, node=pa.array(wh.signed(node)), key=b.column(1).take(rows), id=b.column(2).take(rows), line=pa.array(number.astype(np.int32)))
            _, once = np.unique(node, return_index=True)
            once = once[length[once] >= budget.least]
            start, length, node = start[once], length[once], node[once]
            for columns in _packed([*_signatures(start, length, h, budget, True)], node, length):
                yield _batch(schema.names, nothing, **columns)

    return docs.select("text", "key", "id").mapInArrow(run, schema)


def _probes(docs: DataFrame, budget: Budget, gate: PackedGate) -> DataFrame:
    """Packed (keys, nodes, sizes) of the probes of all lines for segments that the gate may have, each line's once a piece."""
    bits, table, names = gate.bits, gate.table, ["keys", "nodes", "sizes"]

    @trimmed
    def run(batches):
        for _, _, _, _, start, length, _, h, node in _long_lines(batches, 0, budget.least):
            _, once = np.unique(node, return_index=True)
            start, length, node = start[once], length[once], node[once]
            found = []
            for rows, key in _signatures(start, length, h, budget, False):
                ok = test_bits(table.value, key & U(bits - 1))
                found.append((rows[ok], key[ok]))
            for columns in _packed(found, node, length):
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return docs.select("text").mapInArrow(run, "keys binary, nodes binary, sizes binary")


def _extremes(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, smallest node, largest node), in the order of the keys."""
    order = np.argsort(key)
    key, node = key[order], node[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    return (key[at], np.minimum.reduceat(node, at), np.maximum.reduceat(node, at)) if len(at) else (key, node, node)


def _met(spark: SparkSession, packed: DataFrame) -> DataFrame:
    """(key) of the keys that at least two nodes of packed(keys, nodes) have.

    Keys are hashes, so equal ranges of them are buckets of like size. A task sends two nodes of a key at most, however
    many lines have it.
    """
    buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = np.array([-(-(k << 64) // buckets) for k in range(buckets)], U)

    @trimmed
    def deal(batches):
        for b in batches:
            key, x, y = _extremes(_unpacked(b.column(0)), _unpacked(b.column(1)))
            if not len(key):
                continue
            cut, two, out = np.append(np.searchsorted(key, low), len(key)), x != y, []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                i, j = int(cut[k]), int(cut[k + 1])
                more = two[i:j]
                out.append((k, key[i:j].tobytes() + key[i:j][more].tobytes(), x[i:j].tobytes() + y[i:j][more].tobytes()))
            bucket, keys, nodes = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(nodes, pa.binary())], names=["bucket", "keys", "nodes"])

    @trimmed
    def meet(batches):
        for t, at in runs_of(batches, ["bucket"]):
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                some = t.slice(i, j - i)
                key, x, y = _extremes(_unpacked(some["keys"]), _unpacked(some["nodes"]))
                yield pa.RecordBatch.from_arrays([pa.array(wh.signed(key[x != y]))], names=["key"])

    dealt = packed.select("keys", "nodes").mapInArrow(deal, "bucket int, keys binary, nodes binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key long")


def _rows(packed: DataFrame, gate: Gate) -> DataFrame:
    """(key, node, n) of packed(keys, nodes, sizes), of the keys that the gate may have."""
    bits, table = gate.bits, gate.table

    @trimmed
    def run(batches):
        for b in batches:
            key = _unpacked(b.column(0))
            ok = np.flatnonzero(test_bits(table.value, key & U(bits - 1)))
            node, n = _unpacked(b.column(1))[ok], _unpacked(b.column(2), np.int32)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(wh.signed(key[ok])), pa.array(wh.signed(node)), pa.array(n)], names=["key", "node", "n"])

    return packed.select("keys", "nodes", "sizes").mapInArrow(run, "key long, node long, n int")


def _raw(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    return [points[s : s + n].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for s, n in zip(start.tolist(), length.tolist(), strict=True)]


def _texts(docs: DataFrame, least: int, gate: KeyGate) -> DataFrame:
    bits, table = gate.bits, gate.table

    @trimmed
    def run(batches):
        for _, _, _, _, start, length, points, _, node in _long_lines(batches, 0, least):
            _, once = np.unique(node, return_index=True)
            once = once[test_bits(table.value, wh.mix(node[once], NODES) & U(bits - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(wh.signed(node[once])), pa.array(_raw(points, start[once], length[once]), pa.binary())], names=["node", "payload"])

    return docs.select("text").mapInArrow(run, "node long, payload binary").groupBy("node").agg(F.first("payload").alias("payload"))


def _sketches(docs: DataFrame, least: int, gate: KeyGate) -> DataFrame:
    """Parities of the pairs of neighbouring characters (an edit changes at most two of either line), and the lines, in one reading of the texts."""
    bits, table = gate.bits, gate.table

    @trimmed
    def run(batches):
        for _, _, _, _, start, length, points, _, node in _long_lines(batches, 0, least):
            _, once = np.unique(node, return_index=True)
            once = once[test_bits(table.value, wh.mix(node[once], NODES) & U(bits - 1))]
            count = np.maximum(length[once] - 1, 0)
            at = wh.ranges(start[once], count)
            out = parity_sketches(points[at].astype(U) << U(32) | points[at + 1].astype(U), count, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(wh.signed(node[once])), pa.array(out, pa.binary()), pa.array(_raw(points, start[once], length[once]), pa.binary())], names=["node", "sketch", "payload"])

    return docs.select("text").mapInArrow(run, "node long, sketch binary, payload binary").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("payload").alias("payload"))


class _Linked:
    def __init__(self, budget: Budget):
        self.budget = budget

    @staticmethod
    def unpack(raw: bytes) -> str:
        return raw.decode("utf-8", "surrogatepass")

    def which(self, lines: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the lines i are linked with the lines j."""
        return within_many([lines[x] for x in i.tolist()], [lines[y] for y in j.tolist()], self.budget)

    def __call__(self, left: list[bytes], right: list[bytes]) -> list[int]:
        return np.flatnonzero(within_many([self.unpack(x) for x in left], [self.unpack(y) for y in right], self.budget)).tolist()


def classes(docs: DataFrame, budget: Budget, scratch: Scratch, gate_bits: int | None) -> tuple[DataFrame, DataFrame]:
    """(occurrences of lines that take part, (node, key0, line0) of the first occurrence of each class that has several)."""
    spark, least = docs.sparkSession, budget.least
    entries = scratch.keep(_entries(docs, budget), "entries")
    occurrences = entries.where("count is null").select("node", "key", "id", "line")
    index = entries.where("count is not null")
    bits = gate_bits or gate_size(index.agg(F.sum("count")).first()[0] or 0)
    index = index.select("keys", "nodes", "sizes")
    probes = scratch.keep(_probes(docs, budget, PackedGate(spark, index.select("keys"), bits)), "probes")
    both = index.unionByName(probes)
    shared = scratch.keep(_met(spark, both), "shared")
    several = shared.count()
    rows = _rows(both, Gate(spark, shared, gate_bits or gate_size(several)))
    lists = scratch.keep(rows.join(F.broadcast(shared) if several <= MOST_SENT else shared, "key", "left_semi").distinct(), "lists")
    scratch.drop(probes, shared)
    nodes = lambda wanted: KeyGate(spark, wanted, "node", NODES, bits)
    links = resolve_lists(
        scratch,
        lists,
        close=lambda n, m: F.abs(n - m) <= budget.column(F.least(n, m)),
        fetch=lambda wanted: _texts(docs, least, nodes(wanted)),
        linked=_Linked(budget),
        sketches=lambda wanted: _sketches(docs, least, nodes(wanted)),
        most=lambda n, m: np.where(np.abs(n - m) <= (e := budget.of(np.minimum(n, m))), 4 * e, -1),
        rounds=PIVOT_ROUNDS,
    )
    labels = scratch.keep(components(scratch, links), "labels")
    # a class with one occurrence has nothing to lose: its line stands once, and is linked with none
    several = occurrences.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(labels, "node", "left").where("c > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"))
    several = scratch.keep(several, "several")
    met = scratch.keep(occurrences.join(several, "node"), "met")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "line")
    first = met.groupBy("root").agg(F.min(place).alias("f"))
    return met, several.join(first, "root").select("node", F.col("f.key").alias("key0"), F.col("f.line").alias("line0"))


def dedup(docs: DataFrame, edits: int | None = None, least: int = LEAST, gate_bits: int | None = None) -> DataFrame:
    """docs with text, without all but the first occurrence of each class of near-copied lines; and n_lines, n_removed.

    Lines are what stands between line feeds, compared as they are, by characters. Without `edits`, exact copies of lines
    under `least` characters are taken out as well, blank ones aside, and longer lines may be the more edits apart the
    longer they are. With `edits`, that many hold for any length, and lines under `least` characters always stay. The
    first occurrence is that of the smallest doc_id (of any ordered type; null ids last), then of the smallest hash of
    (text, doc_id), which tells apart rows that share an id or have none, then of the smallest line number. Rows that
    agree in id and text (both ids may be null) count as one document, and share their result. A null text stays null
    and has no lines; an empty text has one, empty line; a text that loses every line becomes empty. All other columns
    stay; those named n_lines or n_removed are replaced. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    docs = docs.drop("n_lines", "n_removed")
    columns = docs.columns
    work = docs.select("text", F.xxhash64("text", "doc_id").alias("key"), F.col("doc_id").alias("id"))
    met, lead = classes(work, Budget(edits, least), scratch, gate_bits)
    gone = met.join(lead, "node").where((F.col("key") != F.col("key0")) | (F.col("line") != F.col("line0")))
    gone = gone.select("key", "line").groupBy("key").agg(F.array_distinct(F.collect_list("line")).alias("_gone")).withColumnRenamed("key", "_key")
    gone = scratch.keep(gone, "gone")
    scratch.close(gone)
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    at, n = columns.index("text"), len(columns)

    @trimmed
    def run(batches):
        for b in batches:
            texts, total, lost = [], [], []
            for t, out in zip(b.column(at).to_pylist(), b.column(n).to_pylist(), strict=True):
                lines = t.split("\n") if t is not None else []
                drop = set(out or ())
                total.append(len(lines))
                lost.append(len(drop))
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else t)
            new = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*new, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*columns, "n_lines", "n_removed"])

    marked = docs.withColumn("_key", F.xxhash64("text", "doc_id"))
    return marked.join(gone, "_key", "left").select(*columns, "_gone").mapInArrow(run, schema)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; of nothing for a null text)."""
    return dedup(docs.select("doc_id", "text"), **options).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
