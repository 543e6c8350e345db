"""Byte-level BPE over length-bucketed, padded NumPy matrices.

A text is cut by the vocabulary's pattern. Distinct pieces of a batch are laid out as rows of token ids, one matrix for
each power-of-two length. In every round each row merges its leftmost pair of minimum rank: the ranks of all adjacent
pairs come from one hashed lookup, the row minima from one arg-min, and rows are compacted by shifting the tail left.
Rows without a mergeable pair leave the matrix. The ids of a piece never depend on its neighbours, so texts are put
together from the pieces they share.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .shared import small_batches, trimmed

#: A piece of more bytes than this runs the same rule on a linked list with a heap: a padded row costs the square of its length.
WIDEST = 512
#: Distinct pieces that a worker remembers between batches; older ones are forgotten together.
REMEMBERED = 200_000
_NONE = np.int64(1 << 40)
U = np.uint64


class PairTable:
    """Open-addressed hash table (left id, right id) -> rank of the joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        found: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    found[(a << 20) | b] = rank
        self.mask = (1 << max(4, int(len(found) * 3).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, _NONE, np.int64)
        keys, values = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        self.probes, step = 0, 0
        while len(keys):
            at = self._slot(keys, step)
            free = self.keys[at] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, step = keys[~put], values[~put], step + 1
        self.probes = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.view(U) * U(0x9E3779B97F4A7C15)
        return ((h >> U(33)).astype(np.int64) + step * (step + 1) // 2) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, or a number above every rank; a negative id is padding."""
        keys = (left << 20) | right
        out = np.full(keys.shape, _NONE, np.int64)
        flat, todo = out.reshape(-1), np.flatnonzero((left >= 0).reshape(-1) & (right >= 0).reshape(-1))
        k = keys.reshape(-1)
        for step in range(self.probes):
            if not len(todo):
                break
            want = k[todo]
            at = self._slot(want, step)
            there = self.keys[at]
            hit = there == want
            flat[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (there >= 0)]
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(ranks)

    @classmethod
    def load(cls, lines: Iterable[str], pattern: str) -> Bpe:
        """From the lines of a rank file: base64 of the token, a blank, its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(lengths > WIDEST):
            out[i] = self._encode_long(pieces[i])
        width = 1
        while width <= WIDEST:
            rows = np.flatnonzero((lengths <= width) & (lengths > width // 2))
            most = max(1, (1 << 20) // width)
            for k in range(0, len(rows), most):
                part = rows[k : k + most]
                for i, ids in zip(part.tolist(), self._encode_rows([pieces[i] for i in part.tolist()], width), strict=True):
                    out[i] = ids
            width *= 2
        return out

    def _encode_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((n, width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = flat
        if width == 1:
            return ids.tolist()
        out = np.full((n, width), -1, np.int64)
        live = np.arange(n)
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(live):
            at = ranks.argmin(1)  # the first of equal minima
            best = ranks[np.arange(len(live)), at]
            done = best >= _NONE
            if done.any():
                out[live[done]] = ids[done]
                keep = ~done
                live, ids, ranks, at, best = live[keep], ids[keep], ranks[keep], at[keep], best[keep]
                if not len(live):
                    break
            r = np.arange(len(live))
            ids[r, at] = best
            # compaction: what stands after the pair moves one place to the left
            source = columns + (columns > at[:, None])
            source[:, -1] = np.minimum(source[:, -1], width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            moved = np.take_along_axis(ranks, np.minimum(source[:, :-1], width - 2), 1)
            moved[:, -1] = _NONE
            ranks = moved
            here, after = ids[r, at], np.where(at + 1 < width, ids[r, np.minimum(at + 1, width - 1)], -1)
            inner = at < width - 1
            fresh = self.pairs.get(here, after)
            ranks[r[inner], at[inner]] = fresh[inner]
            left = at > 0
            ranks[r[left], at[left] - 1] = self.pairs.get(ids[r[left], at[left] - 1], here[left])
        sizes = (out >= 0).sum(1)
        return [row[:k] for row, k in zip(out.tolist(), sizes.tolist(), strict=True)]

    def _encode_long(self, piece: bytes) -> list[int]:
        ids, n = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(v), i) for i, v in enumerate(first.tolist()) if v < _NONE]
        now = {i: v for v, i in heap}
        heapq.heapify(heap)
        token, ranks = self.tokens, self.ranks

        def pair(i: int) -> None:
            rank = ranks.get(token[ids[i]] + token[ids[after[i]]]) if i >= 0 and after[i] >= 0 else None
            if rank is None:
                now.pop(i, None)
            else:
                now[i] = rank
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if now.get(i) != rank:
                continue
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            if after[gone] >= 0:
                before[after[gone]] = i
            now.pop(gone, None)
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Coder:
    """Encodes texts piece by piece, with a bounded memory of pieces: their number of ids, the ids and the bytes decoded from them.

    Ids are kept as decimals joined by blanks, or as the bytes of 32-bit integers, whichever the task needs.
    """

    def __init__(self, bpe: Bpe):
        self.bpe, self.known, self.decimal = bpe, {}, True

    def form(self, decimal: bool) -> Coder:
        if decimal != self.decimal:
            self.known, self.decimal = {}, decimal
        return self

    def learn(self, texts: list[str]) -> list[list[str]]:
        cut = [self.bpe.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = list(set().union(*cut).difference(self.known)) if cut else []
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        for p, ids in zip(fresh, self.bpe.encode_pieces(raw), strict=True):
            self.known[p] = (len(ids), " ".join(map(str, ids)) if self.decimal else np.array(ids, np.int32).tobytes(), self.bpe.decode(ids))
        return cut

    def groups(self, texts: Iterable[str]) -> Iterator[list[str]]:
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 1 << 20:
                yield group
                group, size = [], 0
        if group:
            yield group


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    if shared.id not in _coders:
        _coders.clear()
        lines, pattern = shared.value
        _coders[shared.id] = Coder(Bpe.load(lines.split("\n"), pattern))
    return _coders[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else 0

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


def _vocabulary(spark, path: str, pattern: str) -> _Shared:
    """The rank file, read once by the driver; it is a fixed file of about 1 MB, so it can be broadcast."""
    small_batches(spark)
    with open(path, encoding="ascii") as f:
        return _Shared(spark.sparkContext.broadcast((f.read(), pattern)))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of token ids (array<int>), and with the bytes decoded from them if `decoded` names a column.

    Whole texts of any length; a null text counts as empty and gives no ids. All other columns stay; a column that is
    already named `ids` or `decoded` is replaced. Repeated rows each get their ids; an empty table stays empty. To
    decode in the same pass costs no second set of Python workers.
    """
    shared = _vocabulary(docs.sparkSession, path, pattern)
    docs = docs.drop(*(c for c in (ids, decoded) if c and c != text))
    more = [StructField(ids, ArrayType(IntegerType()))] + ([StructField(decoded, BinaryType())] if decoded else [])
    schema = StructType([*docs.schema.fields, *more])
    at = docs.columns.index(text)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared).form(decimal=False)
        for b in batches:
            done = 0
            for group in coder.groups(x or "" for x in b.column(at).to_pylist()):
                values, lengths, raw = [], [0], []
                for cut in coder.learn(group):
                    found = list(map(coder.known.__getitem__, cut))
                    flat = np.frombuffer(b"".join([x[1] for x in found]), np.int32)
                    values.append(flat)
                    lengths.append(lengths[-1] + len(flat))
                    if decoded:
                        raw.append(b"".join([x[2] for x in found]))
                columns = [pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(values)))]
                if decoded:
                    columns.append(pa.array(raw, pa.binary()))
                # a batch of about a million characters at a time goes out
                yield pa.RecordBatch.from_arrays([*b.slice(done, len(group)).columns, *columns], names=schema.names)
                done += len(group)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the bytes that the ids stand for (binary). Null ids give null; an unknown id is an error."""
    shared = _vocabulary(rows.sparkSession, path, pattern)
    rows = rows.drop(out) if out != ids else rows
    schema = StructType([*rows.schema.fields, StructField(out, BinaryType())])
    at = rows.columns.index(ids)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(shared).bpe
        for b in batches:
            decoded = [None if x is None else bpe.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.binary())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, joined by one blank) and of the bytes decoded from them.

    The same encoding as encode(), without materialising the ids of a text: a text's digest is fed piece by piece.
    A null text counts as empty.
    """
    shared = _vocabulary(docs.sparkSession, path, pattern)
    docs = docs.select("doc_id", "text")
    schema = StructType([docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared).form(decimal=True)
        for b in batches:
            n, a, d = [], [], []
            for group in coder.groups(x or "" for x in b.column(1).to_pylist()):
                for cut in coder.learn(group):
                    found = list(map(coder.known.__getitem__, cut))
                    n.append(sum(x[0] for x in found))
                    a.append(hashlib.sha256(" ".join([x[1] for x in found]).encode("ascii")).hexdigest())
                    d.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, schema)


