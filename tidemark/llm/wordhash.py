"""Vectorised word and n-gram hashing straight on Arrow string buffers.

A record batch of texts is one run of UTF-8 bytes with offsets. Words, their 64-bit hashes and the hashes of all
k-word windows come from a handful of NumPy passes over that run; no Python string is made. Separators and letters
that the callers care about are ASCII, so byte classes decide exactly what the code-point patterns decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at a time; a longer text is one piece of its own.
PIECE = 1 << 20

_MULT, _WORD_MULT = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x + U(salt & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def _table(salt: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15), salt) | U(1)


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n + n // 8, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.cumprod(steps, dtype=U))
        return self.up[:n], self.down[:n]


    def forget(self) -> None:
        self.up = self.down = np.ones(1, U)


_BYTE_POWERS, _WORD_POWERS = _Powers(_MULT), _Powers(_WORD_MULT)


def forget() -> None:
    """Free the tables of powers; they grow again on demand."""
    _BYTE_POWERS.forget()
    _WORD_POWERS.forget()


#: Words of [^\x20\x09-\x0D]+ : every byte but ASCII white space.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased: digits, letters and all bytes of non-ASCII characters.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def pieces(buf: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, bytes, offsets) of runs of whole texts of at most `most` bytes, or of one longer text."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and, last, their number); a word never crosses texts."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[buf]
    change = np.empty(n + 1, bool)
    change[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    begins = change & inside
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    joined = edges[inside[edges] & inside[edges - 1]]
    begins[joined] = True
    finishes = change & ~inside
    finishes[joined] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, salt: int = 1) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, from one running sum."""
    table = _table(salt)
    if fold:
        table = table[FOLD]
    up, down = _BYTE_POWERS.get(len(buf) + 1)
    run = np.zeros(len(buf) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(table[buf] * up[: len(buf)], out=run[1:])
        return mix((run[ends] - run[starts]) * down[starts], 0x51ED)


def window_hashes(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hash of hashes[i : i + k] for each i; windows across texts must be left out by the caller."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    up, down = _WORD_POWERS.get(n + 1)
    run = np.zeros(n + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum((hashes if not salt else mix(hashes, salt)) * up[:n], out=run[1:])
        return mix((run[k:] - run[: n - k + 1]) * down[: n - k + 1], 0xA5A5 + k)


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hash of hashes[starts[i] : ends[i]]."""
    n = len(hashes)
    up, down = _WORD_POWERS.get(n + 1)
    run = np.zeros(n + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum((hashes if not salt else mix(hashes, salt)) * up[:n], out=run[1:])
        return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F), 0x77)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
