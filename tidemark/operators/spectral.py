"""Lomb-Scargle periodograms and autocorrelations, a batch of signals at a time and without a shuffle.

All signals share the grid, so the sums over a signal's cells are sums of waves at even frequencies. Few times and
frequencies are one matrix product. Many are spread on a regular grid, each value over its neighbours by a short kernel,
and a fast Fourier transform gives all frequencies at once, divided by the kernel's own transform; nothing grows with
times multiplied by frequencies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transform import to_unit

#: Squared projections under this are rounding noise and count as zero.
NOISE = 1e-10
#: Products of times and frequencies up to which waves are tabulated.
MOST_TABLE = 1 << 16
#: Grid points for each frequency, points over which a value is spread, and the kernel's steepness: errors are about 1e-11 of the largest sum.
UPSAMPLING, WIDTH = 2, 14
STEEP = 2.3 * WIDTH
#: Signals worked on at once, by grid points.
AT_ONCE = 1 << 20
#: Numbers of results of a batch that are worked on and sent at once.
MOST_CELLS = 1 << 18


def frequencies(times: list[float], oversampling: float = 1, upper: float = 1) -> list[float]:
    """From the base frequency n / ((n - 1) window) up to n / 2 times that; the count is cut to a whole number."""
    n, window = len(times), max(times) - min(times)
    base = n / ((n - 1) * window)
    step = 1 / (oversampling * (n // 2 - 1)) * (n / 2 * upper - 1) * base
    count = int(base * n / 2 * upper / step)
    last = n / 2 * upper * base
    return [base] if count == 1 else [base + i * (last - base) / (count - 1) for i in range(count)]


class Waves:
    """Sums of values times exp(2 pi i f t) over the times t, for evenly spaced frequencies f."""

    def __init__(self, times: np.ndarray, freqs: np.ndarray, most_table: int = MOST_TABLE):
        self.count = len(freqs)
        self.table = np.exp(2j * np.pi * np.outer(times, freqs)) if len(times) * len(freqs) <= most_table else None
        if self.table is not None:
            return
        step = (freqs[-1] - freqs[0]) / max(1, self.count - 1)
        self.grid = 1 << int(np.ceil(np.log2(UPSAMPLING * max(self.count, WIDTH))))
        # frequencies count from the middle one, where the kernel's transform is largest
        middle = self.count // 2
        self.turn = np.exp(2j * np.pi * times * (freqs[0] + middle * step))
        place = np.mod(times * step, 1.0) * self.grid
        first = np.ceil(place - WIDTH / 2).astype(int)
        near = first[:, None] + np.arange(WIDTH)
        self.weight = self._kernel((near - place[:, None]) / (WIDTH / 2))
        self.near = np.mod(near, self.grid)
        k = np.arange(self.count) - middle
        z, w = np.polynomial.legendre.leggauss(4 * WIDTH)
        own = (w * self._kernel(z)) @ np.cos(2 * np.pi * np.outer(z * WIDTH / 2, k / self.grid)) * WIDTH / 2
        self.pick, self.scale = np.mod(k, self.grid), 1 / own

    @staticmethod
    def _kernel(z: np.ndarray) -> np.ndarray:
        return np.exp(STEEP * (np.sqrt(np.maximum(1 - z * z, 0)) - 1)) * (np.abs(z) <= 1)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """signals x frequencies, of signals x times."""
        if self.table is not None:
            return values @ self.table
        out, step = np.empty((len(values), self.count), complex), max(1, AT_ONCE // self.grid)
        for a in range(0, len(values), step):
            part = values[a : a + step] * self.turn
            grid = np.zeros((len(part), self.grid), complex)
            for j in range(part.shape[1]):
                np.add.at(grid, (slice(None), self.near[j]), part[:, j, None] * self.weight[j])
            out[a : a + step] = (np.fft.ifft(grid, axis=1) * self.grid)[:, self.pick] * self.scale
        return out


class Spectrum:
    """Unscaled power at the frequencies, of signals that share the times."""

    def __init__(self, times: np.ndarray, freqs: np.ndarray, most_table: int = MOST_TABLE):
        self.once, self.twice = Waves(times, freqs, most_table), Waves(times, 2 * freqs, most_table)

    def power(self, values: np.ndarray, known: np.ndarray) -> np.ndarray:
        """values have zero where not known; NaN where a projection is divided by nothing."""
        patterns, which = np.unique(known, axis=0, return_inverse=True)
        both = self.twice.sums(patterns.astype(float))[which.reshape(-1)]
        n, z = known.sum(1)[:, None], self.once.sums(values)
        cc, ss, cs = (n + both.real) / 2, (n - both.real) / 2, both.imag / 2
        theta = np.arctan2(2 * cs, cc - ss + n * 1e-20) / 2
        co, si = np.cos(theta), np.sin(theta)
        cross = 2 * cs * co * si
        return _part(z.real * co + z.imag * si, cc * co * co + cross + ss * si * si) + _part(z.imag * co - z.real * si, ss * co * co - cross + cc * si * si)


def _part(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    square = num * num
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(square < NOISE, 0.0, np.where(den == 0, np.nan, square / den))


def _centred(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells less the mean of those known, which are known) of a column of arrays; longer or shorter ones are cut or filled to n."""
    x = np.full((len(column), n), np.nan)
    size = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (size == n).all():
        x[:] = flat.reshape(len(column), n)
    else:
        ends = np.cumsum([0, *size])
        for k in range(len(size)):
            part = flat[ends[k] : ends[k + 1]][:n]
            x[k, : len(part)] = part
    known = ~np.isnan(x)
    mean = np.where(known, x, 0.0).sum(1, keepdims=True) / np.maximum(known.sum(1, keepdims=True), 1)
    return np.where(known, x - mean, 0.0), known


def _arrays(x: np.ndarray, null: np.ndarray) -> pa.Array:
    values = pa.array(np.ascontiguousarray(x).reshape(-1), pa.float64(), mask=~np.isfinite(x).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), values, mask=pa.array(null))


def _mapped(s: DataFrame, run, width: int) -> DataFrame:
    """s with x replaced by run(column of x), for as many rows at once as make MOST_CELLS numbers of `width` each."""
    step = max(1, MOST_CELLS // width)
    at, kinds = s.columns.index("x"), ", ".join(f"`{f.name}` {'array<double>' if f.name == 'x' else f.dataType.simpleString()}" for f in s.schema)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                columns = list(part.columns)
                columns[at] = run(part.column(at))
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return s.mapInArrow(batches, kinds)


def lomb_scargle(s: DataFrame, times: list[float], oversampling: float = 1, upper: float = 1, normalise: bool = False) -> DataFrame:
    """(id, x): power at frequencies(times), scaled by the sample variance; optionally of unit norm."""
    t, f = np.array(times) - times[0], np.array(frequencies(times, oversampling, upper))
    spectrum: list[Spectrum] = []

    def run(column: pa.Array) -> pa.Array:
        if not spectrum:
            spectrum.append(Spectrum(t, f))
        d, known = _centred(column, len(t))
        with np.errstate(divide="ignore", invalid="ignore"):
            variance = (d * d).sum(1) / np.where(known.sum(1) > 1, known.sum(1) - 1, np.nan)
            p = spectrum[0].power(d, known) / np.where(variance > 0, 2 * variance, np.nan)[:, None]
        return _arrays(p, column.is_null().to_numpy(zero_copy_only=False))

    s = _mapped(s, run, max(len(t), len(f)))
    return s.withColumn("x", to_unit(F.col("x"))) if normalise else s


def autocorrelation(s: DataFrame, times: list[float]) -> DataFrame:
    """(id, x): values at lags 0, 1, ... from the cosine transform of the zero-padded spectrum.

    The variance and the transform's scale cancel in the ratio to lag 0. Feed unit-norm signals: NOISE is absolute.
    """
    n = len(times)
    padded = np.array([t - times[0] for t in times] + [t + times[-1] - times[0] for t in times])
    f = 0.5 / (max(times) - min(times)) * np.arange(1, n + 1)
    m, k = np.arange(1, n + 1), np.arange((n + 1) // 2)
    turns = np.cos(np.pi * np.outer(m, 2 * k + 1) / (2 * (n + 1)))
    spectrum: list[Spectrum] = []

    def run(column: pa.Array) -> pa.Array:
        if not spectrum:
            spectrum.append(Spectrum(padded, f))
        d, known = _centred(column, n)
        lags = np.nan_to_num(spectrum[0].power(np.hstack([d, np.zeros_like(d)]), np.hstack([known, np.ones_like(known)]))) @ turns
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where(lags[:, :1] == 0, np.nan, lags / lags[:, :1])
        return _arrays(found, column.is_null().to_numpy(zero_copy_only=False))

    return _mapped(s, run, 2 * n)


def plot_data(s: DataFrame, times: list[float], oversampling: float = 100, least: int = 5) -> DataFrame:
    """(id, k, omega, power): the periodograms that a plot shows, over angular frequency.

    Only cells above zero count, and only signals with `least` of them or more.
    """
    s = s.select("id", F.transform("x", lambda v: F.when(v > 0, v)).alias("x")).where(F.size(F.array_compact("x")) >= least)
    f = frequencies(times, oversampling)
    step = (f[-1] - f[0]) / max(1, len(f) - 1)
    rows = lomb_scargle(s, times, oversampling).select("id", F.posexplode("x").alias("k", "power"))
    return rows.select("id", "k", (2 * math.pi * (f[0] + F.col("k") * step)).alias("omega"), "power")
