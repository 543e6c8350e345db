import math

import numpy as np
import pytest

from tidemark.operators import spectral


@pytest.mark.parametrize(("n", "oversampling", "even"), [(30, 100, True), (64, 30, False), (400, 10, False)])
def test_grid_and_transform_like_direct_sums(n, oversampling, even):
    r = np.random.default_rng(n)
    t = np.arange(float(n)) if even else np.sort(r.uniform(0, n, n))
    f, t = np.array(spectral.frequencies(t.tolist(), oversampling)), t - t[0]
    known = r.random((4, n)) > 0.2
    values = np.where(known, r.normal(size=(4, n)), 0.0)
    direct, fast = spectral.Spectrum(t, f, 1 << 60), spectral.Spectrum(t, f, 0)
    assert direct.once.table is not None and fast.once.table is None
    assert np.allclose(fast.power(values, known), direct.power(values, known), rtol=1e-8, atol=1e-8)
    assert np.allclose(fast.once.sums(values), values @ np.exp(2j * math.pi * np.outer(t, f)), atol=1e-8)


def plain(times, values, freqs):
    """Power of present values by the definition."""
    n, mean = len(values), sum(values) / len(values)
    d, out = [v - mean for v in values], []
    for f in freqs:
        w = 2 * math.pi * f
        tau = math.atan2(sum(math.sin(2 * w * t) for t in times), sum(math.cos(2 * w * t) for t in times)) / 2
        c, s = [math.cos(w * t - tau) for t in times], [math.sin(w * t - tau) for t in times]
        part = lambda e: 0.0 if sum(a * b for a, b in zip(d, e, strict=True)) ** 2 < 1e-10 else sum(a * b for a, b in zip(d, e, strict=True)) ** 2 / sum(b * b for b in e)
        out.append((part(c) + part(s)) / (2 * sum(v * v for v in d) / (n - 1)))
    return out


def test_plot_data(spark):
    times = [float(t) for t in range(12)]
    a = [1.0, 2.0, 0.0, 4.0, 1.5, -3.0, 2.0, 7.0, None, 2.0, 1.0, 3.0]
    rows = [("a", a), ("few", [1.0, 2.0, 3.0, 4.0] + [0.0] * 8), ("none", None), ("flat", [2.0] * 12)]
    out = spectral.plot_data(spark.createDataFrame(rows, "id string, x array<double>"), times, 10).orderBy("id", "k").collect()
    freqs = spectral.frequencies(times, 10)
    mine = [r for r in out if r.id == "a"]
    assert np.allclose([r.omega for r in mine], [2 * math.pi * f for f in freqs]) and {r.id for r in out} == {"a", "flat"}
    kept = [(t, v) for t, v in zip(times, a, strict=True) if v and v > 0]
    assert np.allclose([r.power for r in mine], plain(*zip(*kept, strict=True), freqs))
    assert {r.power for r in out if r.id == "flat"} == {None}


def test_nulls_and_other_columns(spark):
    times = [float(t) for t in range(6)]
    rows = [(1, [None] * 6, "p"), (2, None, "q"), (3, [1.0, None, 3.0, 2.0, 5.0, 1.0], "r"), (4, [3.0, 3.0, 3.0, None, None, None], "s"), (5, [None, 1.0] + [None] * 4, "t")]
    s = spark.createDataFrame(rows, "id int, x array<double>, note string")
    for f in (spectral.lomb_scargle, spectral.autocorrelation):
        out = {r.id: r for r in f(s, times).collect()}
        assert f(s, times).columns == ["id", "x", "note"] and out[2].x is None and out[3].note == "r"
        assert all(set(out[k].x) == {None} for k in (1, 4, 5)) and None not in out[3].x
        assert f(s.limit(0), times).count() == 0
