"""Array functions that built-in expressions can't give: recursive filters, resampling, segmentation, time warping.

Each is a small NumPy kernel behind an Arrow UDF; Spark holds, shuffles and prunes the rows around it.
Rows are independent of each other, so none of these needs a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a warping band in samples, whatever share of the length is asked for.
LEAST_BAND, GREATEST_BAND = 8, 500
SEGMENTS = "array<struct<s:int,e:int,mean:double,std:double,len:int>>"


def second_order(cutoff: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a low-pass of order two; cutoff as a share of the sampling rate."""
    w = 4 * math.tan(math.pi * cutoff)
    r = {"bessel": math.sqrt(3), "butterworth": math.sqrt(2)}[kind]
    d = 16 + 4 * r * w + w * w
    return np.array([w * w, 2 * w * w, w * w]) / d, np.array([1.0, 2 * (w * w - 16) / d, (16 - 4 * r * w + w * w) / d])


def filter_once(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The recursion along each row, started in the state of a constant signal of the row's first value; all rows at once."""
    z1 = (b[1:].sum() - b[0] * a[1:].sum()) / a.sum() * x[:, 0]
    z2 = (b[2] * (1 + a[1]) - a[2] * (b[0] + b[1])) / a.sum() * x[:, 0]
    out = np.empty_like(x)
    for i in range(x.shape[1]):
        v = x[:, i]
        y = out[:, i] = b[0] * v + z1
        z1 = b[1] * v - a[1] * y + z2
        z2 = b[2] * v - a[2] * y
    return out


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray, pad: int = 9) -> np.ndarray:
    """Forward and backward over an odd extension of each row; signals of at most pad samples stay as they are."""
    if x.ndim == 1:
        return zero_phase(x[None], b, a, pad)[0]
    n = x.shape[1]
    if n <= pad:
        return x
    ext = np.c_[2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]]
    return filter_once(filter_once(ext, b, a)[:, ::-1], b, a)[:, ::-1][:, pad : pad + n]


def chebyshev(order: int, ripple: float, cutoff: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections of order two of an even low-pass with ripple decibels in its pass band; cutoff as a share of the sampling rate."""
    e = math.sqrt(10 ** (ripple / 10) - 1)
    angle = np.pi * np.arange(1, order, 2) / (2 * order)
    s = 4 * math.tan(math.pi * cutoff) * -np.sinh(math.asinh(1 / e) / order + 1j * angle)
    z = (4 + s) / (4 - s)
    a = [np.array([1.0, -2 * p.real, abs(p) ** 2]) for p in z]
    gain = (1 + e * e) ** (-1 / order)
    return [(np.array([1.0, 2.0, 1.0]) * v.sum() / 4 * gain, v) for v in a]


def halved(x: np.ndarray) -> np.ndarray:
    """Every second sample of each row after a zero-phase low-pass of order eight at 0.8 of the new limit.

    Series of at most 27 samples, too short for the filter's run-up, are thinned out as they are.
    """
    if x.ndim == 1:
        return halved(x[None])[0]
    pad, y, n = 27, x, x.shape[1]
    if n > pad:
        y = np.c_[2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]]
        sections = chebyshev(8, 0.05, 0.2)
        for _ in range(2):
            for b, a in sections:
                y = filter_once(y, b, a)
            y = y[:, ::-1]
        y = y[:, pad : pad + n]
    return y[:, ::2]


def fourier(x: np.ndarray, n: int) -> np.ndarray:
    """len(x) samples as n by their spectrum, cut or filled up with zeros; a series that is empty gives zeros."""
    if len(x) == 0:
        return np.zeros(n)
    if len(x) == n:
        return x
    m = min(n, len(x))
    y = np.zeros(n // 2 + 1, complex)
    y[: m // 2 + 1] = np.fft.rfft(x)[: m // 2 + 1]
    if m % 2 == 0:  # the highest frequency stands for two where it becomes or ceases to be the limit
        y[m // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(y, n) * (n / len(x))


def alike(series: list[np.ndarray]) -> dict[int, list[int]]:
    """Places of the series of each length, so that a kernel takes them as the rows of one matrix."""
    out: dict[int, list[int]] = {}
    for k, v in enumerate(series):
        out.setdefault(len(v), []).append(k)
    return out


def polyphase(x: np.ndarray, n: int) -> np.ndarray:
    """len(x) samples as n by a windowed sinc, zeros beyond the edges."""
    if len(x) == 0 or len(x) == n:
        return x
    g = math.gcd(n, len(x))
    up, down = n // g, len(x) // g
    m = max(up, down)
    k = np.arange(20 * m + 1)
    h = np.sinc((k - 10 * m) / m) / m * np.kaiser(20 * m + 1, 5.0)
    h *= up / h.sum()
    # Each output meets at most as many inputs as the window is wide.
    first = np.ceil((np.arange(n) * down - 10 * m) / up).astype(int)
    at = first[:, None] + np.arange(20 * m // up + 1)[None, :]
    tap = 10 * m + np.arange(n)[:, None] * down - at * up
    inside = (at >= 0) & (at < len(x)) & (tap >= 0) & (tap < len(h))
    return (np.where(inside, h[np.clip(tap, 0, len(h) - 1)], 0.0) * x[np.clip(at, 0, len(x) - 1)]).sum(1)


def split_segments(x: np.ndarray, least_gain: float = 18.0, least_len: int = 10) -> list[tuple[int, int]]:
    """Cut where two Gaussians explain the samples better than one, again and again, until no cut gains enough.

    A piece below twice the least length stays whole, and the right part of a cut is longer than the
    least length by one at least; parts without spread count as of spread 1e-12.
    """
    tiny = 1e-12
    s1, s2 = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(x * x)]

    def log_sd(a, b):
        n = b - a
        var = (s2[b] - s2[a]) / n - ((s1[b] - s1[a]) / n) ** 2
        return np.log(np.sqrt(np.where(var > 0, var, tiny * tiny)) + tiny)

    todo, done = [(0, len(x))], []
    while todo:
        a, b = todo.pop()
        cuts = np.arange(a + least_len, b - least_len)
        if len(cuts):
            gain = (b - a) * log_sd(a, b) - ((cuts - a) * log_sd(a, cuts) + (b - cuts) * log_sd(cuts, b))
            best = int(np.argmax(gain))
            if gain[best] > least_gain:
                todo += [(int(cuts[best]), b), (a, int(cuts[best]))]
                continue
        done.append((a, b))
    return sorted(done)


def warp_many(xs: list[np.ndarray], ys: list[np.ndarray], band: float = 0.1) -> np.ndarray:
    """Time warping of each of xs with the same of ys, with absolute differences within a band about the
    diagonal, over the length of the path. All pairs take a step of the recursion at once.

    Of equally cheap steps the one down is taken before the one across and the diagonal. Infinite if
    either side is empty.
    """
    g = len(xs)
    n, m = np.array([len(x) for x in xs], int), np.array([len(y) for y in ys], int)
    out = np.full(g, np.inf)
    if not g or not n.max() or not m.max():
        return out
    x, y = np.zeros((n.max(), g)), np.zeros((m.max(), g))
    for k in range(g):
        x[: n[k], k], y[: m[k], k] = xs[k], ys[k]
    w = np.maximum(np.clip(np.ceil(band * np.maximum(n, m)), LEAST_BAND, GREATEST_BAND), abs(n - m)).astype(int)
    widest, even = int(w.max()), bool((w == w[0]).all())
    cost, steps = np.full((len(y) + 1, g), np.inf), np.zeros((len(y) + 1, g), int)
    cost[0] = 0.0
    for i in range(1, len(x) + 1):
        new, new_steps = np.full_like(cost, np.inf), np.zeros_like(steps)
        for j in range(max(1, i - widest), min(len(y), i + widest) + 1):
            best, k = cost[j], steps[j]
            across = new[j - 1] < best
            best, k = np.where(across, new[j - 1], best), np.where(across, new_steps[j - 1], k)
            diagonal = cost[j - 1] < best
            best, k = np.where(diagonal, cost[j - 1], best), np.where(diagonal, steps[j - 1], k)
            best = best + np.abs(x[i - 1] - y[j - 1])
            new[j] = best if even else np.where(abs(i - j) <= w, best, np.inf)
            new_steps[j] = k + 1
        cost, steps = new, new_steps
        done = np.flatnonzero((n == i) & (m > 0))
        if len(done):
            length = steps[m[done], done]
            out[done] = np.where(length > 0, cost[m[done], done] / np.maximum(length, 1), np.inf)
    return out


def warp_distances(x: np.ndarray, y: np.ndarray, band: float = 0.1) -> np.ndarray:
    """warp_many of the rows of two matrices."""
    return warp_many(list(x), list(y), band)


def warp_path(x: np.ndarray, y: np.ndarray, band: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest path between two series within the band of warp_distances, as places in either.

    Of equally cheap steps back the diagonal is taken before the one in x and the one in y.
    """
    n, m = len(x), len(y)
    w = max(min(max(math.ceil(band * max(n, m)), LEAST_BAND), GREATEST_BAND), abs(n - m))
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0.0
    gap = np.abs(x[:, None] - y[None, :])
    for s in range(2, n + m + 1):  # cells of one diagonal don't depend on each other
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        i = i[np.abs(2 * i - s) <= w]
        j = s - i
        cost[i, j] = gap[i - 1, j - 1] + np.minimum(cost[i - 1, j - 1], np.minimum(cost[i - 1, j], cost[i, j - 1]))
    i, j, path = n, m, []
    while i and j:
        path.append((i - 1, j - 1))
        ways = cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]
        k = int(np.argmin(ways))
        i, j = i - (k != 2), j - (k != 1)
    return tuple(np.array(path[::-1]).T)


def barycentre(start: np.ndarray, series: list[np.ndarray], turns: int = 10, band: float = 0.1) -> np.ndarray:
    """The mean course of several series under warping: each turn maps all of them to the course and takes the mean of
    what falls to each place, until it stays as it is."""
    mean = start.copy()
    for _ in range(turns):
        total, count = np.zeros(len(mean)), np.zeros(len(mean))
        for v in series:
            i, j = warp_path(v, mean, band)
            total += np.bincount(j, v[i], len(mean))
            count += np.bincount(j, minlength=len(mean))
        new = total / count
        if np.allclose(new, mean):
            break
        mean = new
    return mean


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    flat = np.asarray(lists.flatten(), dtype=float)
    ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _series(fn):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([fn(x).tolist() for x in _arrays(lists)], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def _rows_alike(fn) -> Column:
    """fn, which takes series of one length as the rows of a matrix, over all series of a batch."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            series = _arrays(lists)
            for at in alike(series).values():
                for k, row in zip(at, fn(np.array([series[k] for k in at]))):
                    series[k] = row
            flat = np.concatenate(series) if series else np.zeros(0)
            ends = np.cumsum([0, *map(len, series)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float64()))

    return F.arrow_udf(run, "array<double>")


def low_pass(x: Column, cutoff: float = 0.2, kind: str = "bessel") -> Column:
    """x smoothed without a shift in phase."""
    b, a = second_order(cutoff, kind)
    return _rows_alike(lambda rows: zero_phase(rows, b, a))(x)


def halve(x: Column, least: int = 32) -> Column:
    """Series of at least so many samples by every second one after a low-pass; shorter ones stay as they are."""
    return _rows_alike(lambda rows: halved(rows) if rows.shape[1] >= least else rows)(x)


def resample_fourier(x: Column, n: int) -> Column:
    """x as n samples by its spectrum; empty becomes n zeros."""
    return _series(lambda v: fourier(v, n))(x)


def resample_polyphase(x: Column, n: int) -> Column:
    """x as n samples; empty stays empty."""
    return _series(lambda v: polyphase(v, n))(x)


def center_weighted(x: np.ndarray, n: int, center: float = 0.6) -> np.ndarray:
    """x as n samples that lie closer together in the middle, by the inverse of a bell's running sum, interpolated."""
    size = len(x)
    if size == n or size < 2:
        return x if size == n else np.full(n, x[0])
    bell = np.exp(-(np.linspace(-1, 1, size) ** 2) * max(2.0, 5.0 * (1 - center)))
    run = np.cumsum(bell / bell.sum())
    at = np.interp(np.linspace(0, 1, n), run, np.arange(size))
    return np.interp(at, np.arange(size), x)


def resample_center(x: Column, n: int) -> Column:
    """x as n samples, denser in the middle; empty stays empty."""
    return _series(lambda v: center_weighted(v, n) if len(v) else v)(x)


def segments(x: Column, least_gain: float = 18.0, least_len: int = 10) -> Column:
    """x cut into segments that tile it, as structs (s, e, mean, std, len); empty for an empty signal."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            cut, ends = [], [0]
            for v in _arrays(lists):
                cut += [(a, b, v[a:b].mean(), v[a:b].std()) for a, b in split_segments(v, least_gain, least_len)] if len(v) else []
                ends.append(len(cut))
            a, b, mean, std = np.array(cut, dtype=float).reshape(-1, 4).T
            fields = {"s": pa.array(a.astype(np.int32)), "e": pa.array(b.astype(np.int32)), "mean": pa.array(mean), "std": pa.array(std), "len": pa.array((b - a).astype(np.int32))}
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    return F.arrow_udf(run, SEGMENTS)(x)


def warp(x: Column, y: Column, band: float = 0.1) -> Column:
    """Warping distance of two series; null if it is infinite."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            xs, ys = _arrays(a), _arrays(b)
            order = np.argsort([len(v) for v in xs], kind="stable")  # pairs of like lengths together
            d = np.full(len(xs), np.inf)
            for part in np.array_split(order, -(-len(order) // 2048) or 1):
                d[part] = warp_many([xs[k] for k in part], [ys[k] for k in part], band)
            yield pa.array(d, pa.float64(), mask=~np.isfinite(d))

    return F.arrow_udf(run, "double")(x, y)
