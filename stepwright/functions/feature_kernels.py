"""Feature blocks that need a scan of the samples: peaks, rolling slopes, scales, the drop, zero lag, steps.

Each is a function of one series to a list of numbers in a fixed order of names; NaN is undefined. Spark
calls them by Arrow batches, see block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import _arrays, split_segments

NAN = float("nan")
SCALES = (4, 8, 16, 32)
#: Squares about the mean that add up to no more than this are rounding, and the series is flat.
FLAT = 1e-18

PEAKS = ("n_peaks", "mean_peak_val", "mean_peak_prom", "mean_peak_dist", "median_peak_dist", "peak_dist_q10", "peak_dist_q90", "n_troughs", "mean_trough_val", "mean_trough_prom")
ROLLING = ("median_rolling_slope", "rolling_slope_q60", "std_rolling_slope", "mean_rolling_slope", "max_rolling_slope", "min_rolling_slope", "avg_abs_rolling_slope", "rolling_slope_q25", "rolling_slope_q75")
MULTISCALE = tuple(f"ms{s}_{k}" for s in SCALES for k in ("std", "iqr", "tv_mean", "ac1", "zcr"))
DROP = ("drop_idx", "drop_pre_mean", "drop_post_min", "drop_depth", "drop_duration", "drop_auc", "drop_auc_norm")
LAG = ("ac_zero_cross_lag",)
SPECTRAL = ("total_power", "spectral_centroid", "spectral_bandwidth", "spectral_entropy", "dominant_freq")
STEPS = (
    "n_steps", "min_step_len", "max_step_len", "mean_step_len", "median_step_len", "std_step_len", "prop_short_steps",
    "mean_step_mean", "std_step_mean", "min_step_mean", "max_step_mean", "q25_step_mean", "q75_step_mean", "step_mean_iqr", "step_mean_mad",
    "mean_step_height", "mean_abs_step_height", "max_step_height", "min_step_height", "median_abs_step_height",
    "mean_step_std", "q25_step_std", "q75_step_std", "n_high_std_steps", "frac_high_std_steps", "mean_step_dist_frac", "median_step_dist_frac", "mono_full", "mono_excl_last",
)


def order_statistic(x: np.ndarray, q: float) -> float:
    """The value at floor(q * (n - 1)) of the sorted samples."""
    i = int(np.floor(q * (len(x) - 1)))
    return float(np.partition(x, i)[i])


def tops(x: np.ndarray) -> np.ndarray:
    """Local maxima, a level one at its middle (the left of two); the ends of the series are none."""
    start = np.r_[0, np.flatnonzero(np.diff(x)) + 1]
    end = np.r_[start[1:] - 1, len(x) - 1]
    v = x[start]
    inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (start[inner] + end[inner]) // 2


def peaks(x: np.ndarray) -> list[float]:
    up, down, mid = tops(x), tops(-x), float(np.median(x))
    gap = np.diff(up).astype(float)
    far = [gap.mean(), np.median(gap), order_statistic(gap, 0.1), order_statistic(gap, 0.9)] if len(gap) else [NAN] * 4
    high = [x[up].mean(), (x[up] - mid).mean()] if len(up) else [0.0, 0.0]
    low = [x[down].mean(), (mid - x[down]).mean()] if len(down) else [0.0, 0.0]
    return [len(up), *high, *far, len(down), *low]


def rolling(x: np.ndarray, size: int = 100) -> list[float]:
    """Least squares slopes of all windows; windows without spread don't count, zeros without a window."""
    if len(x) < size:
        return [0.0] * len(ROLLING)
    w = np.lib.stride_tricks.sliding_window_view(x, size)
    i = np.arange(size) - (size - 1) / 2
    slope = (w @ i / (i @ i))[w.var(axis=1) > 1e-12]
    if not len(slope):
        return [0.0] * len(ROLLING)
    q25, q50, q60, q75 = np.percentile(slope, (25, 50, 60, 75))
    return [q50, q60, slope.std(), slope.mean(), slope.max(), slope.min(), np.abs(slope).mean(), q25, q75]


def _lag1(x: np.ndarray) -> float:
    c = x - x.mean()
    whole = float(c @ c)
    return float(c[:-1] @ c[1:]) / whole if len(x) > 1 and whole > FLAT else 0.0


def multiscale(x: np.ndarray) -> list[float]:
    """Spread and roughness of the block means at each scale; a series shorter than a block stays as it is."""
    out = []
    for s in SCALES:
        m = len(x) // s
        y = x[: m * s].reshape(m, s).mean(axis=1) if m else x
        q25, q75 = np.percentile(y, (25, 75))
        rough = np.abs(np.diff(y)).mean() if len(y) > 1 else 0.0
        out += [y.std(), q75 - q25, rough, _lag1(y), np.count_nonzero(y[:-1] * y[1:] < 0) / max(1, len(y) - 1)]
    return out


def drop(x: np.ndarray, window: int = 30) -> list[float]:
    """The steepest fall: its place, the median before and the minimum after it within the window, depth, how long
    the samples stay below a quarter of the depth under that median, and the area there, also as a share of all."""
    if len(x) < 2:
        return [-1, float(np.median(x)), float(x.min()), 0.0, 0, 0.0, 0.0]
    at = int(np.argmin(np.diff(x)))
    before = float(np.median(x[max(0, at - window + 1) : at + 1]))
    after = float(x[at + 1 : at + 1 + window].min())
    back = np.flatnonzero(x[at + 1 :] > before - 0.25 * (before - after))
    stay = int(back[0]) if len(back) else len(x) - at - 1
    area = float((before - x[at + 1 : at + 1 + stay]).sum())
    return [at, before, after, before - after, stay, area, area / (float(np.abs(x).sum()) + 1e-12)]


def zero_lag(x: np.ndarray) -> list[float]:
    """The first lag at which the autocorrelation isn't above 0; the last lag if there is none, 0 without spread."""
    c = x - x.mean()
    if len(x) < 2 or c @ c == 0:
        return [0]
    size = 1 << (2 * len(x) - 1).bit_length()
    f = np.fft.rfft(c, size)
    acf = np.fft.irfft(f * np.conj(f), size)[: len(x)] / float(c @ c)
    below = np.flatnonzero(acf <= 1e-12)
    return [int(below[0]) if len(below) else len(x) - 1]


def spectral(x: np.ndarray) -> list[float]:
    """Power, centre, width and entropy of the spectrum of the levelled samples, and its strongest frequency.

    Flat series have 0 throughout. Magnitudes are compared to nine decimals.
    """
    y = x - x.mean()
    if (y * y).sum() <= FLAT:
        return [0.0] * 5
    size, freq = np.abs(np.fft.rfft(y)), np.fft.rfftfreq(len(y))
    total = size.sum()
    centre = (freq * size).sum() / total
    part = size / total + 1e-12
    part /= part.sum()
    return [(size**2).sum(), centre, np.sqrt((((freq - centre) ** 2) * size).sum() / total), -(part * np.log(part)).sum(), freq[np.argmax(np.round(size, 9))]]


def falls_then_rises(means: np.ndarray, tol: float = 1e-8) -> bool:
    """Whether levels go one way, or down to one inner lowest level and up again; the last level may be left out for that."""
    if not len(means):
        return False
    d = np.diff(means)
    if len(d) and ((d >= -tol).all() or (d <= tol).all()):
        return True

    def valley(m: np.ndarray) -> bool:
        k = int(np.argmin(m))
        return 0 < k < len(m) - 1 and not (np.diff(m[: k + 1]) > tol).any() and not (np.diff(m[k:]) < -tol).any()

    return (len(means) > 2 and valley(means)) or (len(means) > 3 and valley(means[:-1]))


def steps(x: np.ndarray) -> list[float]:
    cut = split_segments(x)
    a = np.array([s for s, _ in cut])
    n = np.diff(np.r_[a, len(x)])
    mean = np.array([x[s:e].mean() for s, e in cut])
    std = np.array([x[s:e].std() for s, e in cut])
    q25, q75 = np.percentile(mean, (25, 75))
    h = np.diff(mean) if len(mean) > 1 else np.zeros(1)
    far = np.diff(a) if len(a) > 1 else np.zeros(1)
    high = np.count_nonzero(std > max(2 * x.std(), 1e-12))
    whole = falls_then_rises(mean)
    return [
        len(cut), n.min(), n.max(), n.mean(), np.median(n), n.std(), (n < 10).mean(),
        mean.mean(), mean.std(), mean.min(), mean.max(), q25, q75, q75 - q25, np.median(np.abs(mean - np.median(mean))),
        h.mean(), np.abs(h).mean(), h.max(), h.min(), np.median(np.abs(h)),
        std.mean(), *np.percentile(std, (25, 75)), high, high / len(cut), far.mean() / len(x), np.median(far) / len(x),
        whole, not whole and len(mean) > 1 and falls_then_rises(mean[:-1]),
    ]


def block(x: Column, fn, names: tuple[str, ...]) -> Column:
    """fn's numbers as ARRAY<DOUBLE> in the order of names; null for an empty series, null for NaN."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            rows = [[None if v != v else float(v) for v in fn(v)] if len(v) else None for v in _arrays(lists)]
            yield pa.array(rows, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(x)
