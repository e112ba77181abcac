"""Expressions on ARRAY<DOUBLE> columns of finite samples; all but prefix_sums stay in the JVM, none needs a shuffle.

Empty arrays give null for statistics and empty arrays for series, unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once; an expression used inside a lambda is else computed per element."""
    return F.transform(F.array(value), body)[0]


def a_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def a_mean(x: Column) -> Column:
    return F.try_divide(a_sum(x), F.size(x))


def a_sumsq(x: Column, about: Column) -> Column:
    """Sum of squared differences from a value."""
    return F.aggregate(F.transform(x, lambda v: (v - about) * (v - about)), F.lit(0.0), lambda a, v: a + v)


def a_std(x: Column, mean: Column) -> Column:
    """Population standard deviation about a mean that is known already."""
    return F.sqrt(F.try_divide(a_sumsq(x, mean), F.size(x)))


def q_lerp(s: Column, q: float) -> Column:
    """Interpolated quantile of a sorted array."""
    at = F.lit(q) * (F.size(s) - 1)
    low, part = F.floor(at).cast("int"), at - F.floor(at)
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return F.when(F.size(s) > 0, a + (b - a) * part)


def q_floor(s: Column, q: float) -> Column:
    """The value at floor(q * (n - 1)) of a sorted array."""
    return F.when(F.size(s) > 0, F.get(s, F.floor(F.lit(q) * (F.size(s) - 1)).cast("int")))


def a_median(x: Column) -> Column:
    return q_lerp(F.array_sort(x), 0.5)


def a_mad(x: Column, median: Column) -> Column:
    """Median absolute deviation from a median that is known already; not scaled."""
    return a_median(let(median, lambda m: F.transform(x, lambda v: F.abs(v - m))))


def levelled(x: Column) -> Column:
    """x minus its median."""
    return let(a_median(x), lambda m: F.transform(x, lambda v: v - m))


def a_diff(x: Column) -> Column:
    """Differences of neighbours, one fewer than samples."""
    n = F.size(x)
    return F.when(n > 1, F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)).otherwise(
        F.array().cast("array<double>")
    )


def moving_mean(x: Column, size: int) -> Column:
    """Mean of x[i - size // 2] .. x[i - size // 2 + size - 1], the ends repeated beyond the edges."""
    n = F.size(x)

    def at(i: Column, k: int) -> Column:
        return F.get(x, F.least(F.greatest(i + F.lit(k - size // 2), F.lit(0)), n - 1))

    return F.transform(x, lambda v, i: sum((at(i, k) for k in range(1, size)), at(i, 0)) / F.lit(float(size)))


def moving_mean_valid(x: Column, size: int) -> Column:
    """Means of all full windows; empty if there is none."""
    n = F.size(x) - F.lit(size - 1)
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: a_sum(F.slice(x, i + 1, size)) / F.lit(float(size)))
    ).otherwise(F.array().cast("array<double>"))


def edge_trim(x: Column, fraction: float) -> Column:
    """Drop max(1, round(fraction * n)) samples at either end, nothing if that would leave none."""
    n = F.size(x)
    t = F.greatest(F.lit(1), F.rint(F.lit(fraction) * n).cast("int"))
    return F.when(t * 2 >= n, x).otherwise(F.slice(x, t + 1, F.greatest(n - t * 2, F.lit(0))))


def scale_mad(x: Column, median: Column, mad: Column) -> Column:
    """(x - median) / mad; a mad that is missing or not above 0 counts as 1."""
    scale = F.struct(median.alias("m"), F.when(mad > 0, mad).otherwise(F.lit(1.0)).alias("d"))
    return let(scale, lambda p: F.transform(x, lambda v: (v - p["m"]) / p["d"]))


def scale_before(x: Column, median: Column, mad: Column, floor: Column, k: float = 6.0) -> Column:
    """To 0..1 over median plus and minus k mad, clipped; mad is at least floor."""
    scale = F.struct(median.alias("m"), F.greatest(mad, floor).alias("d"))
    return let(scale, lambda p: F.transform(x, lambda v: F.least(F.greatest((v - (p["m"] - p["d"] * k)) / (p["d"] * (2 * k)), F.lit(0.0)), F.lit(1.0))))


def scale_range(x: Column, low: Column, high: Column) -> Column:
    """To 0..1 over low..high, clipped; 0 where the range is empty."""
    ends = F.struct(low.alias("a"), high.alias("b"))
    part = lambda v, p: F.least(F.greatest((v - p["a"]) / (p["b"] - p["a"]), F.lit(0.0)), F.lit(1.0))
    return let(ends, lambda p: F.transform(x, lambda v: F.when(p["b"] > p["a"], part(v, p)).otherwise(F.lit(0.0))))


def resample_lerp(x: Column, n: int) -> Column:
    """n samples at even distances from the first to the last, interpolated; one sample is repeated."""
    step = (F.size(x) - 1) / F.lit(float(n - 1))

    def at(i: Column) -> Column:
        p = i * step
        low = F.least(F.floor(p).cast("int"), F.size(x) - 1)
        a = F.get(x, low)
        return a + (F.get(x, F.least(low + 1, F.size(x) - 1)) - a) * (p - low)

    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)).otherwise(F.array().cast("array<double>"))


def block_means(x: Column, size: int) -> Column:
    """Means of full blocks; the remainder is dropped."""
    n = F.floor(F.size(x) / size).cast("int")
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: a_sum(F.slice(x, i * size + 1, size)) / F.lit(float(size)))
    ).otherwise(F.array().cast("array<double>"))


def pad_or_cut(x: Column, n: int, pad: float = 0.0) -> Column:
    """Exactly n samples: cut at the end, or padded there."""
    return F.concat(F.slice(x, 1, n), F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(x), F.lit(0))))


def trim_pad(x: Column, pad: float = 0.0) -> Column:
    """Without the padding at either end."""
    kept = F.filter(F.transform(x, lambda v, i: F.when(v != pad, i)), lambda i: i.isNotNull())
    return F.when(F.size(kept) > 0, F.slice(x, F.array_min(kept) + 1, F.array_max(kept) - F.array_min(kept) + 1)).otherwise(F.array().cast("array<double>"))


def prefix_sums(x: Column) -> Column:
    """Running sums, one array of the same length, in one pass over the samples."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            flat = np.asarray(lists.flatten(), dtype=float)
            sizes = lists.value_lengths().fill_null(0).to_pylist()
            ends = np.cumsum([0, *sizes])
            sums = [np.cumsum(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sums) if sums else flat))

    return F.arrow_udf(run, "array<double>")(x)


def without(x: Column, value: float = 0.0) -> Column:
    """x without all samples of a value."""
    return F.filter(x, lambda v: v != value)


def trim_trailing(x: Column, pad: float = 0.0) -> Column:
    """x without the padding at its end."""
    last = F.array_max(F.transform(x, lambda v, i: F.when(v != pad, i + 1)))
    return F.slice(x, 1, F.coalesce(last, F.lit(0)))


def fill_gaps(mask: Column, longest: int) -> Column:
    """A boolean array with runs of false of at most `longest` made true, those at either end too."""
    gaps = F.filter(islands(F.transform(mask, lambda m: ~m)), lambda g: g["e"] - g["s"] <= longest)
    return let(gaps, lambda gs: F.transform(mask, lambda m, i: m | F.exists(gs, lambda g: (g["s"] <= i) & (i < g["e"]))))


def extend(start: Column, end: Column, by: int, size: Column) -> tuple[Column, Column]:
    """A region made longer at both ends, within 0 and size."""
    return F.greatest(start - by, F.lit(0)), F.least(end + by, size)


def islands(mask: Column) -> Column:
    """Runs of true in a boolean array as structs (s, e), e exclusive."""
    starts = F.filter(
        F.transform(mask, lambda m, i: F.when(m & ~F.coalesce(F.get(mask, i - 1), F.lit(False)), i)), lambda i: i.isNotNull()
    )
    ends = F.filter(
        F.transform(mask, lambda m, i: F.when(m & ~F.coalesce(F.get(mask, i + 1), F.lit(False)), i + 1)), lambda i: i.isNotNull()
    )
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def lag_products(x: Column, mean: Column, lag: int = 1) -> Column:
    """Sum of (x[i] - mean) * (x[i + lag] - mean)."""
    n = F.greatest(F.size(x) - lag, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(x, lag + 1, n), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda s, v: s + v)


def sign_changes(x: Column, level: Column) -> Column:
    """How often neighbours lie on different sides of a level; on it counts as below."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    crossed = F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: (a > level) != (b > level))
    return F.size(F.filter(crossed, lambda c: c))
