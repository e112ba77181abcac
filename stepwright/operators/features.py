"""Features of signals in blocks: lists of named expressions over columns that are computed once (see staged).

A frame of several blocks is one pass over the reads, without a shuffle. Quantiles named q10 and so on are
order statistics, the value at floor(q * (n - 1)); medians are interpolated. Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import feature_kernels as K
from ..functions.kernels import halve as halved

DECILES = (0.1, 0.25, 0.4, 0.6, 0.75, 0.9)
TINY = 1e-12


def staged(reads: DataFrame) -> DataFrame:
    """reads with what the blocks share: n, mean, sorted s, std, median, differences d and dd, sorted ds and dds, their means."""
    return (
        reads.withColumn("n", F.size("x"))
        .where("n > 0")
        .withColumns({"mean": A.a_mean(F.col("x")), "s": F.array_sort("x"), "d": A.a_diff(F.col("x"))})
        .withColumns({"std": A.a_std(F.col("x"), F.col("mean")), "med": A.q_lerp(F.col("s"), 0.5), "ds": F.array_sort("d"), "d_mean": A.a_mean(F.col("d")), "dd": A.a_diff(F.col("d"))})
        .withColumns({"dds": F.array_sort("dd"), "dd_mean": A.a_mean(F.col("dd"))})
    )


def _fold(x: Column, body) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + body(v))


def _q(s: str, p: float) -> Column:
    return A.q_floor(F.col(s), p)


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]


def basic(st: DataFrame) -> DataFrame:
    """Location, spread and shape of all samples."""
    one = {"q10": _q("s", 0.1), "q25": _q("s", 0.25), "q40": _q("s", 0.4), "q60": _q("s", 0.6), "q75": _q("s", 0.75), "q90": _q("s", 0.9)}
    mad = _fold(F.col("x"), lambda v: F.abs(v - F.col("mean"))) / F.col("n")
    st = st.withColumns({**one, "MAD": mad, "min": F.array_min("x"), "max": F.array_max("x")})
    q = {k: F.col(k) for k in one}
    low, high = F.floor(F.col("n") * F.lit(0.1)).cast("int"), F.ceil(F.col("n") * F.lit(0.9)).cast("int")
    st = st.withColumn("t", F.slice("s", low + 1, high - low)).withColumn("t_med", A.q_lerp(F.col("t"), 0.5))
    inner = F.filter("x", lambda v: (v >= F.col("q25")) & (v <= F.col("q75")))
    moment = lambda k: _fold(F.col("x"), lambda v: F.pow(v - F.col("mean"), F.lit(k))) / F.col("n")
    some = F.col("std") > TINY
    return st.select("*", *_named({
        "length": F.col("n"),
        "median": F.col("med"),
        "iqr": q["q75"] - q["q25"],
        "range": F.col("max") - F.col("min"),
        "idl": q["q90"] - q["q10"],
        "idl_60_40": q["q60"] - q["q40"],
        "midhinge": (q["q25"] + q["q75"]) / 2,
        "trimean": (q["q25"] + 2 * F.col("med") + q["q75"]) / 4,
        "interquartile_mean": A.let(inner, A.a_mean),
        "normalized_MAD": F.col("MAD") / (F.abs("med") + TINY),
        "MAD_over_IQR": F.col("MAD") / (q["q75"] - q["q25"] + TINY),
        "trimmed_MAD": F.when(F.col("n") > 10, A.a_mad(F.col("t"), F.col("t_med"))).otherwise(F.col("MAD")),
        "coef_var": F.col("std") / (F.abs("mean") + TINY),
        "std_all": F.col("std"),
        "skew_all": F.when(some, moment(3) / F.pow("std", F.lit(3))),
        "kurtosis_all": F.when(some, moment(4) / F.pow("std", F.lit(4)) - 3),
    }))


BASIC = ("length", "min", "max", "mean", "median", "q10", "q25", "q40", "q60", "q75", "q90", "iqr", "range", "idl", "idl_60_40", "midhinge", "trimean", "interquartile_mean", "MAD", "normalized_MAD", "MAD_over_IQR", "trimmed_MAD", "coef_var", "std_all", "skew_all", "kurtosis_all")


def low(st: DataFrame) -> DataFrame:
    """Shape of the samples at or below 0: spread, biased skew and excess kurtosis, and their number."""
    st = st.withColumn("lo", F.filter("x", lambda v: v <= 0)).withColumn("lo_mean", A.a_mean(F.col("lo")))
    st = st.withColumn("lo_std", A.a_std(F.col("lo"), F.col("lo_mean")))
    moment = lambda k: F.try_divide(_fold(F.col("lo"), lambda v: F.pow(v - F.col("lo_mean"), F.lit(k))), F.size("lo"))
    some = F.col("lo_std") > TINY
    return st.select("*", F.col("lo_std").alias("low_std"), F.when(some, moment(3) / F.pow("lo_std", F.lit(3))).alias("low_skew"), F.when(some, moment(4) / F.pow("lo_std", F.lit(4)) - 3).alias("low_kurtosis"), F.size("lo").alias("length_th"))


LOW = ("low_std", "low_skew", "low_kurtosis", "length_th")


def _differences(st: DataFrame, d: str, name: str, total: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s, mean = f"{d}s", F.col(f"{d}_mean")
    size = _fold(F.col(d), lambda v: F.abs(v))
    return st.select("*", *[zero(c).alias(k) for k, c in {
        f"mean_{name}": mean,
        f"median_{name}": A.q_lerp(F.col(s), 0.5),
        f"std_{name}": A.a_std(F.col(d), mean),
        f"max_{name}": F.array_max(d),
        f"min_{name}": F.array_min(d),
        f"avg_abs_{name}": F.try_divide(size, F.size(d)),
        **{f"{name}_q{round(p * 100)}": _q(s, p) for p in DECILES},
        total: size,
    }.items()])


def slopes(st: DataFrame) -> DataFrame:
    """The differences of neighbours; zeros without any."""
    return _differences(st, "d", "slope", "total_variation")


def second_slopes(st: DataFrame) -> DataFrame:
    """The differences of the differences; zeros without any."""
    return _differences(st, "dd", "second_slope", "second_total_variation")


def _difference_names(name: str, total: str) -> tuple[str, ...]:
    return (*(f"{k}_{name}" for k in ("mean", "median", "std", "max", "min", "avg_abs")), *(f"{name}_q{round(p * 100)}" for p in DECILES), total)


SLOPES = _difference_names("slope", "total_variation")
SECOND = _difference_names("second_slope", "second_total_variation")


def energy_trend(st: DataFrame) -> DataFrame:
    """Energy, rms, areas, and the least squares line over the sample index with the spread about it."""
    n = F.col("n").cast("double")
    st = st.withColumns({"energy": _fold(F.col("x"), lambda v: v * v), "auc": A.a_sum(F.col("x")), "abs_auc": _fold(F.col("x"), F.abs), "ix": A.a_sum(F.transform("x", lambda v, i: v * i))})
    var_i = (n * n - 1) / 12  # of 0 .. n - 1
    st = st.withColumn("trend_slope", F.when(n > 1, F.try_divide(F.col("ix") / n - F.col("mean") * (n - 1) / 2, var_i)))
    slope = F.col("trend_slope")
    return st.select(
        "*",
        F.sqrt(F.col("energy") / n).alias("rms"),
        (F.col("mean") - slope * (n - 1) / 2).alias("trend_intercept"),
        F.sqrt(F.greatest(F.col("std") * F.col("std") - slope * slope * var_i, F.lit(0.0))).alias("detrended_std"),
    )


TREND = ("energy", "rms", "auc", "abs_auc", "trend_slope", "trend_intercept", "detrended_std")


def rhythm(st: DataFrame) -> DataFrame:
    """Sign changes, lag 1 correlation, Hjorth's activity, mobility and complexity, and crossings of quantiles."""
    x = F.col("x")
    last = F.greatest(F.col("n") - 1, F.lit(1))
    st = st.withColumns({
        "var": F.col("std") * F.col("std"),
        "var_d": F.coalesce(F.try_divide(A.a_sumsq(F.col("d"), F.col("d_mean")), F.size("d")), F.lit(0.0)),
        "var_dd": F.coalesce(F.try_divide(A.a_sumsq(F.col("dd"), F.col("dd_mean")), F.size("dd")), F.lit(0.0)),
        **{f"c{round(p * 100)}": A.q_lerp(F.col("s"), p) for p in CROSSED},
    })
    turns = F.zip_with(F.slice(x, 1, F.col("n") - 1), F.slice(x, 2, F.greatest(F.col("n") - 1, F.lit(0))), lambda a, b: a * b < 0)
    st = st.withColumn("hjorth_mobility", F.sqrt(F.col("var_d") / (F.col("var") + TINY)))
    return st.select(
        "*",
        (F.size(F.filter(turns, lambda t: t)) / last).alias("zcr"),
        F.when(F.col("var") > TINY, A.lag_products(x, F.col("mean")) / (F.col("var") * F.col("n"))).otherwise(F.lit(0.0)).alias("ac_lag1"),
        F.col("var").alias("hjorth_activity"),
        (F.sqrt(F.col("var_dd") / (F.col("var_d") + TINY)) / (F.col("hjorth_mobility") + TINY)).alias("hjorth_complexity"),
        *[(A.sign_changes(x, F.col(f"c{round(p * 100)}")) / last).alias(f"cross_rate_q{round(p * 100)}") for p in CROSSED],
    )


CROSSED = (0.1, 0.25, 0.5, 0.75, 0.9)
RHYTHM = ("zcr", "ac_lag1", "hjorth_activity", "hjorth_mobility", "hjorth_complexity", *(f"cross_rate_q{round(p * 100)}" for p in CROSSED))


def _scanned(fn, names: tuple[str, ...]):
    def add(st: DataFrame) -> DataFrame:
        got = st.withColumn("_block", K.block(F.col("x"), fn, names))
        return got.select(*st.columns, *[F.col("_block")[i].alias(k) for i, k in enumerate(names)])

    add.__doc__ = fn.__doc__
    return add


#: Every block with the names it adds; ROLLED takes windows of 100 samples.
BLOCKS = {
    "basic": (basic, BASIC),
    "low": (low, LOW),
    "slopes": (slopes, SLOPES),
    "second_slopes": (second_slopes, SECOND),
    "rolling_slopes": (_scanned(K.rolling, K.ROLLING), K.ROLLING),
    "peaks": (_scanned(K.peaks, K.PEAKS), K.PEAKS),
    "energy_trend": (energy_trend, TREND),
    "rhythm": (rhythm, RHYTHM),
    "zero_lag": (_scanned(K.zero_lag, K.LAG), K.LAG),
    "multiscale": (_scanned(K.multiscale, K.MULTISCALE), K.MULTISCALE),
    "drop": (_scanned(K.drop, K.DROP), K.DROP),
    "steps": (_scanned(K.steps, K.STEPS), K.STEPS),
}


def rolling_slopes(size: int):
    """The block of rolling slopes over windows of another size."""
    return _scanned(lambda x: K.rolling(x, size), K.ROLLING), K.ROLLING


def spectral(halve: bool = True):
    """The block of the spectrum, of every second sample of series from 32 on, or of all samples."""

    def add(st: DataFrame) -> DataFrame:
        got = st.withColumn("_block", K.block(halved(F.col("x")) if halve else F.col("x"), K.spectral, K.SPECTRAL))
        return got.select(*st.columns, *[F.col("_block")[i].alias(k) for i, k in enumerate(K.SPECTRAL)])

    return add, K.SPECTRAL


def frame(reads: DataFrame, blocks: list | None = None, id_col: str = "read_id") -> DataFrame:
    """One row of features per read with samples: the blocks named (all if none are), or given as (function, names).

    Rows of reads without samples are left out. reads has id_col and x, an array of finite samples;
    other columns aren't kept.
    """
    st = staged(reads.select(id_col, "x"))
    names: list[str] = []
    for b in blocks or list(BLOCKS):
        fn, added = BLOCKS[b] if isinstance(b, str) else b
        st = fn(st)
        names += [n for n in added if n not in names]
    return st.select(id_col, *names)
