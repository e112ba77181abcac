"""From reads to series of one length for training: trimming, step filter, smoothing, normalisation, length.

All steps work on (read_id, class, x, ...) with x an array of finite samples; only statistics of the
training reads and the target length look at more than one read, each as one row that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import feature_kernels as K
from ..functions import kernels as S
from .ranks import group_quantiles

EPS = 1e-12
#: Widths of the median's surroundings that min-max-before-plr scales to 0..1, in mads, and its least mad as a share of the global one.
REACH, FLOOR = 6.0, 1e-4

# The names of the methods.
METHODS = ("None", "MAD-local", "MAD-global", "MAD-before-plr", "min-max-before-plr", "median-before-plr", "minmax-global", "minmax-decile-median")
MODES = ("truncate_or_pad", "pad_only", "trim_only", "strict", "resample", "resample_if_longer", "resample_center")
TARGETS = ("percentile", "median", "mean", "max", "fixed")
CALIBRATION = ("global_median", "global_mad", "global_median_excl_plr", "global_mad_excl_plr")


def finite(value: Column) -> Column:
    """A number, or null where it is missing, NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def train_stats(reads: DataFrame) -> DataFrame:
    """One row of statistics of the training reads: medians of the calibration columns, p_lo and p_hi, the 0.1st and
    99.9th percentile of all samples, the number of samples, and the median length.

    A median that isn't there is 0, a mad that isn't above 0 is 1; those without the region fall back on
    the whole read's. Reads without samples don't count for percentiles and length.
    """
    out = reads.agg(F.count("*").alias("n_reads"), F.sum(F.size("x")).alias("n_samples"))
    for c in CALIBRATION:
        out = out.crossJoin(F.broadcast(group_quantiles(reads.select(finite(F.col(c)).alias(c)), [], c, {c: 0.5})))
    values = group_quantiles(reads.select(F.explode("x").alias("v")), [], "v", {"p_lo": 0.001, "p_hi": 0.999})
    length = group_quantiles(reads.where("size(x) > 0").select(F.size("x").alias("n")), [], "n", {"median_length": 0.5})
    out = out.crossJoin(F.broadcast(values)).crossJoin(F.broadcast(length))
    median, mad = F.coalesce("global_median", F.lit(0.0)), F.when(F.col("global_mad") > 0, F.col("global_mad")).otherwise(1.0)
    return out.select(
        "n_reads", F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
        median.alias("global_median"), mad.alias("global_mad"),
        F.coalesce("global_median_excl_plr", median).alias("global_median_excl_plr"),
        F.when(F.col("global_mad_excl_plr") > 0, F.col("global_mad_excl_plr")).otherwise(mad).alias("global_mad_excl_plr"),
        F.coalesce("p_lo", F.lit(-1.0)).alias("p_lo"), F.coalesce("p_hi", F.lit(1.0)).alias("p_hi"),
        F.coalesce("median_length", F.lit(0.0)).cast("int").alias("median_length"),
    )


def _shifted(x: Column, offset: Column, scale: Column) -> Column:
    p = F.struct(offset.alias("o"), scale.alias("s"))
    return A.let(p, lambda p: F.transform(x, lambda v: (v - p["o"]) / p["s"]))


def _within(x: Column, low: Column, high: Column) -> Column:
    """To 0..1 over low..high, clipped there."""
    p = F.struct(low.alias("l"), high.alias("h"))
    return A.let(p, lambda p: F.transform(x, lambda v: (F.least(F.greatest(v, p["l"]), p["h"]) - p["l"]) / (p["h"] - p["l"] + EPS)))


def _part_extremes(x: Column, parts: int, top: bool) -> Column:
    """The least or greatest samples of up to `parts` parts of nearly equal size, the longer ones first."""
    n = F.size(x)
    k = F.least(F.lit(parts), n)
    size, longer = F.floor(n / k).cast("int"), (n % k).cast("int")
    ends = F.array_max if top else F.array_min

    def one(j: Column) -> Column:
        return ends(F.slice(x, j * size + F.least(j, longer) + 1, size + F.when(j < longer, 1).otherwise(0)))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), one))


def normalise(reads: DataFrame, method: str, stats: DataFrame | None = None) -> DataFrame:
    """reads with x normalised; an unknown method is MAD-local.

    The global methods, and those before the region where a read lacks its own numbers, need stats, the
    row of train_stats. Without it the latter take the read's own median and mad. Empty series stay empty.
    """
    x = F.col("x")
    out = reads
    if stats is not None:
        out = out.crossJoin(F.broadcast(stats.select([F.col(c).alias(f"_{c}") for c in stats.columns])))
    elif method in ("MAD-global", "minmax-global"):
        raise ValueError(f"{method} needs the statistics of the training reads")
    if method == "None":
        return reads
    if method == "MAD-global":
        new = _shifted(x, F.col("_global_median"), F.when(F.col("_global_mad") > 0, F.col("_global_mad")).otherwise(1.0))
    elif method == "minmax-global":
        new = _within(x, F.col("_p_lo"), F.col("_p_hi"))
    elif method == "minmax-decile-median":
        out = out.withColumn("_low", A.a_median(_part_extremes(x, 10, False))).withColumn("_high", A.a_median(_part_extremes(x, 10, True)))
        high = F.when(F.col("_high") - F.col("_low") < EPS, F.col("_low") + F.greatest(F.lit(1.0), F.abs("_low") * 1e-3)).otherwise(F.col("_high"))
        new = _within(x, F.col("_low"), high)
    else:
        out = out.withColumn("_med", A.a_median(x)).withColumn("_mad", A.a_mad(x, F.col("_med")))
        med, mad = F.col("_med"), F.col("_mad")
        if method in ("MAD-before-plr", "min-max-before-plr", "median-before-plr"):
            own_med, own_mad = finite(F.col("median_before_plr")), finite(F.col("mad_before_plr"))
            other_med, other_mad = (F.col("_global_median_excl_plr"), F.col("_global_mad_excl_plr")) if stats is not None else (med, mad)
            both = own_med.isNotNull() & own_mad.isNotNull()
            if method == "median-before-plr":
                med = F.coalesce(own_med, other_med)
            else:
                med, mad = F.when(both, own_med).otherwise(other_med), F.when(both, own_mad).otherwise(other_mad)
        if method == "median-before-plr":
            new = _shifted(x, med, F.lit(1.0))
        elif method == "min-max-before-plr":
            floor = F.col("_global_mad") * FLOOR if stats is not None else F.lit(1e-6)
            wide = F.greatest(mad, floor)
            new = _within(x, med - wide * REACH, med + wide * REACH)
        else:
            new = _shifted(x, med, F.when(mad > 0, mad).otherwise(1.0))
    empty = F.array().cast("array<double>")
    return out.withColumn("x", F.when(F.size(x) > 0, new).otherwise(empty)).select(reads.columns)


def step_verdicts(reads: DataFrame, least_gain: float = 18.0, least_len: int = 10, noise: float | None = None) -> DataFrame:
    """reads with step_reason: kept, short_segment, high_std_in_segment or non_monotonic.

    A read is kept if its steps go one way, or down and up again, none is shorter than least_len and,
    with noise, none has a greater std. A read without samples is short.
    """
    cut = reads.withColumn("_g", S.segments(F.col("x"), least_gain, least_len))
    means = cut.withColumn("_ok", K.block(F.transform("_g", lambda g: g["mean"]), lambda m: [float(K.falls_then_rises(m))], ("ok",)))
    short = (F.size("_g") == 0) | F.exists("_g", lambda g: g["len"] < least_len)
    reason = F.when(short, "short_segment")
    if noise is not None:
        reason = reason.when(F.exists("_g", lambda g: g["std"] > noise), "high_std_in_segment")
    return means.withColumn("step_reason", reason.when(F.col("_ok")[0] > 0, "kept").otherwise("non_monotonic")).drop("_g", "_ok")


def step_summary(verdicts: DataFrame) -> DataFrame:
    """Reads of each class by step_reason, with their share of the class."""
    counts = verdicts.groupBy("class", "step_reason").agg(F.count("*").alias("n"))
    total = counts.groupBy("class").agg(F.sum("n").alias("total")).withColumnRenamed("class", "c")
    return counts.join(total, F.col("class").eqNullSafe(F.col("c"))).select("class", "step_reason", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def target_length(reads: DataFrame, method: str = "percentile", percentile: float = 90, fixed: int | None = None) -> DataFrame:
    """The length all series shall get, as one row (target): a percentile, the median, mean or maximum, or a fixed one."""
    if method not in TARGETS or (method == "fixed" and not fixed):
        raise ValueError(f"unknown target: {method}")
    n = reads.select(F.size("x").alias("n"))
    if method == "fixed":
        return reads.sparkSession.range(1).select(F.lit(fixed).alias("target"))
    if method in ("mean", "max"):
        return n.agg((F.avg("n") if method == "mean" else F.max("n")).cast("int").alias("target"))
    return group_quantiles(n, [], "n", {"q": 0.5 if method == "median" else percentile / 100}).select(F.col("q").cast("int").alias("target"))


def fit_length(reads: DataFrame, target: int, mode: str = "truncate_or_pad", pad: float = 0.0) -> DataFrame:
    """reads with x of exactly target samples, and kept_length, what it had; reads the mode can't fit leave.

    truncate_or_pad cuts and pads at the end, pad_only drops longer and trim_only shorter series, strict
    both; resample and resample_center bring all to the length, resample_if_longer longer ones and pads.
    """
    if mode not in MODES or target <= 0:
        raise ValueError(f"unknown mode {mode} or length {target}")
    x, n = F.col("x"), F.size("x")
    out = reads.withColumn("kept_length", n)
    if mode == "resample":
        return out.where(n > 0).withColumn("x", S.resample_polyphase(x, target))
    if mode == "resample_center":
        return out.where(n > 0).withColumn("x", S.resample_center(x, target))
    if mode == "resample_if_longer":
        long = S.resample_polyphase(F.when(n > target, x).otherwise(F.array().cast("array<double>")), target)
        return out.withColumn("x", F.when(n > target, long).otherwise(A.pad_or_cut(x, target, pad)))
    fits = {"truncate_or_pad": F.lit(True), "pad_only": n <= target, "trim_only": n >= target, "strict": n == target}[mode]
    return out.where(fits).withColumn("x", A.pad_or_cut(x, target, pad))


def prepare(
    reads: DataFrame,
    stats: DataFrame | None = None,
    method: str = "MAD-local",
    trim: float | None = 0.05,
    step_filter: dict | None = None,
    smooth: tuple[float, str] | None = None,
    length: str = "percentile",
    percentile: float = 90,
    fixed: int | None = None,
    mode: str = "truncate_or_pad",
) -> DataFrame:
    """The whole chain: trim the ends, leave out reads by their steps, smooth, normalise, bring to one length.

    The target length is one number, taken from the reads after the step filter; an empty table stays empty.
    """
    out = reads
    if trim is not None:
        out = out.withColumn("x", A.edge_trim(F.col("x"), trim))
    if step_filter is not None:
        out = step_verdicts(out, **step_filter).where("step_reason = 'kept'").drop("step_reason")
    if smooth is not None:
        out = out.withColumn("x", S.low_pass(F.col("x"), *smooth))
    out = normalise(out, method, stats)
    row = target_length(out, length, percentile, fixed).first()
    if row is None or not row["target"]:
        return out.withColumn("kept_length", F.size("x")).limit(0)
    return fit_length(out, row["target"], mode)
