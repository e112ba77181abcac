"""Regions of low current in a read: the drop from a local baseline, its candidates, and the verdict on each read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import _arrays
from ..runtime import ship

CANDIDATES = "array<struct<s:int,e:int,len:int,q25:double,drop:double,score:double>>"

# The reasons a read can have, in the order in which they are tested.
REASONS = ("signal-missing", "signal-long", "no-drop", "drop-small", "region-short", "region-late", "valid")


def _mean_window(x: np.ndarray, size: int) -> np.ndarray:
    """Centred means, the ends repeated beyond the edges."""
    ext = np.r_[np.full(size // 2, x[0]), x, np.full(size - 1 - size // 2, x[-1])]
    s = np.r_[0.0, np.cumsum(ext)]
    return (s[size:] - s[:-size]) / size


def find_drops(x: np.ndarray, least: float, fast: int, slow: int, close: int) -> list[dict]:
    """Stretches in which the smoothed drop below the baseline reaches `least`, small gaps closed, best first.

    The baseline is the median of the first quarter of the read. The score of a stretch is its mean drop
    times the square root of its length; ties go to the earlier one.
    """
    n = len(x)
    base = float(np.median(x[: max(1, n // 4)]))
    fall = np.maximum(base - x, 0.0)
    drop = _mean_window(np.maximum(_mean_window(fall, fast), _mean_window(fall, slow)), fast)
    on = np.flatnonzero(drop >= least)
    if not len(on):
        return []
    cut = np.flatnonzero(np.diff(on) > close + 1)
    starts, ends = on[np.r_[0, cut + 1]], on[np.r_[cut, len(on) - 1]] + 1
    found = [
        {"s": int(a), "e": int(b), "len": int(b - a), "q25": float(np.quantile(x[a:b], 0.25)), "drop": float(base - np.median(x[a:b])), "score": float(drop[a:b].mean() * np.sqrt(b - a))}
        for a, b in zip(starts, ends)
    ]
    return sorted(found, key=lambda c: (-c["score"], c["s"]))


def drop_candidates(x: Column, least: float, fast: int = 3, slow: int = 5, close: int = 2) -> Column:
    """The candidates of each signal as structs, best first; empty for an empty signal."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("len", pa.int32()), ("q25", pa.float64()), ("drop", pa.float64()), ("score", pa.float64())]))
        for lists in batches:
            yield pa.array([find_drops(v, least, fast, slow, close) if len(v) else [] for v in _arrays(lists)], kind)

    return F.arrow_udf(run, CANDIDATES)(x)


def verdicts(
    reads: DataFrame, least_drop: float = 10.0, threshold: float = 4.5, least_len: int = 4, longest: int = 15_000, last_part: float = 0.1
) -> DataFrame:
    """Each read's verdict and region: (read_id, class, reason, region_start, region_end, drop, n_candidates).

    Of the candidates the first that is deep and long enough and doesn't reach into the last part of the
    read is the region. A read without one gets the reason for which its best candidate failed, the
    first in the order of REASONS; positions and drop are those of the best candidate then.
    """
    ship(reads.sparkSession)
    n = F.size("x")
    found = reads.select("read_id", "class", n.alias("n"), drop_candidates(F.col("x"), threshold).alias("c"))

    def good(c: Column) -> Column:
        return (c["drop"] >= least_drop) & (c["len"] >= least_len) & (c["e"] < F.col("n") * (1 - last_part))

    chosen = found.withColumn("fit", F.get(F.filter("c", good), F.lit(0))).withColumn("best", F.get(F.col("c"), F.lit(0)))
    b = F.col("best")
    reason = (
        F.when(F.col("n") == 0, "signal-missing")
        .when(F.col("n") > longest, "signal-long")
        .when(b.isNull(), "no-drop")
        .when(F.col("fit").isNotNull(), "valid")
        .when(b["drop"] < least_drop, "drop-small")
        .when(b["len"] < least_len, "region-short")
        .otherwise("region-late")
    )
    at = F.coalesce("fit", "best")
    return chosen.select("read_id", "class", reason.alias("reason"), at["s"].alias("region_start"), at["e"].alias("region_end"), at["drop"].alias("drop"), F.size("c").alias("n_candidates"))


def verdict_summary(found: DataFrame) -> DataFrame:
    """Reads per reason in the order of REASONS, with 0 for those that don't occur, and their share of all."""
    order = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r).alias("reason")) for i, r in enumerate(REASONS)])).alias("r")
    names = found.sparkSession.range(1).select(order).select("r.*")
    counts = found.groupBy("reason").agg(F.count("*").alias("n"))
    total = found.agg(F.count("*").alias("total"))
    out = names.join(counts, "reason", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select("place", "reason", n.alias("n"), F.format_string("%.2f%%", F.coalesce(F.try_divide(n * 100.0, F.col("total")), F.lit(0.0))).alias("percentage"))


def region_stats(reads: DataFrame, found: DataFrame) -> DataFrame:
    """Median and median deviation of the whole read, without its region, and before it; null where nothing is left."""
    from ..functions import arrays as A

    valid = found.where("reason = 'valid'").select("read_id", "region_start", "region_end")
    rows = reads.select("read_id", "x").join(valid, "read_id")
    parts = {
        "whole": F.col("x"),
        "outside": F.concat(F.slice("x", F.lit(1), F.col("region_start")), F.slice("x", F.col("region_end") + 1, F.size("x") - F.col("region_end"))),
        "before": F.slice("x", F.lit(1), F.col("region_start")),
    }
    staged = rows.select("read_id", "region_start", "region_end", *[c.alias(k) for k, c in parts.items()])
    med = staged.select("*", *[A.a_median(F.col(k)).alias(f"{k}_median") for k in parts])
    return med.select("read_id", "region_start", "region_end", *[f"{k}_median" for k in parts], *[A.a_mad(F.col(k), F.col(f"{k}_median")).alias(f"{k}_mad") for k in parts])
