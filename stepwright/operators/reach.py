"""How far alignments reach: counts per run, reference and threshold, their bins, fractions and drop-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import run_key
from ..runtime import materialize
from .ranks import group_quantiles


def reports_once(rows: DataFrame) -> DataFrame:
    """Each report once, as first received: (row_id, run, reference, threshold, n); run in its normal form.

    Reports without run or reference are left out, a missing count is 0.
    """
    first = F.min(F.struct("received_at", "run", "reference", "threshold", "count")).alias("r")
    return (
        rows.groupBy("row_id")
        .agg(first)
        .select("row_id", run_key(F.col("r.run")).alias("run"), "r.reference", "r.threshold", F.coalesce("r.count", F.lit(0)).alias("n"))
        .where("run is not null and reference is not null")
    )


def reach_long(reports: DataFrame) -> DataFrame:
    """Reads that reach each threshold: (run, reference, threshold, n)."""
    return reports.groupBy("run", "reference", "threshold").agg(F.sum("n").alias("n"))


def reach_wide(reports: DataFrame, thresholds: list[int]) -> DataFrame:
    """One column ge_T per threshold, 0 where none was reported; reports are summed in the same pass."""
    sums = [F.sum(F.when(F.col("threshold") == t, F.col("n")).otherwise(0)).alias(f"ge_{t}") for t in thresholds]
    return reports.groupBy("run", "reference").agg(*sums)


def exclusive_bins(wide: DataFrame, thresholds: list[int]) -> DataFrame:
    """Reads that end between a threshold and the next: bin_T = ge_T - ge_next, the last bin open."""
    cols = [(F.col(f"ge_{a}") - F.col(f"ge_{b}")).alias(f"bin_{a}") for a, b in zip(thresholds, thresholds[1:])]
    return wide.select("run", "reference", *cols, F.col(f"ge_{thresholds[-1]}").alias(f"bin_{thresholds[-1]}"))


def reach_fractions(wide: DataFrame, thresholds: list[int]) -> DataFrame:
    """p_ge_T: the share of the reads at the first threshold that reach T; a total of 0 counts as 1."""
    total = F.when(F.col(f"ge_{thresholds[0]}") == 0, F.lit(1)).otherwise(F.col(f"ge_{thresholds[0]}"))
    return wide.select("run", "reference", *[(F.col(f"ge_{t}") / total).alias(f"p_ge_{t}") for t in thresholds])


def drop_off(fractions: DataFrame, thresholds: list[int], by: list[str]) -> DataFrame:
    """Median over runs of the fractions, in long form: (by..., threshold, median_fraction, n_runs)."""
    long = fractions.unpivot(["run", "reference"], [f"p_ge_{t}" for t in thresholds], "name", "p").withColumn(
        "threshold", F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    )
    keys = [*by, "threshold"]
    long = materialize(long, "fractions")
    n = long.groupBy(*keys).agg(F.count("*").alias("n_runs"))
    return group_quantiles(long, keys, "p", {"median_fraction": 0.5}).join(n, keys)


def directions(reports: DataFrame, threshold: int) -> DataFrame:
    """Per run the reads on forward and on reverse complement references (ending in _rc or _rev), and shares.

    Runs that occur in one direction only have 0 in the other; shares are null if both are 0.
    """
    reverse = F.col("reference").rlike("_(rc|rev)$")
    at = reports.where(F.col("threshold") == threshold)
    sums = at.groupBy("run").agg(
        F.sum(F.when(reverse, 0).otherwise(F.col("n"))).alias("n_forward"), F.sum(F.when(reverse, F.col("n")).otherwise(0)).alias("n_reverse")
    )
    return sums.withColumn("reverse_share", F.try_divide(F.col("n_reverse"), F.col("n_forward") + F.col("n_reverse")))


def max_normalised(long: DataFrame) -> DataFrame:
    """Counts as percent of the greatest of their run and reference; 0 where all are 0."""
    top = long.groupBy("run", "reference").agg(F.max("n").alias("top"))
    pct = F.when(F.col("top") > 0, F.col("n") * 100.0 / F.col("top")).otherwise(F.lit(0.0))
    return long.join(top, ["run", "reference"]).select("run", "reference", "threshold", pct.alias("percent"))


def selected_counts(reports: DataFrame, picks: dict[str, tuple[str, int]]) -> DataFrame:
    """Per run the last reported count of chosen (reference, threshold) pairs, 0 if none."""
    cols = []
    for name, (reference, threshold) in picks.items():
        mine = (F.col("reference") == reference) & (F.col("threshold") == threshold)
        cols.append(F.coalesce(F.max_by(F.when(mine, F.col("n")), F.when(mine, F.col("row_id"))), F.lit(0)).alias(name))
    return reports.groupBy("run").agg(*cols)


def slices_aligned(reports: DataFrame, a: str, b: str, threshold: int) -> DataFrame:
    """Two references side by side for all runs that either has; missing sums are 0."""
    one, two = (
        reports.where((F.col("reference") == r) & (F.col("threshold") == threshold)).groupBy("run").agg(F.sum("n").alias(c)) for r, c in ((a, "n_a"), (b, "n_b"))
    )
    return one.join(two, "run", "full_outer").select("run", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
