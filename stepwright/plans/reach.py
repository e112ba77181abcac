"""Queries of alignment reach over alignment_stats_summary, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import sql_run_key
from ..operators import reach as R
from ..operators.ranks import group_quantiles, join_groups
from ..runtime import table

#: The thresholds that reports use.
THRESHOLDS = [60, 75, 90, 105, 120, 135]
PICKS = {"lead_60": ("lead_fwd", 60), "lead_135": ("lead_fwd", 135), "loop_90": ("ctrl_loop", 90)}


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return R.reports_once(table(spark, d, "alignment_stats_summary"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return R.reach_wide(_reports(spark, d), THRESHOLDS)


def r6(c):
    """Six decimals; the shift keeps exact halves on one side in every engine."""
    return F.round(c + F.lit(1e-8), 6)


def reach_long(spark, d):
    return R.reach_long(_reports(spark, d))


def reach_wide(spark, d):
    return _wide(spark, d)


def reach_bins(spark, d):
    return R.exclusive_bins(_wide(spark, d), THRESHOLDS)


def reach_fractions(spark, d):
    out = R.reach_fractions(_wide(spark, d), THRESHOLDS)
    return out.select("run", "reference", *[r6(F.col(f"p_ge_{t}")).alias(f"p_ge_{t}") for t in THRESHOLDS])


def reach_drop_off_by_reference(spark, d):
    out = R.drop_off(R.reach_fractions(_wide(spark, d), THRESHOLDS), THRESHOLDS, ["reference"])
    return out.withColumn("median_fraction", r6(F.col("median_fraction")))


def reach_drop_off_overall(spark, d):
    out = R.drop_off(R.reach_fractions(_wide(spark, d), THRESHOLDS), THRESHOLDS, [])
    return out.withColumn("median_fraction", r6(F.col("median_fraction")))


def reach_directions(spark, d):
    return R.directions(_reports(spark, d), 60).withColumn("reverse_share", r6(F.col("reverse_share")))


def reach_max_normalised(spark, d):
    return R.max_normalised(R.reach_long(_reports(spark, d))).withColumn("percent", r6(F.col("percent")))


def reach_selected(spark, d):
    return R.selected_counts(_reports(spark, d), PICKS)


def reach_slices(spark, d):
    return R.slices_aligned(_reports(spark, d), "lead_fwd", "ctrl_loop", 60)


def reach_top_runs(spark, d):
    """The five runs with most reads at the first threshold, per reference: a top-k report."""
    at = R.reach_long(_reports(spark, d)).where("threshold = 60")
    place = F.row_number().over(W.partitionBy("reference").orderBy(F.desc("n"), "run"))
    return at.withColumn("place", place).where("place <= 5").select("reference", "place", "run", "n")


def reach_reference_shares(spark, d):
    """Share of each reference in its run's reads at the first threshold, and its rank; 0 rows give 0."""
    at = R.reach_long(_reports(spark, d)).where("threshold = 60")
    all_ = at.groupBy("run").agg(F.sum("n").alias("run_n"))
    share = F.when(F.col("run_n") > 0, F.col("n") / F.col("run_n")).otherwise(F.lit(0.0))
    return at.join(all_, "run").select("run", "reference", "n", r6(share).alias("share"))


def reach_late_reports(spark, d):
    """Per day of report the rows delivered, the reports, and how late the median one came in minutes."""
    rows = table(spark, d, "alignment_stats_summary")
    delay = (F.unix_timestamp("received_at") - F.unix_timestamp("reported_at")) / 60.0
    dated = rows.select(F.date_format("reported_at", "yyyy-MM-dd").alias("day"), "row_id", delay.alias("delay"))
    # Reports are counted once per day first, and the median from counts: no task holds the rows of a day.
    once = dated.groupBy("day", "row_id").agg(F.count("*").alias("n"))
    counts = once.groupBy("day").agg(F.sum("n").alias("n_rows"), F.count("row_id").alias("n_reports"))
    middle = group_quantiles(dated, ["day"], "delay", {"median_delay": 0.5})
    return join_groups(counts, middle, ["day"], "left").withColumn("median_delay", r6(F.col("median_delay")))


QUERIES = {f.__name__: f for f in (reach_long, reach_wide, reach_bins, reach_fractions, reach_drop_off_by_reference, reach_drop_off_overall, reach_directions, reach_max_normalised, reach_selected, reach_slices, reach_top_runs, reach_reference_shares, reach_late_reports)}

_R = f"""with firsts as (
  select *, row_number() over (partition by row_id order by received_at, run nulls first, reference nulls first, threshold, "count" nulls first) as k
  from alignment_stats_summary),
reports as (
  select row_id, {sql_run_key('run')} as run, reference, threshold, coalesce("count", 0) as n from firsts
  where k = 1 and {sql_run_key('run')} is not null and reference is not null),
long as (select run, reference, threshold, cast(sum(n) as bigint) as n from reports group by all),
wide as (select run, reference, {', '.join(f'cast(sum(case when threshold = {t} then n else 0 end) as bigint) as ge_{t}' for t in THRESHOLDS)} from reports group by all),
frac as (select run, reference, {', '.join(f'ge_{t} / cast(case when ge_60 = 0 then 1 else ge_60 end as double) as p_ge_{t}' for t in THRESHOLDS)} from wide),
melted as ({' union all '.join(f'select run, reference, {t} as threshold, p_ge_{t} as p from frac' for t in THRESHOLDS)})
"""

SQL = {
    "reach_long": _R + "select * from long",
    "reach_wide": _R + "select * from wide",
    "reach_bins": _R + "select run, reference, " + ", ".join(f"ge_{a} - ge_{b} as bin_{a}" for a, b in zip(THRESHOLDS, THRESHOLDS[1:])) + ", ge_135 as bin_135 from wide",
    "reach_fractions": _R + "select run, reference, " + ", ".join(f"round(p_ge_{t} + 1e-8, 6) as p_ge_{t}" for t in THRESHOLDS) + " from frac",
    "reach_drop_off_by_reference": _R + "select reference, threshold, round(median(p) + 1e-8, 6) as median_fraction, count(*) as n_runs from melted group by all",
    "reach_drop_off_overall": _R + "select threshold, round(median(p) + 1e-8, 6) as median_fraction, count(*) as n_runs from melted group by all",
    "reach_directions": _R + """select run, n_forward, n_reverse, round(n_reverse / cast(nullif(n_forward + n_reverse, 0) as double) + 1e-8, 6) as reverse_share from (
      select run, cast(sum(case when regexp_matches(reference, '_(rc|rev)$') then 0 else n end) as bigint) as n_forward,
        cast(sum(case when regexp_matches(reference, '_(rc|rev)$') then n else 0 end) as bigint) as n_reverse
      from reports where threshold = 60 group by run)""",
    "reach_max_normalised": _R + """select run, reference, threshold,
      round(case when max(n) over w > 0 then n * 100.0 / cast(max(n) over w as double) else 0 end + 1e-8, 6) as percent
      from long window w as (partition by run, reference)""",
    "reach_selected": _R + "select run, " + ", ".join(f"coalesce(arg_max(n, row_id) filter (reference = '{r}' and threshold = {t}), 0) as {c}" for c, (r, t) in PICKS.items()) + " from reports group by run",
    "reach_slices": _R + """select coalesce(a.run, b.run) as run, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b
      from (select * from long where reference = 'lead_fwd' and threshold = 60) a
      full join (select * from long where reference = 'ctrl_loop' and threshold = 60) b on a.run = b.run""",
    "reach_top_runs": _R + """select reference, cast(place as integer) as place, run, n from (
      select *, row_number() over (partition by reference order by n desc, run) as place from long where threshold = 60) where place <= 5""",
    "reach_reference_shares": _R + """select run, reference, n,
      round(case when sum(n) over (partition by run) > 0 then n / cast(sum(n) over (partition by run) as double) else 0 end + 1e-8, 6) as share
      from long where threshold = 60""",
    "reach_late_reports": """select strftime(reported_at at time zone 'UTC', '%Y-%m-%d') as day, count(*) as n_rows, count(distinct row_id) as n_reports,
      round(median((floor(epoch(received_at)) - floor(epoch(reported_at))) / 60.0) + 1e-8, 6) as median_delay
      from alignment_stats_summary group by 1""",
}
