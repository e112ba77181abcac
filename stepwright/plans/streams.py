"""Streaming queries over alignment_stats_summary, run over what there is, with the SQL of the same result."""

from __future__ import annotations

from ..streaming import reports as R


def stream_daily_counts(spark, d):
    return R.drain(R.daily_counts(R.report_stream(spark, f"{d}/alignment_stats_summary.parquet")), "update", ["day", "reference"])


def stream_running_totals(spark, d):
    return R.drain(R.running_totals(R.report_stream(spark, f"{d}/alignment_stats_summary.parquet")), "update", ["run"])


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_running_totals)}

_ONCE = """with firsts as (select *, row_number() over (partition by row_id order by received_at) as k from alignment_stats_summary), once as (select * from firsts where k = 1)
"""

SQL = {
    "stream_daily_counts": _ONCE + """select strftime(reported_at at time zone 'UTC', '%Y-%m-%d') as day, reference, count(*) as n_reports, cast(sum("count") as bigint) as n_reads from once group by 1, 2""",
    "stream_running_totals": _ONCE + """select run, count(*) as n_reports, cast(coalesce(sum("count"), 0) as bigint) as n_reads from once where run is not null group by run""",
}
