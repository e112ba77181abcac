"""Queries of the training data operators over the given tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import sql_file_key, sql_run_key
from ..runtime import materialize, table
from .clusters import cluster_reads
from .mixing import emit_mix, mix_sources
from .pii import find_personal, redact
from .quantiles import requested_quantiles
from .sampling import sample_plans
from .splits import split_manifest, split_report
from .steps import collapse_steps, step_features
from .tokens import token_ids


def p1_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return requested_quantiles([table(spark, d, "peptide_signals")], table(spark, d, "quantile_requests"))


def p1_days(spark: SparkSession, d: str) -> DataFrame:
    """The same over four deliveries that are counted apart, the days dealt to them in turn."""
    reads = table(spark, d, "peptide_signals")
    turn = F.coalesce(F.pmod(F.datediff("acquired_at", F.lit("1970-01-01")), F.lit(4)), F.lit(0))
    return requested_quantiles([reads.where(turn == i) for i in range(4)], table(spark, d, "quantile_requests"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return split_manifest(table(spark, d, "templaterc"), table(spark, d, "peptide_signals"), table(spark, d, "split_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).where("group_size > 1").select("entry_id", "group_id")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("entry_id", "group_id", "split")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return split_report(_split(spark, d).select("entry_id", "class", "split"), table(spark, d, "split_targets"))


def _six(c: str):
    """Six decimals, as sums in another order differ in the last digits."""
    return F.round(F.col(c) + F.lit(1e-8), 6)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse_steps(table(spark, d, "step_segments")).where("n_steps > 1").select("read_id", "run_start", "run_end")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_steps(table(spark, d, "step_segments")).withColumn("level", _six("level"))


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    out = step_features(collapse_steps(table(spark, d, "step_segments")))
    return out.withColumns({c: _six(c) for c in ("mean_step_len", "max_step_height")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = sample_plans(table(spark, d, "templaterc"), table(spark, d, "sample_targets"))
    return report.where("short").select("plan_id", "class", "dataset")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    sample, _ = sample_plans(table(spark, d, "templaterc"), table(spark, d, "sample_targets"))
    return sample


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = sample_plans(table(spark, d, "templaterc"), table(spark, d, "sample_targets"))
    return report


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = cluster_reads(table(spark, d, "feature_frame"))
    return members.where("size > 1").select("read_id", "cluster_id")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    _, groups = cluster_reads(table(spark, d, "feature_frame"))
    return groups


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_ids("text").alias("ids"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.where("short").select("mix_id", "source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    mix, _ = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mix


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report


def p8_emitted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    mix, _ = mix_sources(docs, table(spark, d, "mix_targets"))
    return emit_mix(mix, docs)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents")).select("doc_id", "kind", "start_pos")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return redact(docs, materialize(find_personal(docs), "found"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_QUANTILES = """
        with v as (
          select request_id, field, group_field, quantile, max_rank_error, read_id,
            case group_field when 'class' then class when 'run_name' then run_name when 'all' then 'all'
              when 'acquired_day' then strftime(acquired_at at time zone 'UTC', '%Y-%m-%d') end as group_value,
            case field when 'global_median' then global_median when 'global_mad' then global_mad
              when 'median_before_plr' then median_before_plr end as x
          from peptide_signals, quantile_requests),
        once as (
          select request_id, field, group_field, quantile, max_rank_error, group_value, read_id, min(x) as x
          from v where cast(x as varchar) not like '%nan%' group by all),
        ranked as (
          select *, row_number() over (partition by request_id, group_value order by x) as place,
            count(*) over (partition by request_id, group_value) as n
          from once)
        select request_id, field, group_field, group_value, quantile, n, x as value, cast(0 as double) as rank_error, max_rank_error
        from ranked where place = greatest(ceil(quantile * n - 1e-9), 1)"""

_RUNS = """
        with rows as (
          select distinct read_id, s, e, case when cast(mean as varchar) not like '%nan%' then mean end as mean, case when cast(std as varchar) not like '%nan%' then std end as std
          from step_segments where read_id is not null and s is not null),
        noise as (select read_id, quantile_disc(std, 0.5) as noise from rows where std > 0 group by read_id),
        near as (
          select r.read_id, s, e, mean,
            abs(mean - lag(mean) over (partition by r.read_id order by s, e, mean)) <= coalesce(noise, 0) as same
          from rows r left join noise n on n.read_id = r.read_id where mean is not null),
        runs as (
          select *, sum(case when same then 0 else 1 end) over (partition by read_id order by s, e, mean rows unbounded preceding) as run
          from near),
        collapsed as (
          select read_id, min(s) as run_start, cast(arg_max(coalesce(e, s), (s, coalesce(e, s), mean)) as integer) as run_end, count(*) as n_steps,
            cast(sum(coalesce(e, s) - s) as bigint) as samples,
            case when count(*) > 1 and sum(coalesce(e, s) - s) > 0 then sum(mean * (coalesce(e, s) - s)) / sum(coalesce(e, s) - s) else arg_min(mean, (s, coalesce(e, s), mean)) end as level
          from runs group by read_id, run)"""

SQL: dict[str, str] = {
    "p1_quantiles": _QUANTILES,
    "p1_days": _QUANTILES,
    "p2_found": f"""
        with recursive runs as (select entry_id, {sql_run_key("run_name")} as run from templaterc where entry_id is not null),
        listed as (select distinct read_id, {sql_run_key("run_name")} as run from peptide_signals where read_id is not null),
        keys as (
          select entry_id, 'run ' || run as key from runs where run is not null
          union select entry_id, 'file ' || {sql_file_key("file_path")} from templaterc where entry_id is not null and {sql_file_key("file_path")} is not null
          union select entry_id, 'read ' || read_id from runs join listed using (run)),
        near as (
          select entry_id as a, min(entry_id) over (partition by key) as b from keys
          union select min(entry_id) over (partition by key), entry_id from keys),
        reach as (select entry_id as a, entry_id as b from runs union select reach.a, near.b from reach join near on near.a = reach.b),
        groups as (select a as entry_id, min(b) as group_id from reach group by a)
        select entry_id, group_id from groups where group_id in (select group_id from groups group by group_id having count(*) > 1)""",
    "p3_found": _RUNS + """
        select read_id, run_start, run_end from collapsed where n_steps > 1""",
    "p3_runs": _RUNS + """
        select read_id, run_start, run_end, cast(n_steps as integer) as n_steps, samples, round(level + 1e-8, 6) as level, run_end - run_start as duration from collapsed""",
    "p3_features": _RUNS + """,
        heights as (select *, abs(level - lag(level) over (partition by read_id order by run_start, run_end)) as height from collapsed)
        select read_id, cast(sum(1) as bigint) as n_steps, round(sum(samples) / sum(1) + 1e-8, 6) as mean_step_len, round(max(height) + 1e-8, 6) as max_step_height from heights group by read_id""",
    "p5_found": """
        with have as (
          select class, lower(trim(dataset, chr(9) || chr(10) || chr(13) || ' ')) as d, count(*) as n from templaterc group by all)
        select plan_id, t.class, t.dataset from sample_targets t
        left join have h on h.class is not distinct from t.class
          and nullif(h.d, '') is not distinct from nullif(lower(trim(t.dataset, chr(9) || chr(10) || chr(13) || ' ')), '')
        group by plan_id, t.class, t.dataset, min_rows, target_share, sample_size
        having coalesce(sum(n), 0) < greatest(min_rows, target_share * sample_size)""",
}
