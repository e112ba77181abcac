"""Queries of per-key results on the tables whose keys are out of balance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import sketch_keys, skew_aggregate, skew_distinct, skew_join
from ..runtime import table

FIELDS = (("templaterc", "class"), ("alignment_stats_summary", "reference"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        skew_aggregate(table(spark, d, t), key, []).where("heavy").select(F.lit(key).alias("field"), "key_value") for t, key in FIELDS
    ]
    return parts[0].unionByName(parts[1])


def p4_reference_results(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "alignment_stats_summary")
    aggs = [F.sum("count").alias("total_count"), F.max("threshold").alias("max_threshold"), F.min("reported_at").alias("first_report")]
    sketch = sketch_keys(rows, "reference")
    totals = skew_aggregate(rows, "reference", aggs, sketch=sketch)
    runs = skew_distinct(rows, "reference", "run", sketch=sketch).withColumnRenamed("n_distinct", "n_runs")
    return totals.join(runs, "key_value").select("key_value", "heavy", "n_rows", "total_count", "max_threshold", "first_report", "n_runs")


def p4_class_results(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "templaterc")
    sketch = sketch_keys(rows, "class")
    totals = skew_aggregate(rows, "class", [F.count("file_path").alias("n_paths"), F.min("entry_id").alias("first_entry")], sketch=sketch)
    runs = skew_distinct(rows, "class", "run_name", sketch=sketch).withColumnRenamed("n_distinct", "n_runs")
    return totals.join(runs, "key_value").select("key_value", "heavy", "n_rows", "n_paths", "first_entry", "n_runs")


def p4_report_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each report with its count as a share of the greatest count of its reference."""
    rows = table(spark, d, "alignment_stats_summary").select("row_id", "reference", "count", "received_at")
    sketch = sketch_keys(rows, "reference")
    dim = skew_aggregate(rows, "reference", [F.max("count").alias("top_count")], sketch=sketch).select(F.col("key_value").alias("reference"), "top_count")
    joined = skew_join(rows, dim, "reference", sketch=sketch)
    return joined.select("row_id", "received_at", "reference", "count", F.try_divide("count", "top_count").alias("of_top"))


QUERIES = {f.__name__: f for f in (p4_found, p4_reference_results, p4_class_results, p4_report_shares)}

SQL = {
    "p4_found": """
        select 'class' as field, class as key_value from templaterc where class is not null group by class
        having count(*) >= 0.05 * (select count(*) from templaterc)
        union all
        select 'reference', reference from alignment_stats_summary where reference is not null group by reference
        having count(*) >= 0.05 * (select count(*) from alignment_stats_summary)""",
    "p4_reference_results": """
        select reference as key_value, count(*) >= 0.05 * (select count(*) from alignment_stats_summary) as heavy,
          count(*) as n_rows, cast(sum("count") as bigint) as total_count, max(threshold) as max_threshold,
          min(reported_at) as first_report, count(distinct run) as n_runs
        from alignment_stats_summary where reference is not null group by reference""",
    "p4_class_results": """
        select class as key_value, count(*) >= 0.05 * (select count(*) from templaterc) as heavy, count(*) as n_rows,
          count(file_path) as n_paths, min(entry_id) as first_entry, count(distinct run_name) as n_runs
        from templaterc where class is not null group by class""",
    "p4_report_shares": """
        select row_id, received_at, reference, "count",
          case when max("count") over (partition by reference) <> 0
            then cast("count" as double) / max("count") over (partition by reference) end as of_top
        from alignment_stats_summary where reference is not null""",
}
