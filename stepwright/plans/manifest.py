"""Queries over the manifest templaterc, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import sql_dataset_key, sql_file_key, sql_run_key
from ..operators import manifest as M
from ..runtime import table
from .reach import r6


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return M.clean_entries(table(spark, d, "templaterc"))


def manifest_clean(spark, d):
    return _clean(spark, d)


def manifest_first_entries(spark, d):
    return M.first_entries(_clean(spark, d))


def manifest_class_by_dataset(spark, d):
    return M.class_by_dataset(_clean(spark, d))


def manifest_replicates(spark, d):
    return M.replicate_labels(_clean(spark, d))


def manifest_class_weights(spark, d):
    return M.class_weights(_clean(spark, d)).withColumn("weight", r6(F.col("weight")))


def manifest_imbalance(spark, d):
    return M.imbalance(_clean(spark, d)).withColumn("ratio", r6(F.col("ratio")))


def manifest_stratified_split(spark, d):
    return M.stratified_split(_clean(spark, d), 0.1)


def manifest_label_groups(spark, d):
    return _clean(spark, d).groupBy(M.label_group(F.col("class")).alias("label_group")).agg(F.count("*").alias("n"), F.countDistinct("class").alias("n_classes"))


def manifest_unseen_runs(spark, d):
    return M.unseen_runs(_clean(spark, d), table(spark, d, "peptide_signals"))


def manifest_renamed(spark, d):
    return M.renamed_entries(_clean(spark, d))


def manifest_path_parts(spark, d):
    return M.path_parts(_clean(spark, d))


def manifest_label_order(spark, d):
    """Labels in the order of the md5 of their names, for stable colours."""
    labels = _clean(spark, d).where("class is not null").select("class").distinct()
    return labels.select("class", F.md5("class").alias("digest")).withColumn("place", F.row_number().over(W.orderBy("digest")))


def manifest_small_classes(spark, d):
    """Entries of classes with fewer than five members, which stratified work has to leave out."""
    clean = _clean(spark, d).where("class is not null")
    small = clean.groupBy("class").agg(F.count("*").alias("n")).where("n < 5")
    return clean.join(small, "class").select("entry_id", "class", "n")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("manifest_")}

_C = f"""with clean as (select entry_id, {sql_run_key('run_name')} as run, {sql_file_key('file_path')} as file, class, {sql_dataset_key('dataset')} as dataset from templaterc)
"""

SQL = {
    "manifest_clean": _C + "select * from clean",
    "manifest_first_entries": _C + "select run, entry_id, file, class, dataset from (select *, row_number() over (partition by run order by entry_id) as k from clean where run is not null) where k = 1",
    "manifest_class_by_dataset": _C + """select class, count(*) as n, count(*) filter (dataset = 'train') as n_train, count(*) filter (dataset = 'test') as n_test,
      count(*) filter (dataset is null or dataset not in ('train', 'test')) as n_other from clean group by class""",
    "manifest_replicates": _C + """select class, run, class || '-rep' || row_number() over (partition by class order by case when regexp_matches(run, '^[0-9]{1,18}$') then cast(run as bigint) end nulls last, run) as replicate
      from (select distinct class, run from clean where run is not null and class is not null)""",
    "manifest_class_weights": _C + """select class, n, round(sum(n) over () / cast(count(*) over () * n as double) + 1e-8, 6) as weight
      from (select class, count(*) as n from clean where class is not null group by class having count(*) >= 2)""",
    "manifest_imbalance": _C + """select max(n) as largest, min(n) as smallest, round(max(n) / cast(min(n) as double) + 1e-8, 6) as ratio, max(n) / cast(min(n) as double) >= 2 as weighted
      from (select class, count(*) as n from clean where class is not null group by class)""",
    "manifest_stratified_split": _C + """select entry_id, class, case when place <= round(n * 0.1) then 'validation' else 'train' end as part from (
      select entry_id, class, row_number() over (partition by class order by md5('0:' || entry_id), entry_id) as place, count(*) over (partition by class) as n from clean)""",
    "manifest_label_groups": _C + """select case when class is null or regexp_matches(lower(class), '^(unassigned|dna-blank)$') then 'unknown' when regexp_matches(lower(class), '^mix') then 'mixture' else 'known' end as label_group,
      count(*) as n, count(distinct class) as n_classes from clean group by 1""",
    "manifest_unseen_runs": _C + f""", listed as (select distinct run from clean where run is not null),
      reads as (select distinct {sql_run_key('run_name')} as run from peptide_signals where {sql_run_key('run_name')} is not null)
      select run, 'manifest' as missing_in from reads where run not in (select run from listed)
      union all select run, 'reads' from listed where run not in (select run from reads)""",
    "manifest_renamed": _C + "select entry_id, run, split_part(file, '/', 1) as folder from clean where run is not null and file is not null and split_part(file, '/', 1) <> run",
    "manifest_path_parts": _C + "select split_part(file, '/', 2) as reference, count(*) as n, count(distinct split_part(file, '/', 1)) as n_runs from clean where file is not null group by 1",
    "manifest_label_order": _C + "select class, md5(class) as digest, cast(row_number() over (order by md5(class)) as integer) as place from (select distinct class from clean where class is not null)",
    "manifest_small_classes": _C + "select entry_id, class, n from (select *, count(*) over (partition by class) as n from clean where class is not null) where n < 5",
}
