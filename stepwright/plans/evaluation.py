"""Queries of evaluation and statistics over peptide_signals and feature_frame, with their SQL.

The predictions are those of the simplest model of these data: a read is given the class that most
reads acquired on its day have (ties to the first name), with that class's share of the day as confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import stats as T
from ..runtime import table
from .reach import r6

FEATURES = ["median_slope", "kurtosis", "total_variation", "n_steps", "mean_step_len", "max_step_height"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(id, y_true, y_pred, confidence) of the reads with a class and a time of acquisition."""
    rows = table(spark, d, "peptide_signals").where("read_id is not null")
    first = F.min(F.struct("received_at", "run_name", "class", "acquired_at")).alias("f")
    reads = rows.groupBy("read_id").agg(first).select("read_id", F.date_format("f.acquired_at", "yyyy-MM-dd").alias("day"), "f.class")
    reads = reads.where("class is not null and day is not null")
    counts = reads.groupBy("day", "class").agg(F.count("*").alias("n"))
    top = counts.groupBy("day").agg(F.min(F.struct((-F.col("n")).alias("neg"), "class")).alias("best"), F.sum("n").alias("all_n"))
    model = top.select("day", F.col("best.class").alias("y_pred"), (-F.col("best.neg") / F.col("all_n")).alias("confidence"))
    return reads.join(model, "day").select(F.col("read_id").alias("id"), F.col("class").alias("y_true"), "y_pred", "confidence")


def features(spark: SparkSession, d: str) -> DataFrame:
    """Each read's features once, as first computed, with its class."""
    rows = table(spark, d, "feature_frame").where("read_id is not null")
    once = rows.groupBy("read_id").agg(F.min(F.struct("computed_at", *FEATURES)).alias("f")).select("read_id", *[F.nanvl(f"f.{c}", F.lit(None)).alias(c) for c in FEATURES])
    label = table(spark, d, "peptide_signals").where("read_id is not null").groupBy("read_id").agg(F.min(F.struct("received_at", "run_name", "class")).alias("f")).select("read_id", F.col("f.class").alias("class"))
    return once.join(label, "read_id")


def eval_confusion(spark, d):
    return _rounded(E.confusion_grid(E.confusion(predictions(spark, d))))


def eval_per_class(spark, d):
    return _rounded(E.per_class(E.confusion(predictions(spark, d))))


def eval_summary(spark, d):
    cells = E.confusion(predictions(spark, d))
    return _rounded(E.summary(E.per_class(cells), cells))


def eval_coverage(spark, d):
    return _rounded(E.coverage(predictions(spark, d), [0.95, 0.9, 0.85, 0.8, 0.75, 0.5]))


def eval_precision_recall(spark, d):
    return _rounded(E.precision_recall(predictions(spark, d)))


def eval_average_precision(spark, d):
    return _rounded(E.average_precision(predictions(spark, d)))


def eval_calibration(spark, d):
    return _rounded(E.calibration_bins(predictions(spark, d)))


def eval_errors(spark, d):
    return _rounded(E.error_summary(predictions(spark, d)))


def eval_surest_wrong(spark, d):
    return _rounded(E.surest_examples(predictions(spark, d), 4, False))


def stats_class_summary(spark, d):
    return _rounded(T.class_summary(T.long_features(features(spark, d), ["read_id", "class"], FEATURES)))


def stats_anova(spark, d):
    return _rounded(T.anova(T.long_features(features(spark, d).where("class is not null"), ["read_id", "class"], FEATURES)))


def stats_spearman(spark, d):
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
    return _rounded(T.spearman(features(spark, d), "read_id", pairs))


def stats_mann_whitney(spark, d):
    return _rounded(T.mann_whitney(T.long_features(features(spark, d), ["read_id", "class"], FEATURES), "ßLIN"))


def stats_least_squares(spark, d):
    return _rounded(T.least_squares(features(spark, d), "n_steps", "mean_step_len", "class"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith(("eval_", "stats_"))}

_P = """with firsts as (select *, row_number() over (partition by read_id order by received_at, run_name nulls first, class nulls first) as k from peptide_signals where read_id is not null),
  reads as (select read_id, strftime(acquired_at at time zone 'UTC', '%Y-%m-%d') as day, class from firsts where k = 1 and class is not null and acquired_at is not null),
  counts as (select day, class, count(*) as n from reads group by all),
  model as (select day, class as y_pred, n / cast(all_n as double) as confidence from (select *, sum(n) over (partition by day) as all_n, row_number() over (partition by day order by n desc, class) as k from counts) where k = 1),
  preds as (select read_id as id, class as y_true, y_pred, confidence from reads join model using (day)),
  cells as (select y_true, y_pred, count(*) as n from preds group by all),
  tr as (select y_true as label, cast(sum(n) as bigint) as support, cast(sum(case when y_true = y_pred then n else 0 end) as bigint) as tp from cells group by 1),
  pr as (select y_pred as label, cast(sum(n) as bigint) as predicted from cells group by 1),
  classes as (select label, support, tp, coalesce(predicted, 0) as predicted from tr left join pr using (label)),
  prf as (select label, support, tp, predicted, case when predicted > 0 then tp / cast(predicted as double) else 0 end as p, tp / cast(support as double) as r, 2.0 * tp / cast(predicted + support as double) as f1 from classes),
  points as (select label, confidence, hits / cast(seen as double) as precision, hits / cast(support as double) as recall from (
    select label, confidence, sum(n) over w as seen, sum(hit) over w as hits from (select y_pred as label, confidence, count(*) as n, count(*) filter (y_true = y_pred) as hit from preds group by all)
    window w as (partition by label order by confidence desc)) join tr using (label))
"""
_F = """with frow as (select *, row_number() over (partition by read_id order by computed_at, median_slope nulls first) as k from feature_frame where read_id is not null),
  prow as (select *, row_number() over (partition by read_id order by received_at, run_name nulls first, class nulls first) as k from peptide_signals where read_id is not null),
  f as (select f.read_id, class, """ + ", ".join(f"case when cast(f.{c} as varchar) not like '%nan%' then f.{c} end as {c}" for c in FEATURES) + """ from frow f join prow p on p.read_id = f.read_id where f.k = 1 and p.k = 1),
  long as (""" + " union all ".join(f"select read_id, class, '{c}' as feature, {c} as v from f where isfinite({c})" for c in FEATURES) + ")\n"


def _r(e: str, name: str) -> str:
    return f"round({e} + 1e-8, 6) as {name}"


SQL = {
    "eval_confusion": _P + f"""select g.y_true, g.y_pred, coalesce(n, 0) as n, {_r('coalesce(n, 0) / cast(row_n as double)', 'row_share')}
      from (select * from (select y_true, sum(n) as row_n from cells group by 1), (select distinct y_pred from cells)) g left join cells c on c.y_true = g.y_true and c.y_pred = g.y_pred""",
    "eval_per_class": _P + f"select label, {_r('p', 'precision')}, {_r('r', 'recall')}, {_r('f1', 'f1')}, support, tp, predicted from prf",
    "eval_summary": _P + f""", lab as (select coalesce(tr.label, pr.label) as label, coalesce(support, 0)::double as t, coalesce(predicted, 0)::double as p from tr full join pr on tr.label = pr.label),
      x as (select sum(t * p) as pt, sum(t * t) as tt, sum(p * p) as pp from lab),
      s as (select cast(sum(support) as bigint) as n, sum(tp) as tp, sum(predicted) as predicted, avg(r) as ba, avg(p) as mp, avg(f1) as mf, sum(f1 * support) / sum(support) as wf from prf)
      select n, {_r('tp / cast(n as double)', 'accuracy')}, {_r('ba', 'balanced_accuracy')}, {_r('tp / cast(predicted as double)', 'micro_precision')}, {_r('mp', 'macro_precision')}, {_r('mf', 'macro_f1')}, {_r('wf', 'weighted_f1')},
        {_r('coalesce((tp * cast(n as double) - pt) / nullif(sqrt(n::double * n - pp) * sqrt(n::double * n - tt), 0), 0)', 'mcc')} from s, x""",
    "eval_coverage": _P + f"""select round(threshold + 1e-8, 6) as threshold, {_r("count(*) filter (confidence >= threshold) / cast(count(*) as double)", "coverage")},
      {_r("count(*) filter (confidence >= threshold and y_true = y_pred) / cast(nullif(count(*) filter (confidence >= threshold), 0) as double)", "accuracy")}
      from preds, (select unnest([0.95, 0.9, 0.85, 0.8, 0.75, 0.5]::double[]) as threshold) group by threshold""",
    "eval_precision_recall": _P + f"select label, {_r('confidence', 'confidence')}, {_r('precision', 'precision')}, {_r('recall', 'recall')} from points",
    "eval_average_precision": _P + f"""select label, {_r('sum(part)', 'average_precision')} from (
      select label, (recall - coalesce(lag(recall) over (partition by label order by confidence desc), 0)) * precision as part from points) group by label""",
    "eval_calibration": _P + f"""select bin, n, {_r('hit / cast(n as double)', 'accuracy')}, {_r('sum(hit) over w / cast(sum(n) over w as double)', 'accuracy_down')}, {_r('sum(n) over w / cast(sum(n) over () as double)', 'coverage')}
      from (select cast(least(floor(confidence * 10), 9) as integer) as bin, count(*) as n, count(*) filter (y_true = y_pred) as hit from preds group by 1) window w as (order by bin desc)""",
    "eval_errors": _P + f"select y_true, count(*) as n, count(*) filter (y_true = y_pred) as n_correct, count(*) filter (y_true <> y_pred) as n_incorrect, {_r('1 - count(*) filter (y_true = y_pred) / cast(count(*) as double)', 'error_rate')} from preds group by y_true",
    "eval_surest_wrong": _P + f"select y_true, cast(place as integer) as place, id, y_pred, {_r('confidence', 'confidence')} from (select *, row_number() over (partition by y_true order by confidence desc, id) as place from preds where y_true <> y_pred) where place <= 4",
    "stats_class_summary": _F + f"select class, feature, count(*) as n, {_r('median(v)', 'median')}, {_r('avg(v)', 'mean')}, {_r('stddev_samp(v)', 'sd')}, {_r('quantile_cont(v, 0.9)', 'q90')}, {_r('quantile_cont(v, 0.99)', 'q99')}, {_r('min(v)', 'least')}, {_r('max(v)', 'greatest')} from long group by class, feature",
    "stats_anova": _F + f""", per as (select feature, class, count(*) as n, avg(v) as m, var_pop(v) as vp from long where class is not null group by all),
      g as (select feature, sum(n * m) / sum(n) as grand from per group by 1)
      select feature, count(*) as k, cast(sum(n) as bigint) as n, {_r('(sum(n * pow(m - grand, 2)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*)))', 'f')} from per join g using (feature) group by feature""",
    "stats_spearman": _F + ", pairs as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, {a} as x, {b} as y from f where {a} is not null and {b} is not null" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]) + f"""),
      r as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as rx, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as ry from pairs)
      select a, b, count(*) as n, {_r('corr(rx, ry)', 'rho')} from r group by a, b""",
    "stats_mann_whitney": _F + f""", o as (select distinct feature, class from long where class is not null and class <> 'ßLIN'),
      u as (select o.feature, o.class, l.v, l.class = 'ßLIN' as mine from o join long l on l.feature = o.feature and (l.class = o.class or l.class = 'ßLIN')),
      r as (select *, rank() over (partition by feature, class order by v) + (count(*) over (partition by feature, class, v) - 1) / 2.0 as rank from u),
      t as (select feature, class, sum(c::double * c * c - c) as ties from (select feature, class, v, count(*) as c from u group by all) group by all),
      s as (select feature, class, count(*) filter (mine) as na, count(*) filter (not mine) as nb, sum(rank) filter (mine) as ra from r group by all having count(*) filter (mine) >= 5 and count(*) filter (not mine) >= 5)
      select feature, class, na, nb, {_r('ra - na * (na + 1) / 2.0', 'u')},
        {_r('greatest(abs(ra - na * (na + 1) / 2.0 - na::double * nb / 2.0) - 0.5, 0) / sqrt(na::double * nb / 12 * (na + nb + 1 - ties / ((na + nb)::double * (na + nb - 1))))', 'z')} from s join t using (feature, class)""",
    "stats_least_squares": _F + f"""select class, count(*) as n, {_r('case when var_pop(n_steps) > 0 then regr_slope(mean_step_len, n_steps) end', 'slope')}, {_r('case when var_pop(n_steps) > 0 then regr_intercept(mean_step_len, n_steps) end', 'intercept')},
      {_r('case when var_pop(n_steps) > 0 and var_pop(mean_step_len) > 0 then pow(corr(mean_step_len, n_steps), 2) end', 'r2')} from f where n_steps is not null and mean_step_len is not null group by class""",
}
