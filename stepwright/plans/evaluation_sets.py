"""Queries of evaluation by subsets, probabilities, mixtures and repeated runs, with their SQL.

The model is that of plans.evaluation: each class's share of the day on which a read was acquired.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation_sets as E
from ..operators import stats as T
from .evaluation import _P, FEATURES, features, predictions
from .evaluation import SQL as EVAL_SQL
from .reach import r6
from ..runtime import table

#: What the mixed and the unassigned records are compared with.
COMPONENTS = {"MIX-b": ["ßLIN", "KORV7"], "unassigned": ["ßLIN", "TAMQ", "KORV7"]}


def _rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def probabilities(spark, d):
    """(id, y_true, label, p) of each read for all classes of its day."""
    rows = table(spark, d, "peptide_signals").where("read_id is not null")
    first = F.min(F.struct("received_at", "run_name", "class", "acquired_at")).alias("f")
    reads = rows.groupBy("read_id").agg(first).select(F.col("read_id").alias("id"), F.date_format("f.acquired_at", "yyyy-MM-dd").alias("day"), F.col("f.class").alias("y_true"))
    reads = reads.where("y_true is not null and day is not null")
    counts = reads.groupBy("day", F.col("y_true").alias("label")).agg(F.count("*").alias("n"))
    total = counts.groupBy("day").agg(F.sum("n").alias("total"))
    return reads.join(counts.join(total, "day").select("day", "label", (F.col("n") / F.col("total")).alias("p")), "day").select("id", "y_true", "label", "p")


def sets_summary(spark, d):
    return _rounded(E.subset_summaries(E.subset_cells(predictions(spark, d))))


def sets_report(spark, d):
    return E.report(E.subset_cells(predictions(spark, d)))


def sets_confusion_notes(spark, d):
    return _rounded(E.confusion_notes(E.subset_cells(predictions(spark, d))))


def sets_micro_curve(spark, d):
    return _rounded(E.micro_curve(probabilities(spark, d)))


def sets_average_precisions(spark, d):
    return _rounded(E.average_precisions(probabilities(spark, d)))


def sets_macro_curve(spark, d):
    return _rounded(E.macro_curve(probabilities(spark, d)))


def sets_quantile_bins(spark, d):
    return _rounded(E.quantile_bins(predictions(spark, d)))


def sets_top_k(spark, d):
    return _rounded(E.top_k(probabilities(spark, d)))


def sets_mixture_shares(spark, d):
    return _rounded(E.mixture_shares(predictions(spark, d), COMPONENTS))


def sets_mixture_scores(spark, d):
    return _rounded(E.mixture_scores(predictions(spark, d), COMPONENTS))


def sets_repeated_runs(spark, d):
    """Metrics of five parts of the reads as if each were a run of its own, summarised."""
    parts = predictions(spark, d).withColumn("run_index", F.pmod(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("int"), F.lit(5)))
    right = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    rows = parts.groupBy("run_index").agg(right.alias("accuracy"), F.avg("confidence").alias("mean_confidence"), F.count("*").alias("n"))
    return _rounded(E.repeated_runs(E.flat_metrics(rows, ["run_index"]), "accuracy"))


def sets_tests(spark, d):
    """Each class against the largest per feature, with p and whether it stands among all tests."""
    tests = T.mann_whitney(T.long_features(features(spark, d), ["read_id", "class"], FEATURES), "ßLIN")
    return _rounded(T.benjamini_hochberg(tests.withColumn("p", T.two_sided(F.col("z"))), "p"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("sets_") and callable(f)}


def _r(e: str, name: str) -> str:
    return f"round({e} + 1e-8, 6) as {name}"


_G = """, sub as (select unnest(list_filter(['all', case when g <> 'unknown' then 'known' end, case when g = 'known' then 'known_no_mixture' end, case when g = 'unknown' then 'unknown' end], lambda s: s is not null)) as subset, y_true, y_pred, n from (
    select *, case when y_true is null or regexp_matches(lower(y_true), '^(unassigned|dna-blank)$') then 'unknown' when regexp_matches(lower(y_true), '^mix') then 'mixture' else 'known' end as g from cells)),
  st as (select subset, y_true as label, cast(sum(n) as bigint) as support, cast(coalesce(sum(n) filter (y_true = y_pred), 0) as bigint) as tp from sub group by all),
  sp as (select subset, y_pred as label, cast(sum(n) as bigint) as predicted from sub group by all),
  sc as (select *, coalesce(tp / nullif(predicted, 0)::double, 0) as p, tp / support::double as r, 2.0 * tp / (predicted + support)::double as f from (select subset, label, support, tp, coalesce(predicted, 0) as predicted from st left join sp using (subset, label)))
"""
_PROB = """, pb as (select read_id as id, r.class as y_true, c.class as label, c.n / sum(c.n) over (partition by read_id)::double as p from reads r join counts c using (day)),
  pt as (select label, p, count(*) as n, count(*) filter (y_true = label) as hit from pb group by all),
  pr1 as (select label, p, hit, sum(n) over w as seen, sum(hit) over w as hits, sum(hit) over (partition by label) as support from pt window w as (partition by label order by p desc)),
  mp as (select p, sum(n) as n, sum(hit) as hit from pt group by p),
  mc as (select p, n, hit, sum(hit) over w / (sum(n) over w)::double as precision, sum(hit) over w / (sum(hit) over ())::double as recall, sum(hit) over () as total from mp window w as (order by p desc)),
  ap as (select label, sum(hit / support::double * hits / seen) as ap from pr1 where support > 0 group by label)
"""
_COMP = ", comp as (select * from (values " + ", ".join(f"('{m}', '{v}', {len(c)})" for m, c in COMPONENTS.items() for v in c) + ") t(mixture, label, k))"
_Z = "(1.0::double / (1 + 0.3275911::double * (z / sqrt(2))))"
_PVAL = f"least(1.0, exp(-z * z / 2) * {_Z} * (0.254829592::double + {_Z} * (-0.284496736::double + {_Z} * (1.421413741::double + {_Z} * (-1.453152027::double + {_Z} * 1.061405429::double)))))"

# The scores before they are rounded.
_MW = EVAL_SQL["stats_mann_whitney"].replace("round(greatest(", "(greatest(").replace(" + 1e-8, 6) as z", ") as z")

SQL = {
    "sets_summary": _P + _G + f""", ct as (select coalesce(a.subset, b.subset) as subset, coalesce(support, 0)::double as t, coalesce(predicted, 0)::double as p from st a full join sp b on a.subset = b.subset and a.label = b.label),
      x as (select subset, sum(t * p) as pt, sum(t * t) as tt, sum(p * p) as pp from ct group by subset),
      s as (select subset, cast(sum(support) as bigint) as n, sum(tp) as tp, sum(predicted) as pd, avg(p) as mp, avg(r) as mr, avg(f) as mf, sum(p * support) / sum(support) as wp, sum(r * support) / sum(support) as wr, sum(f * support) / sum(support) as wf from sc group by subset)
      select subset, n, {_r('tp / n::double', 'accuracy')}, {_r('mr', 'balanced_accuracy')}, {_r('coalesce((tp * n::double - pt) / nullif(sqrt(n::double * n - pp) * sqrt(n::double * n - tt), 0), 0)', 'mcc')}, {_r('tp / nullif(pd, 0)::double', 'micro_precision')}, {_r('tp / n::double', 'micro_recall')}, {_r('2.0 * tp / (pd + n)::double', 'micro_f1')},
        {_r('mp', 'macro_precision')}, {_r('mr', 'macro_recall')}, {_r('mf', 'macro_f1')}, {_r('wp', 'weighted_precision')}, {_r('wr', 'weighted_recall')}, {_r('wf', 'weighted_f1')} from s join x using (subset)""",
    "sets_report": _P + _G + """, rows as (select subset, label, p, r, f, support from sc
        union all select subset, 'macro avg', avg(p), avg(r), avg(f), sum(support) from sc group by subset
        union all select subset, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) from sc group by subset)
      select subset, label, printf('%.6f', p + 1e-9::double) as precision, printf('%.6f', r + 1e-9::double) as recall, printf('%.6f', f + 1e-9::double) as f1, cast(support as bigint) as support from rows""",
    "sets_confusion_notes": _P + _G + f"""select subset, y_true, y_pred, n, {_r('share', 'row_share')} from (
      select *, n / sum(n) over (partition by subset, y_true)::double as share, row_number() over (partition by subset, y_true order by n desc, y_pred) as k from sub) where y_true = y_pred or k <= 2 or share > 0.1""",
    "sets_micro_curve": _P + _PROB + f"select {_r('p', 'p')}, cast(n as bigint) as n, cast(hit as bigint) as hit, {_r('precision', 'precision')}, {_r('recall', 'recall')} from mc",
    "sets_average_precisions": _P + _PROB + f"select label, {_r('ap', 'average_precision')} from ap union all select 'micro', {_r('sum(hit / total::double * precision)', 'x')} from mc union all select 'macro', {_r('avg(ap)', 'x')} from ap",
    "sets_macro_curve": _P + _PROB + f""", pts as (select label, hits / support::double as r, max(hits / seen::double) as v from pr1 where support > 0 group by all),
      g as (select label, i / 50.0::double as g from (select distinct label from pts), (select unnest(generate_series(0, 50)) as i)),
      e as (select label, g, (select max((r, v)) from pts q where q.label = g.label and r <= g + 2e-11::double) as a, (select min((r, v)) from pts q where q.label = g.label and r > g + 2e-11::double) as b from g),
      y as (select label, g, case when a is null then b[2] when b is null then a[2] else a[2] + (b[2] - a[2]) * (g - a[1]) / (b[1] - a[1]) end as y from (
        select label, g, case when a is not null then [struct_extract_at(a, 1), struct_extract_at(a, 2)] end as a, case when b is not null then [struct_extract_at(b, 1), struct_extract_at(b, 2)] end as b from e))
      select {_r('g', 'recall')}, {_r('avg(y)', 'precision')}, count(y) as n_labels from y group by g""",
    "sets_quantile_bins": _P + f""", ed as (select list_distinct(quantile_cont(confidence, [{', '.join(f'{i / 100}' for i in range(1, 100))}])) as edges from preds),
      b as (select len(list_filter(edges, lambda e: e <= confidence)) as bin, count(*) as n, count(*) filter (y_true = y_pred) as hit from preds, ed group by 1)
      select cast(bin as integer) as bin, n, {_r('hit / n::double', 'accuracy')}, {_r('sum(hit) over w / (sum(n) over w)::double', 'accuracy_down')}, {_r('sum(n) over w / (sum(n) over ())::double', 'coverage')} from b window w as (order by bin desc)""",
    "sets_top_k": _P + _PROB + f""", ab as (select id, y_true, max(p) filter (label = y_true) as mine from pb group by all),
      rk as (select a.id, a.y_true, count(*) filter (b.p > mine or (b.p = mine and b.label > a.y_true)) as above from ab a join pb b on b.id = a.id where mine is not null group by all),
      cells2 as (select y_true, above as y_pred, count(*) as n from rk group by all), """ + _G[2:].replace("from cells)", "from cells2)").split("  st as")[0].rstrip().rstrip(",") + f"""
      select subset, cast(sum(n) as bigint) as n, {', '.join(_r(f'coalesce(sum(n) filter (y_pred < {k}), 0) / sum(n)::double', f'top{k}') for k in (1, 2, 3))} from sub group by subset""",
    "sets_mixture_shares": _P + _COMP + f""", rows as (select y_true as mixture, y_pred as label, n from cells where y_true in (select mixture from comp) union all select distinct mixture, label, 0 from comp where mixture in (select y_true from cells)),
      s as (select mixture, label, cast(sum(n) as bigint) as n from rows group by all), p as (select *, n / sum(n) over (partition by mixture)::double as share, row_number() over (partition by mixture order by n desc, label) as place from s)
      select p.mixture, p.label, n, {_r('share', 'share')}, cast(place as integer) as place, k is not null as in_set, {_r('coalesce(1.0 / k, 0)', 'expected')} from p left join comp on comp.mixture = p.mixture and comp.label = p.label where place <= 5 or k is not null""",
    "sets_mixture_scores": _P + _COMP + f""", c as (select y_true, y_pred, n, case when exists (select 1 from comp where mixture = y_true and label = y_pred) then n else 0 end as hit from cells where y_true in (select mixture from comp))
      select 'recall' as kind, y_true as name, cast(sum(n) as bigint) as n, {_r('sum(hit) / sum(n)::double', 'score')} from c group by y_true
      union all select 'precision', y_pred, cast(sum(n) as bigint), {_r('sum(hit) / sum(n)::double', 'score')} from c where y_pred in (select label from comp) group by y_pred
      union all select 'overall', 'all', cast(sum(n) as bigint), {_r('sum(hit) / sum(n)::double', 'score')} from c having sum(n) is not null""",
    "sets_repeated_runs": _P + f""", m0 as (select cast(('0x' || substr(md5(id), 1, 6))::bigint % 5 as integer) as run_index, avg(case when y_true = y_pred then 1.0::double else 0 end) as accuracy, avg(confidence) as mean_confidence, count(*)::double as n from preds group by 1),
      m as (select run_index, 'accuracy' as metric, accuracy as value from m0 union all select run_index, 'mean_confidence', mean_confidence from m0 union all select run_index, 'n', n from m0),
      best as (select run_index from m0, (select median(accuracy) as med from m0) order by round(abs(accuracy - med), 12), run_index limit 1)
      select metric, count(*) as n_runs, {_r('avg(value)', 'mean')}, {_r('coalesce(stddev_samp(value), 0)', 'sd')}, {_r('median(value)', 'median')}, {_r('min(value)', 'min')}, {_r('max(value)', 'max')}, any_value(best.run_index) as median_run_index from m, best group by metric""",
    "sets_tests": f"""with t as ({_MW}), q as (select *, {_PVAL} as p from t), k as (select max(p) as lim from (select p, rank() over (order by p desc) as down, count(*) over () as n from q where p is not null) where p <= (n - down + 1)::double / n * 0.05)
      select feature, class, na, nb, u, {_r('z', 'z')}, {_r('p', 'p')}, coalesce(p <= lim, false) as passed from q, k""",
}
