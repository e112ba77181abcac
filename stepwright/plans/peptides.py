"""Queries of peptides: scores and features of the classes against the properties of their residues, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peptides as B
from ..operators import physchem as P
from ..operators.stats import anova, long_features
from ..runtime import materialize, table
from .evaluation import _F, _P, FEATURES, _r, features, predictions
from .evaluation import _rounded
from .models import _LETTERS, _MINUS, _PLUS, _SEQ, _case, _n

#: Features that are compared with properties: those whose means differ most between classes.
TOP = 3


def _metrics(spark, d):
    part = F.pmod(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("int"), F.lit(5))
    return B.scenario_metrics(predictions(spark, d).withColumn("scenario", part.cast("string")))


def _performance(spark, d):
    counts = table(spark, d, "templaterc").where("class is not null").groupBy("class").agg(F.count("*").alias("total_count"))
    return B.performance_table(_metrics(spark, d), counts)


def peptide_scenario_metrics(spark, d):
    """Scores of every class in five parts of the reads as if each were a scenario of its own."""
    return _rounded(_metrics(spark, d))


def peptide_performance(spark, d):
    return _rounded(_performance(spark, d))


def peptide_performance_correlations(spark, d):
    rows = materialize(_rounded(_performance(spark, d)), "performance")
    return _rounded(B.correlation_table(rows, ["precision", "recall", "log_count"], B.PROPERTIES))


def peptide_feature_medians(spark, d):
    return _rounded(B.feature_medians(features(spark, d), FEATURES))


def peptide_feature_correlations(spark, d):
    """The features that tell classes apart best against the properties, over the classes' medians."""
    frame = materialize(features(spark, d), "features")
    f = anova(long_features(frame.where("class is not null"), ["class"], FEATURES)).orderBy(F.desc("f"), "feature").limit(TOP)
    top = [r["feature"] for r in f.collect()]
    rows = materialize(_rounded(B.feature_medians(frame, top)), "medians")
    return _rounded(B.correlation_table(rows, top, B.PROPERTIES))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("peptide_") and callable(f)}

_PROPS = f"""select class, cast({_n(_LETTERS)} as double) as length,
    {_r(f"list_sum(list_transform({_SEQ}, lambda r: cast({_case(P.HYDROPATHY)} as double))) / nullif({_n(_LETTERS)}, 0)", 'mean_hydropathy')},
    {_r(f"list_sum(list_transform({_SEQ}, lambda r: cast({_case(P.MASS)} as double)))", 'mass')},
    {_r(f"({_PLUS}) - ({_MINUS})", 'net_charge')}, {_r(f"{_n('FWY')} / cast({_n(_LETTERS)} as double)", 'aromatic_share')}
    from (select distinct class from base) where {_n(_LETTERS)} > 0"""
_SCEN = _P + """, cs as (select cast(('0x' || substring(md5(id), 1, 6))::bigint % 5 as varchar) as scenario, y_true, y_pred, count(*) as n from preds group by all),
  ct as (select scenario, y_true as class, sum(n) as support, coalesce(sum(n) filter (y_true = y_pred), 0) as tp from cs group by all),
  cp as (select scenario, y_pred as class, sum(n) as predicted from cs group by all),
  sm as (select scenario, class, coalesce(tp / nullif(predicted, 0)::double, 0) as precision, tp / support::double as recall, 2.0::double * tp / (coalesce(predicted, 0) + support)::double as f1, support::double as support from ct left join cp using (scenario, class)),
  base as (select class, median(precision) as precision, median(recall) as recall, median(f1) as f1, median(support) as support from sm group by class)"""
_PERF = _SCEN + f""", props as ({_PROPS}), perf as (select b.class, {', '.join(_r(c, c) for c in B.METRICS)}, coalesce(total_count, 0) as total_count, {_r('log10(coalesce(total_count, 0) + 1.0::double)', 'log_count')}, {', '.join(B.PROPERTIES)}
  from base b left join (select class, count(*) as total_count from templaterc where class is not null group by 1) t on t.class = b.class left join props p on p.class = b.class)"""
_MEDS = _F + ", base as (select class, " + ", ".join(f"median({c}) filter (isfinite({c})) as {c}" for c in FEATURES) + f""" from f where class is not null group by class having {' or '.join(f"count(*) filter (isfinite({c})) > 0" for c in FEATURES)}),
  props as ({_PROPS}), meds as (select b.class, {', '.join(_r(c, c) for c in FEATURES)}, {', '.join(B.PROPERTIES)} from base b left join props p on p.class = b.class)"""


def _rho(pairs: str) -> str:
    """Rank correlations of pairs (a, b, x, y), with p by the closed form of the same series in gamma functions."""
    c2 = "(1 - rho * rho)"
    even = f"abs(rho) * list_sum(list_transform(generate_series(0, cast(n // 2 - 2 as bigint)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow({c2}, k)))"
    odd = f"2 / pi() * (asin(least(abs(rho), 1)) + abs(rho) * coalesce(list_sum(list_transform(generate_series(0, cast((n - 5) // 2 as bigint)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow({c2}, k + 0.5))), 0))"
    return f""", pairs as ({pairs}),
      ranked as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as rx, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as ry from pairs where x is not null and y is not null),
      rho as (select a, b, count(*) as n, case when count(*) >= 3 and var_pop(rx) > 0 and var_pop(ry) > 0 then corr(rx, ry) end as rho from ranked group by a, b),
      ps as (select *, case when rho is not null then round(greatest(1 - (case when n % 2 = 0 then {even} when n = 3 then 2 / pi() * asin(least(abs(rho), 1)) else {odd} end), 0) + 1e-8, 6) end as p from rho),
      lim as (select max(p) as lim from (select p, rank() over (order by p desc) as down, count(*) over () as m from ps where p is not null) where p <= (m - down + 1)::double / m * 0.05)
      select a, b, n, {_r('rho', 'rho')}, {_r('p', 'p')}, coalesce(p <= lim, false) as passed from ps, lim"""


_TOP = f", top as (select feature from (select feature, row_number() over (order by f desc, feature) as k from (select feature, (sum(n * pow(m - grand, 2)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*))) as f from (select feature, class, count(*) as n, avg(v) as m, var_pop(v) as vp from long where class is not null group by all) join (select feature, avg(v) as grand from long where class is not null group by 1) using (feature) group by feature)) where k <= {TOP})"

SQL = {
    "peptide_scenario_metrics": _SCEN + f" select scenario, class, {', '.join(_r(c, c) for c in B.METRICS)} from sm",
    "peptide_performance": _PERF + " select * from perf",
    "peptide_performance_correlations": _PERF + _rho(" union all ".join(f"select '{a}' as a, '{b}' as b, {a} as x, {b} as y from perf" for a in ("precision", "recall", "log_count") for b in B.PROPERTIES)),
    "peptide_feature_medians": _MEDS + " select * from meds",
    "peptide_feature_correlations": _MEDS + _TOP + _rho("select * from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, {a} as x, {b} as y from meds" for a in FEATURES for b in B.PROPERTIES) + ") where a in (select feature from top)"),
}
