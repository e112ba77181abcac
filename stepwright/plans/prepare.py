"""Queries of the preprocessing chain over peptide_signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preprocess as P
from ..runtime import materialize, ship
from .reach import r6
from .signals import _fin, _long, _r, _reads, _rounded, _series, _X


def _train(spark, d):
    ship(spark)
    return _reads(spark, d)


def prep_train_stats(spark, d):
    return _rounded(P.train_stats(_train(spark, d)))


def _normalised(method: str):
    def query(spark, d):
        reads = _train(spark, d)
        return _long(P.normalise(reads, method, P.train_stats(reads)), F.col("x"))

    return query


prep_mad_local = _normalised("MAD-local")
prep_mad_global = _normalised("MAD-global")
prep_mad_before = _normalised("MAD-before-plr")
prep_range_before = _normalised("min-max-before-plr")
prep_median_before = _normalised("median-before-plr")
prep_range_global = _normalised("minmax-global")
prep_range_decile = _normalised("minmax-decile-median")


def prep_target_lengths(spark, d):
    reads = _train(spark, d)
    rows = [P.target_length(reads, m, fixed=24).withColumn("method", F.lit(m)) for m in P.TARGETS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("method", "target")


def _fitted(mode: str):
    def query(spark, d):
        return P.fit_length(_train(spark, d), 32, mode, -1.0).select("read_id", "kept_length", F.posexplode("x").alias("pos", "v")).withColumn("v", r6(F.col("v")))

    return query


prep_pad_only = _fitted("pad_only")
prep_trim_only = _fitted("trim_only")
prep_strict = _fitted("strict")
prep_resample = _fitted("resample")
prep_resample_if_longer = _fitted("resample_if_longer")
prep_resample_center = _fitted("resample_center")


def prep_chain(spark, d):
    """The chain as the feature models use it: trimmed, by the training median and mad, to the 90th percentile of the lengths."""
    reads = materialize(_train(spark, d).select("read_id", "class", "x", *P.CALIBRATION), "reads")
    out = P.prepare(reads, P.train_stats(reads), "MAD-global", mode="truncate_or_pad")
    return _long(out, F.col("x"))


def prep_steps(spark, d):
    """Reads by what the step filter says, per class."""
    return _rounded(P.step_summary(P.step_verdicts(_train(spark, d), 8.0, 4, 5.0)))


def prep_smoothed(spark, d):
    """The chain with the step filter and smoothing."""
    reads = materialize(_train(spark, d).select("read_id", "class", "x", *P.CALIBRATION), "reads")
    out = P.prepare(reads, None, "MAD-local", step_filter={"least_gain": 8.0, "least_len": 4}, smooth=(0.2, "bessel"), length="median")
    return _long(out, F.col("x"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("prep_") and callable(f)}

_CAL = ", ".join(f"median({_fin(c)}) as {c}" for c in P.CALIBRATION)
_STATS = f"""(select coalesce(global_median, 0) as gm, case when global_mad > 0 then global_mad else 1 end as gk, coalesce(global_median_excl_plr, global_median, 0) as em,
  case when global_mad_excl_plr > 0 then global_mad_excl_plr when global_mad > 0 then global_mad else 1 end as ek, lo, hi, nr, ns, ml from (
  select {_CAL}, count(*) as nr, sum(len(x)) as ns, median(len(x)) filter (len(x) > 0) as ml from (select r.*, s.global_median_excl_plr, s.global_mad_excl_plr from reads r join firsts s on s.read_id = r.read_id and s.k = 1)),
  (select quantile_cont(v, 0.001) as lo, quantile_cont(v, 0.999) as hi from (select unnest(x) as v from reads)))"""
_M = "list_aggregate(x, 'quantile_cont', 0.5)"
_K = f"list_aggregate(list_transform(x, lambda v: abs(v - {_M})), 'quantile_cont', 0.5)"
_ONE = f"(select r.*, t.*, r.median_before_plr as bm, r.mad_before_plr as bk, {_M} as m, {_K} as k0 from reads r, {_STATS} t where len(x) > 0)"
_BOTH = f"({_fin('bm')} is not null and {_fin('bk')} is not null)"
_B, _W = f"(case when {_BOTH} then bm else em end)", f"(case when {_BOTH} then bk else ek end)"


def _clip(lo: str, hi: str) -> str:
    return f"list_transform(x, lambda v: (least(greatest(v, {lo}), {hi}) - {lo}) / ({hi} - {lo} + 1e-12))"


def _parts(fn: str) -> str:
    k, n = "least(10, len(x))", "len(x)"
    start = f"j * ({n} // {k}) + least(j, {n} % {k})"
    return f"list_aggregate(list_transform(generate_series(0, {k} - 1), lambda j: {fn}(x[{start} + 1 : {start} + ({n} // {k}) + (case when j < {n} % {k} then 1 else 0 end)])), 'quantile_cont', 0.5)"


_WIDE = f"greatest({_W}, gk * 1e-4::double)"
_DECILE = f"(select *, case when hi0 - lo0 < 1e-12 then lo0 + greatest(1, abs(lo0) * 1e-3::double) else hi0 end as hi1 from (select *, {_parts('list_min')} as lo0, {_parts('list_max')} as hi0 from reads where len(x) > 0))"


def _fit(where: str) -> str:
    return _X + f"select read_id, cast(len(x) as integer) as kept_length, cast(i - 1 as integer) as pos, round(coalesce(x[i], -1) + 1e-8, 6) as v from reads, (select unnest(generate_series(1, 32)) as i) where {where}"


_TRIM = "(case when 2 * greatest(1, round_even(0.05 * len(x), 0)) >= len(x) then x else x[cast(greatest(1, round_even(0.05 * len(x), 0)) as integer) + 1 : cast(len(x) - greatest(1, round_even(0.05 * len(x), 0)) as integer)] end)"
SQL = {
    "prep_train_stats": _X + f"select nr as n_reads, cast(ns as bigint) as n_samples, {_r('gm', 'global_median')}, {_r('gk', 'global_mad')}, {_r('em', 'global_median_excl_plr')}, {_r('ek', 'global_mad_excl_plr')}, {_r('lo', 'p_lo')}, {_r('hi', 'p_hi')}, cast(floor(ml) as integer) as median_length from {_STATS}",
    "prep_mad_local": _series("list_transform(x, lambda v: (v - m) / (case when k0 > 0 then k0 else 1 end))", _ONE),
    "prep_mad_global": _series("list_transform(x, lambda v: (v - gm) / gk)", _ONE),
    "prep_mad_before": _series(f"list_transform(x, lambda v: (v - {_B}) / (case when {_W} > 0 then {_W} else 1 end))", _ONE),
    "prep_range_before": _series(_clip(f"({_B} - {_WIDE} * 6)", f"({_B} + {_WIDE} * 6)"), _ONE),
    "prep_median_before": _series(f"list_transform(x, lambda v: v - coalesce({_fin('bm')}, em))", _ONE),
    "prep_range_global": _series(_clip("lo", "hi"), _ONE),
    "prep_range_decile": _series(_clip("lo0", "hi1"), _DECILE),
    "prep_target_lengths": _X + """select unnest(['percentile', 'median', 'mean', 'max', 'fixed']) as method, unnest([cast(floor(quantile_cont(len(x), 0.9)) as integer), cast(floor(median(len(x))) as integer), cast(floor(avg(len(x))) as integer), cast(max(len(x)) as integer), 24]) as target from reads""",
    "prep_pad_only": _fit("len(x) <= 32"),
    "prep_trim_only": _fit("len(x) >= 32"),
    "prep_strict": _fit("len(x) = 32"),
    "prep_chain": _X + f""", t as (select read_id, {_TRIM} as y from reads), n as (select cast(floor(quantile_cont(len(y), 0.9)) as integer) as n from t)
      select read_id, cast(i - 1 as integer) as pos, round(coalesce((y[i] - gm) / gk, 0) + 1e-8, 6) as v from t, {_STATS}, n, lateral (select unnest(generate_series(1, n)) as i)""",
}
