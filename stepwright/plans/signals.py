"""Queries over the reads of peptide_signals and their signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import features as X
from ..operators.ranks import group_quantiles, join_groups
from ..sources import signals as S
from ..runtime import ship, table
from .reach import r6


def _reads(spark: SparkSession, d: str, signal: bool = True) -> DataFrame:
    return S.reads_once(table(spark, d, "peptide_signals"), signal)


def _finite(c: str):
    v = F.col(c)
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _long(reads: DataFrame, series) -> DataFrame:
    return reads.select("read_id", F.posexplode(series).alias("pos", "v")).withColumn("v", r6(F.col("v")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def reads_per_class(spark, d):
    return _reads(spark, d, False).groupBy("class").agg(F.count("*").alias("n_reads"), F.countDistinct("run_name").alias("n_runs"))


def reads_spanning(spark, d):
    return S.spanning(_reads(spark, d, False)).select("read_id", "class", "ref_start", "ref_end")


def reads_funnel(spark, d):
    """Reads by verdict with their share of all: what each check takes, in order, and those that pass."""
    n, span = F.size("x"), F.col("ref_end") - F.col("ref_start")
    verdict = (
        F.when(n == 0, "signal-missing")
        .when(n < 20, "signal-short")
        .when(_finite("global_median").isNull() | _finite("global_mad").isNull(), "uncalibrated")
        .when(_finite("global_mad") <= 0, "no-spread")
        .when(span < 45, "span-short")
        .otherwise("valid")
    )
    reads = _reads(spark, d).select(verdict.alias("verdict"))
    counts = reads.groupBy("verdict").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("verdict", "n", F.format_string("%.2f%%", F.col("n") * 100.0 / F.col("total")).alias("percentage"))


def reads_length_stats(spark, d):
    n = F.size("x")
    q = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    out = _reads(spark, d).groupBy("class").agg(F.count("*").alias("n_reads"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean"), *[F.percentile(n, p).alias(c) for c, p in q.items()])
    return _rounded(out)


def reads_run_stats(spark, d):
    """Robust statistics of the calibrated reads of each run."""
    reads = _reads(spark, d, False).select("run_name", _finite("global_median").alias("med"), _finite("global_mad").alias("dev"))
    base = reads.groupBy("run_name").agg(F.count("*").alias("n_reads"), F.count("med").alias("n_calibrated"), F.min("med").alias("least"), F.max("med").alias("greatest"))
    out = base
    for col, name in (("med", "median"), ("dev", "mad")):
        out = join_groups(out, group_quantiles(reads, ["run_name"], col, {name: 0.5}), ["run_name"], "left")
    return _rounded(out)


def reads_train_stats(spark, d):
    """Statistics of the pooled samples of all reads: of the training data's normalisation."""
    v = _reads(spark, d).select(F.explode("x").alias("v"))
    ends = v.agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    places = group_quantiles(v, [], "v", {"median": 0.5, "p0_1": 0.001, "p1": 0.01, "p99": 0.99, "p99_9": 0.999})
    return _rounded(ends.crossJoin(F.broadcast(places)))


def reads_histogram(spark, d):
    """Samples per class in 30 bins over the pooled 1st to 99th percentile; values beyond are left out."""
    v = _reads(spark, d).select("class", F.explode("x").alias("v"))
    edge = group_quantiles(v, [], "v", {"low": 0.01, "high": 0.99})
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    b = F.least(F.floor((F.col("v") - F.col("low")) * 30 / width), F.lit(29))
    return v.crossJoin(F.broadcast(edge)).where("v between low and high").groupBy("class", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def reads_round_trip(spark, d):
    """Signals written as text and parsed again: the number of samples and their sum before and after."""
    back = _reads(spark, d).withColumn("y", S.parse_signal(S.format_signal(F.col("x"))))
    return back.select("read_id", F.size("x").alias("n"), F.size("y").alias("n_back"), r6(A.a_sum(F.col("x"))).alias("total"), r6(A.a_sum(F.col("y"))).alias("total_back"))


def array_diff(spark, d):
    return _long(_reads(spark, d), A.a_diff(F.col("x")))


def array_second_diff(spark, d):
    return _long(_reads(spark, d).withColumn("dx", A.a_diff(F.col("x"))), A.a_diff(F.col("dx")))


def array_moving_mean(spark, d):
    return _long(_reads(spark, d), A.moving_mean(F.col("x"), 5))


def array_moving_mean_valid(spark, d):
    return _long(_reads(spark, d), A.moving_mean_valid(F.col("x"), 5))


def array_edge_trim(spark, d):
    return _long(_reads(spark, d), A.edge_trim(F.col("x"), 0.05))


def array_scale_mad(spark, d):
    r = _reads(spark, d).withColumn("m", A.a_median(F.col("x"))).withColumn("k", A.a_mad(F.col("x"), F.col("m")))
    return _long(r, A.scale_mad(F.col("x"), F.col("m"), F.col("k")))


def array_scale_before(spark, d):
    """By median and mad before the region, where both are known; the rest by those of the whole read."""
    med = F.coalesce(_finite("median_before_plr"), _finite("global_median"), F.lit(0.0))
    mad = F.coalesce(_finite("mad_before_plr"), _finite("global_mad"), F.lit(1.0))
    return _long(_reads(spark, d), A.scale_before(F.col("x"), med, mad, F.lit(0.001)))


def array_scale_range(spark, d):
    r = _reads(spark, d).withColumn("s", F.array_sort("x"))
    return _long(r, A.scale_range(F.col("x"), A.q_floor(F.col("s"), 0.1), A.q_floor(F.col("s"), 0.9)))


def array_resample(spark, d):
    return _long(_reads(spark, d), A.resample_lerp(F.col("x"), 16))


def array_block_means(spark, d):
    return _long(_reads(spark, d), A.block_means(F.col("x"), 4))


def array_pad_or_cut(spark, d):
    return _long(_reads(spark, d), A.pad_or_cut(F.col("x"), 32))


def array_without_zeros(spark, d):
    """Samples in whole units over the read's least, without the zeros among them."""
    r = _reads(spark, d).withColumn("least", F.array_min("x"))
    return _long(r, A.without(F.transform("x", lambda v: F.floor(v - F.col("least")).cast("double"))))


def array_trim_trailing(spark, d):
    return _long(_reads(spark, d), A.trim_trailing(A.pad_or_cut(F.col("x"), 40)))


def array_filled_islands(spark, d):
    """Stretches below the read's median after gaps of up to two samples are filled."""
    r = _reads(spark, d).withColumn("m", A.a_median(F.col("x"))).withColumn("low", F.transform("x", lambda v: v < F.col("m")))
    r = r.withColumn("low", A.fill_gaps(F.col("low"), 2))
    return r.select("read_id", F.explode(A.islands(F.col("low"))).alias("i")).select("read_id", "i.s", "i.e")


def array_prefix_sums(spark, d):
    ship(spark)
    return _long(_reads(spark, d), A.prefix_sums(F.col("x")))


def array_low_islands(spark, d):
    """Stretches of samples below the read's median: gaps and islands on an array."""
    r = _reads(spark, d).withColumn("m", A.a_median(F.col("x")))
    return r.select("read_id", F.explode(A.islands(F.transform("x", lambda v: v < F.col("m")))).alias("i")).select("read_id", "i.s", "i.e")


def _features(*blocks):
    def query(spark, d):
        ship(spark)
        return _rounded(X.frame(_reads(spark, d), list(blocks)))

    return query


feature_basic = _features("basic")
feature_low = _features("low")
feature_slopes = _features("slopes")
feature_second_slopes = _features("second_slopes")
feature_rolling_slopes = _features(X.rolling_slopes(10))
feature_energy_trend = _features("energy_trend")
feature_rhythm = _features("rhythm")
feature_zero_lag = _features("zero_lag")
feature_multiscale = _features("multiscale")
feature_peaks = _features("peaks")
feature_drop = _features("drop")
feature_steps = _features("steps")
feature_spectral = _features(X.spectral())
feature_spectral_whole = _features(X.spectral(False))
feature_frame_all = _features(*[k for k in X.BLOCKS if k != "steps"])

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith(("reads_", "array_", "feature_")) and callable(f)}

_X = """with firsts as (
  select *, row_number() over (partition by read_id order by received_at, run_name nulls first, class nulls first) as k from peptide_signals where read_id is not null),
reads as (
  select read_id, run_name, class, ref_start, ref_end, global_median, global_mad, median_before_plr, mad_before_plr,
    list_filter(list_transform(list_filter(regexp_split_to_array(trim(coalesce(signal, ''), ' ' || chr(9) || chr(10) || chr(13)), '\\s+'), lambda w: w <> ''),
      lambda w: try_cast(w as double)), lambda v: v is not null and isfinite(v)) as x
  from firsts where k = 1)
"""


def _fin(c: str) -> str:
    return f"case when isfinite({c}) then {c} end"


def _series(expr: str, pre: str = "reads") -> str:
    return _X + f"""select read_id, cast(i - 1 as integer) as pos, round(y[i] + 1e-8, 6) as v from (select read_id, {expr} as y from {pre}), lateral (select unnest(generate_series(1, len(y))) as i)"""


_D = "(case when len(x) > 1 then list_transform(generate_series(2, len(x)), lambda i: x[i] - x[i - 1]) else [] end)"
_MED = "(case when len(x) > 0 then list_aggregate(x, 'quantile_cont', 0.5) end)"
_ST = _X + f""", st as (select *, len(x) as n, list_avg(x) as mean, sqrt(list_avg(list_transform(x, lambda v: (v - list_avg(x)) * (v - list_avg(x))))) as std, list_sort(x) as s, {_D} as d from reads where len(x) > 0)
"""


def _q(c: str, p: float) -> str:
    return f"list_aggregate({c}, 'quantile_cont', {p})"


def _r(e: str, name: str) -> str:
    return f"round({e} + 1e-8, 6) as {name}"


SQL = {
    "reads_per_class": _X + "select class, count(*) as n_reads, count(distinct run_name) as n_runs from reads group by class",
    "reads_spanning": _X + "select read_id, class, ref_start, ref_end from reads where ref_start <= 30 and ref_end >= 110",
    "reads_funnel": _X + f"""select verdict, count(*) as n, printf('%.2f%%', count(*) * 100.0 / sum(count(*)) over ()) as percentage from (
      select case when len(x) = 0 then 'signal-missing' when len(x) < 20 then 'signal-short'
        when {_fin('global_median')} is null or {_fin('global_mad')} is null then 'uncalibrated' when {_fin('global_mad')} <= 0 then 'no-spread'
        when ref_end - ref_start < 45 then 'span-short' else 'valid' end as verdict from reads) group by verdict""",
    "reads_length_stats": _X + "select class, count(*) as n_reads, cast(min(len(x)) as integer) as shortest, cast(max(len(x)) as integer) as longest, " + _r("avg(len(x))", "mean") + ", " + ", ".join(_r(f"quantile_cont(len(x), {p})", c) for c, p in (("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))) + " from reads group by class",
    "reads_run_stats": _X + f"select run_name, count(*) as n_reads, count({_fin('global_median')}) as n_calibrated, {_r('median(' + _fin('global_median') + ')', 'median')}, {_r('median(' + _fin('global_mad') + ')', 'mad')}, {_r('min(' + _fin('global_median') + ')', 'least')}, {_r('max(' + _fin('global_median') + ')', 'greatest')} from reads group by run_name",
    "reads_train_stats": _X + ", v as (select unnest(x) as v from reads) select count(*) as n, " + ", ".join(_r(f"quantile_cont(v, {p})", c) for c, p in (("median", 0.5), ("p0_1", 0.001), ("p1", 0.01), ("p99", 0.99), ("p99_9", 0.999))) + ", " + _r("min(v)", "least") + ", " + _r("max(v)", "greatest") + " from v",
    "reads_histogram": _X + """, v as (select class, unnest(x) as v from reads), edge as (select quantile_cont(v, 0.01) as low, quantile_cont(v, 0.99) as high from v)
      select class, cast(least(floor((v - low) * 30 / nullif(high - low, 0)), 29) as integer) as bin, count(*) as n from v, edge where v between low and high group by all""",
    "reads_round_trip": _X + "select read_id, cast(len(x) as integer) as n, cast(len(x) as integer) as n_back, " + _r("coalesce(list_sum(x), 0)", "total") + ", " + _r("coalesce(list_sum(x), 0)", "total_back") + " from reads",
    "array_diff": _series(_D),
    "array_second_diff": _series("(case when len(x) > 2 then list_transform(generate_series(3, len(x)), lambda i: (x[i] - x[i - 1]) - (x[i - 1] - x[i - 2])) else [] end)"),
    "array_moving_mean": _series("list_transform(generate_series(1, len(x)), lambda i: (x[greatest(i - 2, 1)] + x[greatest(i - 1, 1)] + x[i] + x[least(i + 1, len(x))] + x[least(i + 2, len(x))]) / 5)"),
    "array_moving_mean_valid": _series("list_transform(generate_series(1, len(x) - 4), lambda i: (x[i] + x[i + 1] + x[i + 2] + x[i + 3] + x[i + 4]) / 5)"),
    "array_edge_trim": _series("(case when 2 * greatest(1, round_even(0.05 * len(x), 0)) >= len(x) then x else x[cast(greatest(1, round_even(0.05 * len(x), 0)) as integer) + 1 : cast(len(x) - greatest(1, round_even(0.05 * len(x), 0)) as integer)] end)"),
    "array_scale_mad": _series("list_transform(x, lambda v: (v - m) / (case when k > 0 then k else 1 end))", f"(select *, list_aggregate(list_transform(x, lambda v: abs(v - m)), 'quantile_cont', 0.5) as k from (select *, {_MED} as m from reads))"),
    "array_scale_before": _series("list_transform(x, lambda v: least(greatest((v - (m - k * 6)) / (k * 12), 0), 1))", f"(select *, coalesce({_fin('median_before_plr')}, {_fin('global_median')}, 0) as m, greatest(coalesce({_fin('mad_before_plr')}, {_fin('global_mad')}, 1), 0.001) as k from reads)"),
    "array_scale_range": _series("list_transform(x, lambda v: case when hi > lo then least(greatest((v - lo) / (hi - lo), 0), 1) else 0 end)", "(select *, s[cast(floor(0.1 * (len(s) - 1)) as integer) + 1] as lo, s[cast(floor(0.9 * (len(s) - 1)) as integer) + 1] as hi from (select *, list_sort(x) as s from reads) where len(x) > 0)"),
    "array_resample": _series("list_transform(generate_series(0, 15), lambda i: x[least(cast(floor(i * ((len(x) - 1) / 15.0::double)) as integer), len(x) - 1) + 1] + (x[least(least(cast(floor(i * ((len(x) - 1) / 15.0::double)) as integer), len(x) - 1) + 1, len(x) - 1) + 1] - x[least(cast(floor(i * ((len(x) - 1) / 15.0::double)) as integer), len(x) - 1) + 1]) * (i * ((len(x) - 1) / 15.0::double) - least(cast(floor(i * ((len(x) - 1) / 15.0::double)) as integer), len(x) - 1)))", "(select * from reads where len(x) > 0)"),
    "array_block_means": _series("list_transform(generate_series(0, len(x) // 4 - 1), lambda i: (x[i * 4 + 1] + x[i * 4 + 2] + x[i * 4 + 3] + x[i * 4 + 4]) / 4)"),
    "array_pad_or_cut": _series("list_transform(generate_series(1, 32), lambda i: coalesce(x[i], 0))"),
    "array_prefix_sums": _series("list_transform(generate_series(1, len(x)), lambda i: list_sum(x[1:i]))"),
    "array_without_zeros": _series("list_filter(list_transform(x, lambda v: floor(v - list_min(x))), lambda v: v <> 0)"),
    "array_trim_trailing": _series("(select x[1 : coalesce(list_max(list_filter(generate_series(1, least(len(x), 40)), lambda i: x[i] <> 0)), 0)])"),
    "array_filled_islands": _X + f""", m as (select read_id, x, {_MED} as m from reads), p as (select read_id, i - 1 as i, x[i] < m as low from m, lateral (select unnest(generate_series(1, len(x))) as i)),
      g as (select *, i - row_number() over (partition by read_id, low order by i) as g from p), k as (select read_id, i, low or count(*) over (partition by read_id, low, g) <= 2 as low from g),
      h as (select read_id, i, i - row_number() over (partition by read_id order by i) as h from k where low)
      select read_id, cast(min(i) as integer) as s, cast(max(i) + 1 as integer) as e from h group by read_id, h""",
    "array_low_islands": _X + f""", m as (select read_id, x, {_MED} as m from reads), p as (select read_id, i - 1 as i, x[i] < m as low from m, lateral (select unnest(generate_series(1, len(x))) as i)),
      g as (select read_id, i, i - row_number() over (partition by read_id order by i) as g from p where low)
      select read_id, cast(min(i) as integer) as s, cast(max(i) + 1 as integer) as e from g group by read_id, g""",
}


def _f(c: str, p: float) -> str:
    """The order statistic of a list."""
    return f"list_sort({c})[cast(floor({p}::double * (len({c}) - 1)) as integer) + 1]"


def _dev(c: str, about: str) -> str:
    return f"sqrt(list_avg(list_transform({c}, lambda v: (v - {about}) * (v - {about}))))"


def _abs(c: str) -> str:
    return f"list_transform({c}, lambda v: abs(v))"


_DD = "(case when len(d) > 1 then list_transform(generate_series(2, len(d)), lambda i: d[i] - d[i - 1]) else [] end)"
_Q = {f"q{k}": _f("x", k / 100) for k in (10, 25, 40, 60, 75, 90)}
_MAD = "list_avg(list_transform(x, lambda v: abs(v - mean)))"
_TRIM = "list_sort(x)[cast(floor(n * 0.1::double) as integer) + 1 : cast(ceil(n * 0.9::double) as integer)]"
_MIDDLE = f"list_filter(x, lambda v: v >= {_Q['q25']} and v <= {_Q['q75']})"


def _moments(c: str, mean: str, std: str) -> dict[str, str]:
    m = lambda k: f"list_avg(list_transform({c}, lambda v: pow(v - {mean}, {k})))"
    return {"skew": f"case when {std} > 1e-12 then {m(3)} / pow({std}, 3) end", "kurtosis": f"case when {std} > 1e-12 then {m(4)} / pow({std}, 4) - 3 end"}


_ALL = _moments("x", "mean", "std")
_LOWS = _moments("lo", "list_avg(lo)", "lo_std")


def _diffs(c: str, name: str, total: str) -> dict[str, str]:
    parts = {f"mean_{name}": f"list_avg({c})", f"median_{name}": _q(c, 0.5), f"std_{name}": _dev(c, f"list_avg({c})"), f"max_{name}": f"list_max({c})", f"min_{name}": f"list_min({c})", f"avg_abs_{name}": f"list_avg({_abs(c)})", **{f"{name}_q{k}": _f(c, k / 100) for k in (10, 25, 40, 60, 75, 90)}, total: f"list_sum({_abs(c)})"}
    return {k: f"coalesce({v}, 0)" for k, v in parts.items()}


def _crossings(level: str) -> str:
    return f"len(list_filter(generate_series(1, n - 1), lambda i: (x[i] > {level}) <> (x[i + 1] > {level}))) / greatest(n - 1, 1)::double"


def _scale(k: int) -> dict[str, str]:
    y = f"y{k}"
    pairs = f"generate_series(1, len({y}) - 1)"
    return {
        f"ms{k}_std": _dev(y, f"list_avg({y})"), f"ms{k}_iqr": f"{_q(y, 0.75)} - {_q(y, 0.25)}", f"ms{k}_tv_mean": f"coalesce(list_avg(list_transform({pairs}, lambda i: abs({y}[i + 1] - {y}[i]))), 0)",
        f"ms{k}_ac1": f"coalesce(list_sum(list_transform({pairs}, lambda i: ({y}[i] - list_avg({y})) * ({y}[i + 1] - list_avg({y})))) / (case when list_sum(list_transform({y}, lambda v: (v - list_avg({y})) * (v - list_avg({y})))) > 1e-18 then list_sum(list_transform({y}, lambda v: (v - list_avg({y})) * (v - list_avg({y})))) end), 0)",
        f"ms{k}_zcr": f"len(list_filter({pairs}, lambda i: {y}[i] * {y}[i + 1] < 0)) / greatest(len({y}) - 1, 1)::double",
    }


_POOLED = ", ".join(f"case when n // {k} > 0 then list_transform(generate_series(0, n // {k} - 1), lambda i: list_avg(x[i * {k} + 1 : (i + 1) * {k}])) else x end as y{k}" for k in (4, 8, 16, 32))
_WITH = _ST + f""", dd as (select *, {_DD} as dd from st), lo as (select *, {_dev('lo', 'list_avg(lo)')} as lo_std from (select *, list_filter(x, lambda v: v <= 0) as lo from st)),
  tr as (select *, (list_sum(list_transform(x, lambda v, i: v * (i - 1))) / n - mean * (n - 1) / 2.0) / nullif((n * n - 1) / 12.0::double, 0) as b from st),
  hj as (select *, std * std as va, coalesce(pow({_dev('d', 'list_avg(d)')}, 2), 0) as vd, coalesce(pow({_dev('dd', 'list_avg(dd)')}, 2), 0) as vdd from dd),
  ms as (select *, {_POOLED} from st),
  lg as (select *, list_filter(generate_series(1, n - 1), lambda k: list_sum(list_transform(generate_series(1, n - k), lambda i: (x[i] - mean) * (x[i + k] - mean))) <= 1e-12 * std * std * n) as lags from st),
  pos as (select read_id, i, x[i] as v from st, lateral (select unnest(generate_series(1, len(x))) as i)),
  runs as (select read_id, any_value(v) as v, min(i) - 1 as s, max(i) - 1 as e from (select *, sum(new) over (partition by read_id order by i) as g from (select *, case when v = lag(v) over (partition by read_id order by i) then 0 else 1 end as new from pos)) group by read_id, g),
  near as (select *, lag(v) over w as p, lead(v) over w as q, (s + e) // 2 as mid from runs window w as (partition by read_id order by s)),
  ups as (select *, mid - lag(mid) over (partition by read_id order by mid) as gap from near where v > p and v > q), downs as (select * from near where v < p and v < q),
  pk as (select st.*, med, u.*, w.* from (select *, list_aggregate(x, 'quantile_cont', 0.5) as med from st) st
    left join (select read_id as r1, count(*) as nu, avg(v) as vu, list(gap::double) filter (gap is not null) as gaps from ups group by all) u on r1 = read_id
    left join (select read_id as r2, count(*) as nd, avg(v) as vd from downs group by all) w on r2 = read_id),
  roll as (select read_id, list(b order by i) filter (c = 10 and k > 1e-12) as r from (select read_id, i, regr_slope(v, i) over w as b, var_pop(v) over w as k, count(*) over w as c from pos window w as (partition by read_id order by i rows between current row and 9 following)) group by read_id),
  roll100 as (select read_id, list(b order by i) filter (c = 100 and k > 1e-12) as r from (select read_id, i, regr_slope(v, i) over w as b, var_pop(v) over w as k, count(*) over w as c from pos window w as (partition by read_id order by i rows between current row and 99 following)) group by read_id),
  dr0 as (select *, list_position(d, list_min(d)) as a from st where n > 1),
  dr1 as (select *, list_aggregate(x[greatest(a - 29, 1) : a], 'quantile_cont', 0.5) as before, list_min(x[a + 1 : a + 30]) as after from dr0),
  dr as (select *, coalesce(list_filter(generate_series(a + 1, n), lambda i: x[i] > before - 0.25::double * (before - after))[1] - a - 1, n - a) as stay from dr1)
"""
_AREA = "coalesce(list_sum(list_transform(x[a + 1 : a + stay], lambda v: before - v)), 0)"
_BLOCKS = {
    "feature_basic": ("st", {"length": "cast(n as integer)", "min": "list_min(x)", "max": "list_max(x)", "mean": "mean", "median": _q("x", 0.5), **_Q, "iqr": f"{_Q['q75']} - {_Q['q25']}", "range": "list_max(x) - list_min(x)", "idl": f"{_Q['q90']} - {_Q['q10']}", "idl_60_40": f"{_Q['q60']} - {_Q['q40']}", "midhinge": f"({_Q['q25']} + {_Q['q75']}) / 2", "trimean": f"({_Q['q25']} + 2 * {_q('x', 0.5)} + {_Q['q75']}) / 4", "interquartile_mean": f"list_avg({_MIDDLE})", "MAD": _MAD, "normalized_MAD": f"{_MAD} / (abs({_q('x', 0.5)}) + 1e-12)", "MAD_over_IQR": f"{_MAD} / ({_Q['q75']} - {_Q['q25']} + 1e-12)", "trimmed_MAD": f"case when n > 10 then list_aggregate(list_transform({_TRIM}, lambda v: abs(v - {_q(_TRIM, 0.5)})), 'quantile_cont', 0.5) else {_MAD} end", "coef_var": "std / (abs(mean) + 1e-12)", "std_all": "std", "skew_all": _ALL["skew"], "kurtosis_all": _ALL["kurtosis"]}),
    "feature_low": ("lo", {"low_std": "lo_std", "low_skew": _LOWS["skew"], "low_kurtosis": _LOWS["kurtosis"], "length_th": "cast(len(lo) as integer)"}),
    "feature_slopes": ("st", _diffs("d", "slope", "total_variation")),
    "feature_second_slopes": ("dd", _diffs("dd", "second_slope", "second_total_variation")),
    "feature_rolling_slopes": ("roll", {k: f"coalesce({v}, 0)" for k, v in {"median_rolling_slope": _q("r", 0.5), "rolling_slope_q60": _q("r", 0.6), "std_rolling_slope": _dev("r", "list_avg(r)"), "mean_rolling_slope": "list_avg(r)", "max_rolling_slope": "list_max(r)", "min_rolling_slope": "list_min(r)", "avg_abs_rolling_slope": f"list_avg({_abs('r')})", "rolling_slope_q25": _q("r", 0.25), "rolling_slope_q75": _q("r", 0.75)}.items()}),
    "feature_energy_trend": ("tr", {"energy": "list_sum(list_transform(x, lambda v: v * v))", "rms": "sqrt(list_sum(list_transform(x, lambda v: v * v)) / n)", "auc": "list_sum(x)", "abs_auc": f"list_sum({_abs('x')})", "trend_slope": "b", "trend_intercept": "mean - b * (n - 1) / 2.0", "detrended_std": "case when b is not null then sqrt(greatest(std * std - b * b * ((n * n - 1) / 12.0::double), 0)) end"}),
    "feature_rhythm": ("hj", {"zcr": "len(list_filter(generate_series(1, n - 1), lambda i: x[i] * x[i + 1] < 0)) / greatest(n - 1, 1)::double", "ac_lag1": "case when va > 1e-12 then coalesce(list_sum(list_transform(generate_series(1, n - 1), lambda i: (x[i] - mean) * (x[i + 1] - mean))), 0) / (va * n) else 0 end", "hjorth_activity": "va", "hjorth_mobility": "sqrt(vd / (va + 1e-12))", "hjorth_complexity": "sqrt(vdd / (vd + 1e-12)) / (sqrt(vd / (va + 1e-12)) + 1e-12)", **{f"cross_rate_q{k}": _crossings(_q("x", k / 100)) for k in (10, 25, 50, 75, 90)}}),
    "feature_zero_lag": ("lg", {"ac_zero_cross_lag": "cast(case when n < 2 or std = 0 then 0 else coalesce(list_min(lags), n - 1) end as double)"}),
    "feature_multiscale": ("ms", {k: v for s in (4, 8, 16, 32) for k, v in _scale(s).items()}),
    "feature_peaks": ("pk", {"n_peaks": "coalesce(nu, 0)::double", "mean_peak_val": "coalesce(vu, 0)", "mean_peak_prom": "coalesce(vu - med, 0)", "mean_peak_dist": "list_avg(gaps)", "median_peak_dist": _q("gaps", 0.5), "peak_dist_q10": _f("gaps", 0.1), "peak_dist_q90": _f("gaps", 0.9), "n_troughs": "coalesce(nd, 0)::double", "mean_trough_val": "coalesce(vd, 0)", "mean_trough_prom": "coalesce(med - vd, 0)"}),
    "feature_drop": ("(select read_id, n, x, a, before, after, stay from dr union all select read_id, n, x, 0, x[1], x[1], 0 from st where n = 1)", {"drop_idx": "(a - 1)::double", "drop_pre_mean": "before", "drop_post_min": "after", "drop_depth": "before - after", "drop_duration": "stay::double", "drop_auc": _AREA, "drop_auc_norm": f"{_AREA} / (list_sum({_abs('x')}) + 1e-12)"}),
}
_COUNTS = ("length", "length_th")


def _select(name: str, table: str = "") -> str:
    source, parts = _BLOCKS[name]
    cells = [f'{v} as "{k}"' if k in _COUNTS else f'round({v} + 1e-8, 6) as "{k}"' for k, v in parts.items()]
    return "select read_id, " + ", ".join(cells) + f" from {table or source}"


SQL.update({k: _WITH + _select(k) for k in _BLOCKS})
_FRAME = [_select(k, "roll100" if k == "feature_rolling_slopes" else "") for k in _BLOCKS]
SQL["feature_frame_all"] = _WITH + "select * from " + " join ".join(f"({q}) t{i}" + (" using (read_id)" if i else "") for i, q in enumerate(_FRAME))

# The transform as it is written down: a sum of cosines and sines per frequency.
SQL["feature_spectral_whole"] = _ST + f""", ct as (select read_id, n, list_transform(x, lambda v: v - mean) as y from st),
  sp as (select read_id, n, y, list_transform(generate_series(0, n // 2), lambda k: sqrt(pow(list_sum(list_transform(generate_series(1, n), lambda i: y[i] * cos(2 * pi() * k * (i - 1) / n))), 2) + pow(list_sum(list_transform(generate_series(1, n), lambda i: y[i] * sin(2 * pi() * k * (i - 1) / n))), 2))) as m from ct),
  ce as (select *, list_sum(m) as total, list_sum(list_transform(m, lambda v, k: v * (k - 1) / n::double)) / nullif(list_sum(m), 0) as c, list_transform(m, lambda v: v / nullif(list_sum(m), 0) + 1e-12::double) as p, list_sum(list_transform(y, lambda v: v * v)) <= 1e-18 as flat from sp)
  select read_id, {_r('case when flat then 0 else list_sum(list_transform(m, lambda v: v * v)) end', 'total_power')}, {_r('case when flat then 0 else c end', 'spectral_centroid')},
    {_r('case when flat then 0 else sqrt(list_sum(list_transform(m, lambda v, k: pow((k - 1) / n::double - c, 2) * v)) / total) end', 'spectral_bandwidth')},
    {_r('case when flat then 0 else -list_sum(list_transform(p, lambda v: v / list_sum(p) * ln(v / list_sum(p)))) end', 'spectral_entropy')},
    {_r('case when flat then 0 else (list_position(list_transform(m, lambda v: round(v, 9)), list_max(list_transform(m, lambda v: round(v, 9)))) - 1) / n::double end', 'dominant_freq')} from ce"""
