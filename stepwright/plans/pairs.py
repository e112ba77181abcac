"""Queries of distances between reads of a bounded sample per class, and to templates, with SQL for the straight distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import distance as D
from ..operators import distance_features as DF
from ..operators import evaluation as E
from ..operators import pairwise as P
from ..operators import selection as S
from ..runtime import materialize, ship
from .evaluation import FEATURES, features
from .selection import _FILL
from .signals import _r, _reads, _rounded, _X

#: Samples that the straight distance compares.
LENGTH = 12


def _levelled(spark, d):
    ship(spark)
    return materialize(_reads(spark, d).where("class is not null and size(x) > 0").select("read_id", "class", A.levelled(F.col("x")).alias("x")), "levelled")


def _sample(spark, d):
    return materialize(P.sample(_levelled(spark, d).withColumn("x", A.resample_lerp(F.col("x"), LENGTH)), 12), "sample")


def _pairs(spark, d):
    return materialize(P.pairwise(_sample(spark, d), "euclidean"), "pairs")


def pairs_straight(spark, d):
    return _rounded(_pairs(spark, d))


def pairs_medoids(spark, d):
    rows = _sample(spark, d)
    pairs = materialize(P.pairwise(rows, "euclidean"), "pairs")
    return P.medoids(pairs, rows, 2).select("class", "place", "read_id")


def pairs_within_between(spark, d):
    return _rounded(P.within_between(_pairs(spark, d)))


def pairs_class_table(spark, d):
    return _rounded(P.class_table(_pairs(spark, d)))


def pairs_silhouettes(spark, d):
    return _rounded(P.silhouettes(_pairs(spark, d)))


def pairs_blended(spark, d):
    """Straight distances of a sample's pairs, half and half with those of the reads' standardised features."""
    rows = materialize(S.filled(features(spark, d), ["read_id"], FEATURES), "filled")
    return _rounded(DF.blended(_pairs(spark, d), DF.standardised(rows, FEATURES)))


def pairs_template_features(spark, d):
    """Features of every read's straight distances to the mean courses of the classes."""
    reads = _levelled(spark, d)
    return _rounded(DF.features(materialize(DF.straight(reads, materialize(D.mean_courses(reads, LENGTH), "courses"), LENGTH), "straight")))


def warp_template_features(spark, d):
    """Features of every read's warping distances to the medoids of the classes."""
    reads = _levelled(spark, d)
    far = P.to_all(reads, D.class_templates(reads, per_class=20))
    return _rounded(DF.features(DF.from_map(materialize(far, "to_all"))))


def warp_pairs(spark, d):
    """Warping distances of all pairs of a sample of each class."""
    return _rounded(P.pairwise(P.sample(_levelled(spark, d), 12), "warp"))


def warp_nearest(spark, d):
    """Every read taken for the class whose medoid is nearest, scored per class."""
    reads = _levelled(spark, d)
    preds = P.nearest_template(P.to_all(reads, D.class_templates(reads, per_class=20)))
    return _rounded(E.per_class(E.confusion(preds)))


def warp_envelopes(spark, d):
    """Quartiles of each class's reads at the places of its barycentre."""
    reads = _levelled(spark, d)
    return _rounded(P.envelopes(reads, D.class_templates(reads, "barycentre", per_class=20)))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith(("pairs_", "warp_")) and callable(f)}

_I = f"(i * ((len(y) - 1) / {LENGTH - 1}.0::double))"
_LO = f"least(cast(floor({_I}) as integer), len(y) - 1)"
_S = _X + f""", lev as (select read_id, class, list_transform(x, lambda v: v - list_aggregate(x, 'quantile_cont', 0.5)) as y from reads where class is not null and len(x) > 0),
  smp as (select class, read_id, list_transform(generate_series(0, {LENGTH - 1}), lambda i: y[{_LO} + 1] + (y[least({_LO} + 1, len(y) - 1) + 1] - y[{_LO} + 1]) * ({_I} - {_LO})) as x
    from (select *, row_number() over (partition by class order by md5('0:' || read_id), read_id) as k from lev) where k <= 12),
  prs as (select a.read_id as id_a, a.class as class_a, b.read_id as id_b, b.class as class_b, sqrt(list_sum(list_transform(generate_series(1, {LENGTH}), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))) as distance
    from smp a join smp b on a.class < b.class or (a.class = b.class and a.read_id < b.read_id)),
  two as (select * from prs union all select id_b, class_b, id_a, class_a, distance from prs)
"""
SQL = {
    "pairs_straight": _S + f"select id_a, class_a, id_b, class_b, {_r('distance', 'distance')} from prs",
    "pairs_medoids": _S + """, t as (select s.class, s.read_id, coalesce(total, 0) as total from smp s left join (select id_a, sum(distance) as total from two where class_a = class_b group by 1) on id_a = read_id)
      select class, cast(place as integer) as place, read_id from (select *, row_number() over (partition by class order by round(total, 9), read_id) as place from t) where place <= 2""",
    "pairs_within_between": _S + f"""select class, type, count(*) as n, {_r('avg(distance)', 'mean')}, {_r('median(distance)', 'median')} from (
      select class_a as class, 'within' as type, distance from prs where class_a = class_b union all select class_a, 'between', distance from two where class_a <> class_b) group by all""",
    "pairs_class_table": _S + f""", h as (select class_a as a, class_b as b, count(*) as n, avg(distance) as mean, median(distance) as med from prs group by all), f as (select * from h union all select b, a, n, mean, med from h where a <> b)
      select a, b, n, {_r('mean', 'mean')}, {_r('med', 'median')}, {_r('coalesce((med - min(med) over w) / nullif(max(med) over w - min(med) over w, 0), 0)', 'scaled')} from f window w as (partition by a)""",
    "pairs_silhouettes": _S + f""", m as (select id_a, class_a, class_b, avg(distance) as mean from two group by all),
      s as (select id_a as read_id, class_a as class, max(mean) filter (class_a = class_b) as inside, min(mean) filter (class_a <> class_b) as away, arg_min(class_b, (mean, class_b)) filter (class_a <> class_b) as nearest from m group by all)
      select read_id, class, {_r('inside', 'inside')}, nearest, {_r('coalesce((away - inside) / nullif(greatest(away, inside), 0), 0)', 'silhouette')} from s where inside is not null and away is not null""",
}

# Distances of the standardised features, beside the straight ones.
_LEV = _S.split("  smp as")[0]
_FV = ", ".join(f"coalesce(({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0), 0)" for c in FEATURES)
SQL["pairs_blended"] = _S + _FILL.replace("with frow", ", frow", 1) + f""", vec as (select read_id, [{_FV}] as v from fl),
  bl as (select p.*, sqrt(list_sum(list_transform(generate_series(1, {len(FEATURES)}), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) as fd from prs p join vec a on a.read_id = id_a join vec b on b.read_id = id_b)
  select id_a, class_a, id_b, class_b, {_r('distance', 'distance')}, {_r('fd', 'feature_distance')},
    {_r('0.5 * coalesce((distance - min(distance) over ()) / nullif(max(distance) over () - min(distance) over (), 0), 0) + 0.5 * coalesce((fd - min(fd) over ()) / nullif(max(fd) over () - min(fd) over (), 0), 0)', 'combined')} from bl"""
_Q = lambda p: f"list_aggregate(ds, 'quantile_cont', {p})"
_SUM = lambda e: f"list_sum(list_transform(ds, lambda v: {e}))"
_VALUES = {
    "d_min": "ss[1]", "d_second": "ss[2]", "d_min_ratio": "ss[1] / (ss[2] + 1e-12::double)", "d_min_margin": "ss[2] - ss[1]", "d_max": "list_max(ds)", "d_mean": "mn", "d_median": "md", "d_std": "sd",
    "d_mad": "list_aggregate(list_transform(ds, lambda v: abs(v - md)), 'quantile_cont', 0.5)", "d_iqr": f"{_Q(0.75)} - {_Q(0.25)}", "d_p25": _Q(0.25), "d_p75": _Q(0.75), "d_p90": _Q(0.9), "d_p99": _Q(0.99),
    "d_skew": f"case when sd > 1e-9 and n > 2 then {_SUM('pow(v - mn, 3)')} / n / pow(sd, 3) * sqrt(n * (n - 1)) / (n - 2) end",
    "d_kurt": f"case when sd > 1e-9 and n > 3 then ((n + 1) * ({_SUM('pow(v - mn, 4)')} / n / pow(sd, 4) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)) end",
    "d_share_near": "len(list_filter(ds, lambda v: v <= 1.5 * md)) / n", "d_mean_z": "list_avg(z)", "d_max_z": "list_max(z)", "d_min_z": "list_min(z)",
    "d_softmax_entropy": "-list_sum(list_transform(p, lambda v: v * ln(v + 1e-12::double)))", "d_softmax_max": "list_max(p)", "d_rbf_mean": f"{_SUM('exp(-v * v / (w * w))')} / n", "d_rbf_max": "list_max(list_transform(ds, lambda v: exp(-v * v / (w * w))))",
}
SQL["pairs_template_features"] = _LEV + f""" all_y as (select class, read_id, list_transform(generate_series(0, {LENGTH - 1}), lambda i: y[{_LO} + 1] + (y[least({_LO} + 1, len(y) - 1) + 1] - y[{_LO} + 1]) * ({_I} - {_LO})) as y from lev),
  mc as (select class, list(m order by pos) as t from (select class, i as pos, avg(y[i]) as m from all_y, (select unnest(generate_series(1, {LENGTH})) as i) group by all) group by class),
  tr as (select list(class order by class) as names, list(t order by class) as ts from mc),
  di as (select read_id, class, names, list_transform(ts, lambda t: sqrt(list_sum(list_transform(generate_series(1, {LENGTH}), lambda i: (y[i] - t[i]) * (y[i] - t[i]))))) as ds from all_y, tr),
  lg as (select unnest(names) as name, unnest(ds) as v from di), cm as (select name, median(v) as m from lg group by 1), ck as (select name, m, median(abs(v - m)) + 1e-12::double as k from lg join cm using (name) group by all),
  cl as (select list(m order by name) as ms, list(k order by name) as ks from ck),
  ba as (select *, list_sort(ds) as ss, len(ds)::double as n, list_avg(ds) as mn, list_aggregate(ds, 'quantile_cont', 0.5) as md, list_aggregate(ds, 'stddev_pop') as sd, list_transform(ds, lambda v, i: (v - ms[i]) / ks[i]) as z from di, cl),
  wd as (select *, (select median(md) + 1e-12::double from ba) as w from ba),
  ex as (select *, list_transform(ds, lambda v: exp(-v / (w * w)) / (list_sum(list_transform(ds, lambda u: exp(-u / (w * w)))) + 1e-12::double)) as p from wd)
  select read_id, class, names[list_position(ds, ss[1])] as nearest, cast(len(list_filter(ds, lambda v: v <= 1.5 * md)) as integer) as d_count_near, {', '.join(_r(e, k) for k, e in _VALUES.items())} from ex"""
