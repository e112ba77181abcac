"""Queries of low-current regions and of the separation of classes, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import detector as D
from ..operators import silhouette as S
from ..runtime import materialize, table
from ..sources.signals import reads_once
from .evaluation import _F, _r, features
from .signals import _rounded

THREE = ["median_slope", "kurtosis", "total_variation"]


#: Drops in units of a read's own median deviation, as reads are in different units.
LIMITS = {"least_drop": 1.5, "threshold": 0.8, "least_len": 3}


def _reads(spark, d):
    """Reads levelled by their median and scaled by their median deviation."""
    reads = reads_once(table(spark, d, "peptide_signals")).select("read_id", "class", "x")
    m = reads.withColumn("m", A.a_median(F.col("x")))
    return m.withColumn("k", A.a_mad(F.col("x"), F.col("m"))).select("read_id", "class", A.scale_mad(F.col("x"), F.col("m"), F.col("k")).alias("x"))


def region_verdicts(spark, d):
    return _rounded(D.verdicts(_reads(spark, d), **LIMITS))


def region_summary(spark, d):
    return D.verdict_summary(materialize(D.verdicts(_reads(spark, d), **LIMITS), "verdicts"))


def region_statistics(spark, d):
    reads = materialize(_reads(spark, d), "scaled")
    return _rounded(D.region_stats(reads, D.verdicts(reads, **LIMITS)))


def separation_silhouettes(spark, d):
    scaled = S.standardised(features(spark, d).where("class is not null").select("read_id", "class", *THREE), THREE)
    return _rounded(S.silhouettes(scaled, "read_id", THREE))


def separation_by_class(spark, d):
    scaled = S.standardised(features(spark, d).where("class is not null").select("read_id", "class", *THREE), THREE)
    sil = S.silhouettes(scaled, "read_id", THREE)
    return _rounded(sil.groupBy("class").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"), F.avg("own").alias("own"), F.avg("nearest").alias("nearest")))


def separation_centres(spark, d):
    scaled = S.standardised(features(spark, d).where("class is not null").select("read_id", "class", *THREE), THREE)
    return _rounded(S.centre_distances(scaled, THREE))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith(("region_", "separation_"))}

_S = _F + """, ok as (select read_id, class, median_slope, kurtosis, total_variation from f where class is not null and isfinite(median_slope) and isfinite(kurtosis) and isfinite(total_variation)),
  z as (select read_id, class, """ + ", ".join(f"({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0) as z{i}" for i, c in enumerate(THREE)) + """ from ok),
  centre as (select class, avg(z0) as c0, avg(z1) as c1, avg(z2) as c2 from z group by class),
  dist as (select read_id, z.class, centre.class as other, sqrt(pow(z0 - c0, 2) + pow(z1 - c1, 2) + pow(z2 - c2, 2)) as d from z, centre),
  sil as (select read_id, class, max(d) filter (other = class) as own, min(d) filter (other <> class) as nearest from dist group by all)
"""

SQL = {
    "separation_silhouettes": _S + f"select read_id, class, {_r('own', 'own')}, {_r('nearest', 'nearest')}, {_r('(nearest - own) / greatest(own, nearest)', 'silhouette')} from sil",
    "separation_by_class": _S + f"select class, count(*) as n, {_r('avg((nearest - own) / greatest(own, nearest))', 'silhouette')}, {_r('avg(own)', 'own')}, {_r('avg(nearest)', 'nearest')} from sil group by class",
    "separation_centres": _S + f"select a.class as a, b.class as b, {_r('sqrt(pow(a.c0 - b.c0, 2) + pow(a.c1 - b.c1, 2) + pow(a.c2 - b.c2, 2))', 'distance')} from centre a, centre b where a.class < b.class",
}
