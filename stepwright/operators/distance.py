"""Distances of reads to the medoid or barycentre of their class, thresholds and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import warp
from ..functions import arrays as A
from ..runtime import materialize, ship
from .pairwise import PER_CLASS, barycentres, medoids, pairwise, sample
from .ranks import group_quantiles


def class_templates(reads: DataFrame, kind: str = "medoid", per_class: int = PER_CLASS, band: float = 0.1) -> DataFrame:
    """Of each class the medoid of a bounded sample of its reads, or the sample's barycentre: (class, template)."""
    rows = materialize(sample(reads, per_class), "sample")
    pairs = materialize(pairwise(rows, "warp", band), "pairs")
    if kind == "barycentre":
        return materialize(barycentres(rows, pairs, band=band), "templates")
    return materialize(medoids(pairs, rows).select("class", F.col("x").alias("template")), "templates")


def mean_courses(reads: DataFrame, length: int) -> DataFrame:
    """Of each class the mean course of its reads at even places, as (class, template).

    Reads are brought to one length and averaged place by place, which are sums in two steps; a class
    that holds most reads is one row of partial sums per task. Reads without samples don't count.
    """
    y = A.resample_lerp(F.col("x"), length)
    long = reads.where("class is not null").select("class", F.posexplode(y).alias("pos", "v"))
    means = long.groupBy("class", "pos").agg(F.avg("v").alias("v"))
    ordered = means.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("t"))
    return ordered.select("class", F.transform("t", lambda s: s["v"]).alias("template"))


def to_template(reads: DataFrame, kind: str = "medoid", band: float = 0.1) -> DataFrame:
    """Each read's warping distance to its own class's template: (read_id, class, distance).

    There is one template per class, which Spark broadcasts by its size or joins by class otherwise.
    Reads without class or samples have no row.
    """
    ship(reads.sparkSession)
    ready = materialize(reads.where("size(x) > 0 and class is not null").select("read_id", "class", A.levelled(F.col("x")).alias("x")), "levelled")
    templates = class_templates(ready, kind, band=band)
    return ready.join(templates, "class").select("read_id", "class", warp(F.col("x"), F.col("template"), band).alias("distance"))


def thresholds(distances: DataFrame, quantile: float = 0.95, least: int = 5) -> DataFrame:
    """Per class the quantile of the distances; null (no limit) for classes of fewer than `least` reads."""
    n = distances.groupBy("class").agg(F.count("distance").alias("n"), F.max("distance").alias("greatest"))
    q = group_quantiles(distances, ["class"], "distance", {"q": quantile})
    return n.join(q, "class", "left").select("class", "n", F.when(F.col("n") >= least, F.col("q")).alias("threshold"), "greatest")


def outliers(distances: DataFrame, limits: DataFrame) -> DataFrame:
    """Reads farther from their template than their class's threshold."""
    return distances.join(limits.select("class", "threshold"), "class").where("distance > threshold").select("read_id", "class", "distance", "threshold")


def whisker_outliers(distances: DataFrame, reach: float = 1.5, least: int = 5) -> DataFrame:
    """Reads beyond the upper quartile by more than `reach` quartile ranges of their class."""
    n = distances.groupBy("class").agg(F.count("distance").alias("n"))
    q = group_quantiles(distances, ["class"], "distance", {"a": 0.25, "b": 0.75}).join(n, "class")
    limit = F.col("b") + F.lit(reach) * (F.col("b") - F.col("a"))
    return distances.join(q.where(F.col("n") >= least), "class").where(F.col("distance") > limit).select("read_id", "class", "distance")
