"""Separation of classes by features: simplified silhouettes from class centres, and distances within and between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardised(frame: DataFrame, features: list[str]) -> DataFrame:
    """Features with mean 0 and deviation 1 over all rows, constant ones 0; rows with a missing value are left out."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in features])
    rows = frame.where(ok)
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    scaled = [F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)).alias(c) for c in features]
    return rows.crossJoin(F.broadcast(stats)).select(*[c for c in frame.columns if c not in features], *scaled)


def class_centres(scaled: DataFrame, features: list[str]) -> DataFrame:
    """The mean of each class, one row per class."""
    return scaled.groupBy("class").agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in features]).alias("centre"))


def silhouettes(scaled: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """(id, class, own, nearest, silhouette): distances to the own centre and to the nearest other one.

    The centres of all classes, a row per class, go along with each row as an array, so a row is met once
    and no pairs are written. The silhouette is (nearest - own) over the greater of both; null with one
    class, 0 where both distances are 0.
    """
    centres = class_centres(scaled, features).agg(F.collect_list(F.struct("class", "centre")).alias("centres"))
    point = F.array(*[F.col(c) for c in features])
    rows = scaled.select(id_col, "class", point.alias("p")).crossJoin(F.broadcast(centres))

    def far(c):
        return F.sqrt(F.aggregate(F.zip_with(c["centre"], F.col("p"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))

    dist = rows.select(id_col, "class", F.transform("centres", lambda c: F.struct(c["class"].alias("class"), far(c).alias("d"))).alias("ds"))
    own = F.array_max(F.transform(F.filter("ds", lambda d: d["class"].eqNullSafe(F.col("class"))), lambda d: d["d"]))
    near = F.array_min(F.transform(F.filter("ds", lambda d: ~d["class"].eqNullSafe(F.col("class"))), lambda d: d["d"]))
    both = dist.select(id_col, "class", own.alias("own"), near.alias("nearest"))
    top = F.greatest("own", "nearest")
    return both.select(id_col, "class", "own", "nearest", F.when(F.col("nearest").isNotNull(), F.when(top > 0, (F.col("nearest") - F.col("own")) / top).otherwise(F.lit(0.0))).alias("silhouette"))


def centre_distances(scaled: DataFrame, features: list[str]) -> DataFrame:
    """Distances between the centres of all classes: (a, b, distance), for pairs of labels."""
    c = class_centres(scaled, features).where("class is not null").select("class", "centre")
    everyone = c.agg(F.collect_list(F.struct("class", "centre")).alias("others"))
    pairs = c.crossJoin(F.broadcast(everyone)).select(F.col("class").alias("a"), "centre", F.explode("others").alias("o")).where("a < o.class")
    d = F.sqrt(F.aggregate(F.zip_with("centre", "o.centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return pairs.select("a", F.col("o.class").alias("b"), d.alias("distance"))
