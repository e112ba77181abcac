"""Distances between reads of a bounded sample, and what follows from them: medoids, barycentres, tables, silhouettes.

All pairs of reads are only taken of a sample of at most `per_class` reads of each class, drawn by hash: a
documented bound, whatever the table. A class's sample is one row of series, a task takes one pair of
classes. Reads as a whole are compared with one template per class (see distance), never with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import arrays as A
from ..functions.kernels import _arrays, barycentre, warp_many, warp_path
from ..runtime import materialize, ship
from .ranks import first_by_hash, group_quantiles

PER_CLASS = 40
PAIRS = "array<struct<i:int,j:int,d:double>>"


def sample(reads: DataFrame, per_class: int = PER_CLASS, seed: int = 0) -> DataFrame:
    """At most per_class reads with samples of each class, the first in the order of a hash of their ids: (class, read_id, x)."""
    full = reads.where("class is not null and size(x) > 0").select("class", "read_id", "x")
    picked = first_by_hash(full, "class", "read_id", F.lit(per_class), seed).where("picked").select("read_id")
    return full.join(picked, "read_id").select("class", "read_id", "x")


def blocks(rows: DataFrame) -> DataFrame:
    """A row per class of a sample: (class, ids, xs), in order of ids."""
    each = rows.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("read_id", "x"))).alias("r"))
    return each.select("class", F.transform("r", lambda r: r["read_id"]).alias("ids"), F.transform("r", lambda r: r["x"]).alias("xs"))


def _lists(column: pa.Array) -> list[list[np.ndarray]]:
    flat = _arrays(column.flatten())
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def distance(metric: str, xs: list[np.ndarray], ys: list[np.ndarray], band: float) -> np.ndarray:
    """Distances of pairs of series: warped, or of the straight line between series of one length."""
    if metric == "euclidean":
        return np.array([float(np.sqrt(((v - w) ** 2).sum())) if len(v) == len(w) else np.nan for v, w in zip(xs, ys)])
    return warp_many(xs, ys, band)


def _matrix(metric: str, band: float, a: Column, b: Column, same: Column) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("d", pa.float64())]))
        for left, right, alike in batches:
            rows = []
            for x, y, s in zip(_lists(left), _lists(right), alike.to_pylist()):
                at = [(i, j) for j in range(len(y)) for i in range(j if s else len(x))]
                d = distance(metric, [x[i] for i, _ in at], [y[j] for _, j in at], band)
                rows.append([{"i": i, "j": j, "d": v} for (i, j), v in zip(at, d.tolist()) if np.isfinite(v)])
            yield pa.array(rows, kind)

    return F.arrow_udf(run, PAIRS)(a, b, same)


def pairwise(rows: DataFrame, metric: str = "warp", band: float = 0.1) -> DataFrame:
    """All pairs of a sample, each once: (id_a, class_a, id_b, class_b, distance), class_a <= class_b.

    One row per pair of classes goes to a task. Pairs without a finite distance are left out.
    """
    ship(rows.sparkSession)
    each = materialize(blocks(rows), "blocks")
    a = each.select(F.col("class").alias("class_a"), F.col("ids").alias("ids_a"), F.col("xs").alias("xs_a"))
    b = each.select(F.col("class").alias("class_b"), F.col("ids").alias("ids_b"), F.col("xs").alias("xs_b"))
    n = each.count()
    met = a.join(b, F.col("class_a") <= F.col("class_b")).repartition(max(1, min(n * (n + 1) // 2, 4 * rows.sparkSession.sparkContext.defaultParallelism)))
    met = met.withColumn("p", _matrix(metric, band, F.col("xs_a"), F.col("xs_b"), F.col("class_a") == F.col("class_b")))
    return met.select("ids_a", "class_a", "ids_b", "class_b", F.explode("p").alias("p")).select(
        F.get("ids_a", F.col("p.i")).alias("id_a"), "class_a", F.get("ids_b", F.col("p.j")).alias("id_b"), "class_b", F.col("p.d").alias("distance")
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair from either side."""
    back = pairs.select(F.col("id_b").alias("id_a"), F.col("class_b").alias("class_a"), F.col("id_a").alias("id_b"), F.col("class_a").alias("class_b"), "distance")
    return pairs.unionByName(back)


def medoids(pairs: DataFrame, rows: DataFrame, n: int = 1) -> DataFrame:
    """The n reads of each class with the least sum of distances within it: (class, place, read_id, x); ties by id.

    A class with one read in the sample has that one.
    """
    inner = both_ways(pairs.where("class_a = class_b")).groupBy(F.col("id_a").alias("read_id")).agg(F.sum("distance").alias("total"))
    place = F.row_number().over(W.partitionBy("class").orderBy(F.round(F.coalesce("total", F.lit(0.0)), 9), "read_id"))
    return rows.join(inner, "read_id", "left").withColumn("place", place).where(F.col("place") <= n).select("class", "place", "read_id", "x")


def barycentres(rows: DataFrame, pairs: DataFrame, turns: int = 10, band: float = 0.1) -> DataFrame:
    """Of each class's sample the mean course under warping, begun at its medoid: (class, template)."""
    ship(rows.sparkSession)
    first = medoids(pairs, rows).select("class", F.col("x").alias("start"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for starts, lists in batches:
            yield pa.array([barycentre(s, xs, turns, band).tolist() for s, xs in zip(_arrays(starts), _lists(lists))], pa.list_(pa.float64()))

    return blocks(rows).join(first, "class").select("class", F.arrow_udf(run, "array<double>")(F.col("start"), F.col("xs")).alias("template"))


def within_between(pairs: DataFrame) -> DataFrame:
    """Per class the pairs inside it and those with one end in it: (class, type, n, mean, median)."""
    ends = both_ways(pairs.where("class_a <> class_b")).select(F.col("class_a").alias("class"), F.lit("between").alias("type"), "distance")
    every = pairs.where("class_a = class_b").select(F.col("class_a").alias("class"), F.lit("within").alias("type"), "distance").unionByName(ends)
    every = materialize(every, "ends")
    middle = group_quantiles(every, ["class", "type"], "distance", {"median": 0.5})
    return every.groupBy("class", "type").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")).join(middle, ["class", "type"])


def class_table(pairs: DataFrame) -> DataFrame:
    """Every class with every other and itself, both ways: (a, b, n, mean, median, scaled), scaled by the row's least
    and greatest median to 0..1; a constant row is 0."""
    rows = materialize(pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "distance"), "table")
    half = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")).join(group_quantiles(rows, ["a", "b"], "distance", {"median": 0.5}), ["a", "b"])
    full = half.unionByName(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "mean", "median"))
    row = W.partitionBy("a")
    part = F.try_divide(F.col("median") - F.min("median").over(row), F.max("median").over(row) - F.min("median").over(row))
    return full.withColumn("scaled", F.coalesce(part, F.lit(0.0)))


def silhouettes(pairs: DataFrame) -> DataFrame:
    """Silhouette of every sampled read from its mean distances to the classes: (read_id, class, inside, nearest, silhouette).

    Reads without another of their class, or without another class, have none.
    """
    means = both_ways(pairs).groupBy(F.col("id_a").alias("read_id"), F.col("class_a").alias("class"), "class_b").agg(F.avg("distance").alias("mean"))
    own, other = F.col("class") == F.col("class_b"), F.struct("mean", "class_b")
    both = means.groupBy("read_id", "class").agg(F.max(F.when(own, F.col("mean"))).alias("inside"), F.min(F.when(~own, other)).alias("o")).where("inside is not null and o is not null")
    s = F.coalesce(F.try_divide(F.col("o.mean") - F.col("inside"), F.greatest("o.mean", "inside")), F.lit(0.0))
    return both.select("read_id", "class", "inside", F.col("o.class_b").alias("nearest"), s.alias("silhouette"))


def to_all(reads: DataFrame, templates: DataFrame, band: float = 0.1) -> DataFrame:
    """Every read's warping distance to each of the templates (class, template): (read_id, class, distances), a map.

    Templates are one short series per class, so they go to all tasks as one row, which is broadcast.
    """
    ship(reads.sparkSession)
    one = templates.agg(F.array_sort(F.collect_list(F.struct("class", "template"))).alias("t"))
    row = one.select(F.transform("t", lambda t: t["class"]).alias("names"), F.transform("t", lambda t: t["template"]).alias("courses"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, courses in batches:
            series, lists = _arrays(xs), _lists(courses)
            out = np.full((len(series), max(map(len, lists), default=0)), np.nan)
            for k in range(out.shape[1]):
                at = [i for i, t in enumerate(lists) if k < len(t) and len(series[i])]
                for part in np.array_split(sorted(at, key=lambda i: len(series[i])), -(-len(at) // 2048) or 1):
                    if len(part):
                        out[part, k] = distance("warp", [series[i] for i in part], [lists[i][k] for i in part], band)
            yield pa.array([[None if v != v else v for v in r] for r in out.tolist()], pa.list_(pa.float64()))

    met = reads.where("size(x) > 0").select("read_id", "class", "x").crossJoin(F.broadcast(row))
    return met.select("read_id", "class", F.map_from_arrays("names", F.arrow_udf(run, "array<double>")(F.col("x"), F.col("courses"))).alias("distances"))


def nearest_template(to_all_: DataFrame) -> DataFrame:
    """The template nearest to each read, ties by name: (id, y_true, y_pred, distance)."""
    pairs = F.transform(F.map_entries("distances"), lambda e: F.struct(e["value"].alias("d"), e["key"].alias("k")))
    best = F.array_min(F.filter(pairs, lambda p: p["d"].isNotNull()))
    return to_all_.select(F.col("read_id").alias("id"), F.col("class").alias("y_true"), best["k"].alias("y_pred"), best["d"].alias("distance"))


def warped(x: Column, y: Column, band: float = 0.1) -> Column:
    """x on the axis of y: the mean of the samples that the warping path maps to each place; empty if either is empty."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            rows = []
            for v, w in zip(_arrays(a), _arrays(b)):
                if not len(v) or not len(w):
                    rows.append([])
                    continue
                i, j = warp_path(v, w, band)
                rows.append((np.bincount(j, v[i], len(w)) / np.bincount(j, minlength=len(w))).tolist())
            yield pa.array(rows, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(x, y)


def envelopes(reads: DataFrame, templates: DataFrame, band: float = 0.1) -> DataFrame:
    """Of each class the quartiles of its reads at every place of its template, to which they are warped: (class, pos, p25, p50, p75)."""
    ship(reads.sparkSession)
    on = reads.where("size(x) > 0").join(templates, "class").select("class", F.posexplode(warped(F.col("x"), F.col("template"), band)).alias("pos", "v"))
    return group_quantiles(on, ["class", "pos"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
