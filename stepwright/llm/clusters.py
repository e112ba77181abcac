"""Clusters of mutually similar records by spectral clustering with power iteration."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import discard, materialize
from .mixing import uniform
from .splits import connected

#: Vectors that are iterated side by side, and the width of a bin of their values.
VECTORS, BIN = 3, 1e-4

# How far two reads of one group may lie apart, in median_slope, kurtosis and ln(total_variation).
TOLERANCE = {"median_slope": 0.004, "kurtosis": 0.04, "total_variation": 0.02}

#: The least share of a group's mass that a link must have to count where the embedding sees two groups. Reads that all
#: agree with each other within the tolerance lie in 8 cells at most, with affinities of exp(-3) at least: some two of
#: their parts share exp(-3) / (1 + 7 exp(-3)) = 0.037 or more, so such reads always stay together.
BRIDGE = 0.02


def _near_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs (a, b) of occupied cells that touch, itself included, as a join on the neighbours' positions."""
    moves = F.array(*[F.struct(*[F.lit(d).alias(k) for k, d in zip(keys, m)]) for m in product((-1, 0, 1), repeat=len(keys))])
    facts = ("cell", "n", "centre", "low", "high")
    ends = cells.select(*keys, *[F.col(c).alias(f"{c}_b") for c in facts]).withColumnRenamed("cell_b", "b")
    spread = cells.select(*facts, F.explode(moves).alias("m"), *keys)
    spread = spread.select(F.col("cell").alias("a"), *[F.col(c).alias(f"{c}_a") for c in facts[1:]], *[(F.col(k) + F.col(f"m.{k}")).alias(k) for k in keys])
    return spread.join(ends, keys).drop(*keys)


def cluster(
    points: DataFrame, id_col: str, axes: list[str], iterations: int = 40, bridge: float = 0.0, seed: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Cluster points (id, axes in units of the tolerance); returns (members, cells).

    members: (id, cell, cluster), cells: (cell, cluster, n, centre). The steps:

    - points in one cell of side 1 are one node with their number as weight, so copies and dense
      places, a third of all rows even, cost one row and no pairs;
    - nodes are linked if they touch and the boxes around their points come within 1 in every axis,
      so two points at most 1 apart in every axis are always in one node or in linked ones. The
      affinity is n_b * exp(-d^2) by the centres, normalised to 1 over each node's links (itself included);
    - several random vectors are iterated with the normalised affinities; within a connected part
      they fall towards one value each, which differs from part to part; iteration stops when no
      value moves by a hundredth of a bin, or after so many turns;
    - k-means in the space of the vectors: the centres begin as the occupied bins, thinned so that
      no two touch, each node goes to the nearest centre near it, and the centres move to their
      means until no node changes;
    - a last exact check: a cluster's nodes must be linked (parts that met by chance in a bin come
      apart), and clusters with a link between them that isn't thin beside what it joins, by the share
      bridge, become one (parts that had not settled come together), see join_linked. So dense groups
      with a thin link between them stay as the embedding has them.

    With bridge 0 every link counts: clusters are the connected parts of the links, which no embedding
    could change, and none is made.
    """
    keys = [f"k{i}" for i in range(len(axes))]
    placed = points.select(id_col, *[F.col(a).alias(f"x{i}") for i, a in enumerate(axes)])
    for i, k in enumerate(keys):
        placed = placed.withColumn(k, F.floor(f"x{i}"))
    placed = placed.withColumn("cell", F.xxhash64(*keys))
    xs = [f"x{i}" for i in range(len(axes))]
    cells = materialize(
        placed.groupBy("cell", *keys).agg(
            F.count("*").alias("n"), F.array(*[F.avg(x) for x in xs]).alias("centre"), F.array(*[F.min(x) for x in xs]).alias("low"), F.array(*[F.max(x) for x in xs]).alias("high")
        ),
        "cells",
    )
    gap = F.array_max(F.zip_with("low_b", "high_a", lambda b, a: b - a)), F.array_max(F.zip_with("low_a", "high_b", lambda a, b: a - b))
    squares = F.aggregate(F.zip_with("centre_a", "centre_b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, g: s + g)
    near = _near_cells(cells, keys).where((gap[0] <= 1) & (gap[1] <= 1))
    links = materialize(near.select("a", "b", (F.col("n_b") * F.exp(-squares)).alias("w"), (F.col("n_a") * F.col("n_b") * F.exp(-squares)).alias("mass")), "affinities")
    apart = join_linked(_embedded(links, iterations, seed), links, bridge) if bridge > 0 else _parts(links)
    every = materialize(cells.join(apart, "cell", "left").select("cell", F.coalesce("cluster", "cell").alias("cluster"), "n", "centre"), "clusters")
    for t in (cells, links):
        discard(t)
    members = placed.join(every.select("cell", "cluster"), "cell").select(id_col, "cell", "cluster", *xs)
    return members, every


def _parts(links: DataFrame) -> DataFrame:
    """The connected parts of the links (a, b): (cell, cluster)."""
    part = connected(links.select(F.col("a").alias("entry"), F.col("b").alias("key")))
    return part.select(F.col("entry").alias("cell"), F.col("group").alias("cluster"))


def _embedded(links: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Clusters by the embedding alone, of the cells that have neighbours: (cell, cluster), see cluster."""
    # Nodes without any other neighbour are clusters of their own; only the others are iterated.
    degree = materialize(links.groupBy("a").agg(F.sum("w").alias("degree"), F.count("*").alias("near")).where("near > 1").select("a", "degree"), "degrees")
    vs = [f"v{i}" for i in range(VECTORS)]
    vector = materialize(degree.select(F.col("a").alias("cell"), *[uniform("a", F.lit(v), seed=seed).alias(v) for v in vs]), "vectors")
    for _ in range(iterations):
        olds = vector.select("cell", *[F.col(v).alias(f"old_{v}") for v in vs])
        new = (
            links.join(vector, links.b == vector.cell)
            .groupBy(F.col("a").alias("cell"))
            .agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in vs])
            .join(degree.withColumnRenamed("a", "cell"), "cell")
            .join(olds, "cell")
            .select("cell", *[(F.col(v) / F.col("degree")).alias(v) for v in vs], *[f"old_{v}" for v in vs])
        )
        new = materialize(new, "vectors")
        moved = reduce(lambda a, b: F.greatest(a, b), [F.abs(F.col(v) - F.col(f"old_{v}")) for v in vs])
        still = new.where(moved > BIN / 100).isEmpty()
        discard(vector)
        vector = new.select("cell", *vs)
        if still:
            break
    near = kmeans_bins(vector, vs)
    for t in (degree, vector):
        discard(t)
    return near


def kmeans_bins(embedding: DataFrame, vs: list[str], passes: int = 20) -> DataFrame:
    """K-means with as many centres as the vectors show: (cell, cluster), see cluster. What passes leave apart, join_linked joins."""
    bins = [f"b{i}" for i in range(len(vs))]
    at = embedding
    for b, v in zip(bins, vs):
        at = at.withColumn(b, F.floor(F.col(v) / BIN))
    moves = F.array(*[F.struct(*[F.lit(d).alias(b) for b, d in zip(bins, m)]) for m in product((-1, 0, 1), repeat=len(vs))])

    def around(df: DataFrame) -> DataFrame:
        """The rows of df, once at each of the bins around theirs."""
        rest = [c for c in df.columns if c not in bins]
        return df.withColumn("m", F.explode(moves)).select(*rest, *[(F.col(b) + F.col(f"m.{b}")).alias(b) for b in bins])

    filled = at.groupBy(*bins).agg(*[F.avg(v).alias(f"c{v}") for v in vs]).withColumn("centre", F.xxhash64(*bins))
    smallest = around(filled.select("centre", *bins)).groupBy(*bins).agg(F.min("centre").alias("least"))
    centres = filled.join(smallest, bins).where("centre = least").select("centre", *bins, *[f"c{v}" for v in vs])
    old = None
    for _ in range(passes):
        reach = around(centres)
        gap = sum((F.pow(F.col(v) - F.col(f"c{v}"), 2) for v in vs), F.lit(0.0))
        nearest = at.join(reach, bins, "left").groupBy("cell").agg(
            F.min_by("centre", F.struct(gap, "centre")).alias("centre"), *[F.first(v).alias(v) for v in vs]
        )
        # A node without a centre near it is a centre of its own.
        now = materialize(nearest.select("cell", F.coalesce("centre", "cell").alias("centre"), *vs), "centres")
        changed = old is None or not now.join(old.select("cell", F.col("centre").alias("was")), "cell").where("centre <> was").isEmpty()
        if old is not None:
            discard(old)
        old = now
        if not changed:
            break
        moved = now.groupBy("centre").agg(*[F.avg(v).alias(f"c{v}") for v in vs])
        for b, v in zip(bins, vs):
            moved = moved.withColumn(b, F.floor(F.col(f"c{v}") / BIN))
        centres = moved
    return old.select("cell", F.col("centre").alias("cluster"))


def join_linked(assigned: DataFrame, links: DataFrame, bridge: float = 0.0) -> DataFrame:
    """Exact check of clusters (cell, cluster) against the links (a, b, mass), each cell linked to itself: (cell, cluster).

    First the parts of each cluster that links connect become clusters of their own, then clusters
    with links between them become one. With bridge above 0 two clusters become one only while the
    mass of the links between them is at least that share of the lesser one's whole mass; the pairs
    that hold each other's greatest share join first, and shares are taken anew after each turn.
    """
    of = assigned.select("cell", "cluster")
    ends = links.join(of.withColumnRenamed("cell", "a"), "a").join(of.select(F.col("cell").alias("b"), F.col("cluster").alias("cluster_b")), "b")
    part = _parts(ends.where("cluster = cluster_b"))
    while True:
        to = part.select(F.col("cell").alias("b"), F.col("cluster").alias("to"))
        pairs = links.join(part.select(F.col("cell").alias("a"), F.col("cluster").alias("at")), "a").join(to, "b").groupBy("at", "to").agg(F.sum("mass").alias("mass"))
        pairs = materialize(pairs, "between")
        across = pairs.where("at <> to")
        if bridge > 0 and not across.isEmpty():
            whole = pairs.groupBy("at").agg(F.sum("mass").alias("whole"))
            # Once per pair and written, so that both of its ends see the same share to the last bit.
            share = across.where("at < to").join(whole, "at").join(whole.select(F.col("at").alias("to"), F.col("whole").alias("whole_b")), "to")
            share = materialize(share.select("at", "to", (F.col("mass") / F.least("whole", "whole_b")).alias("share")).where(F.col("share") >= bridge), "shares")
            both = share.withColumns({"first": F.col("at"), "last": F.col("to")})
            both = both.unionByName(both.withColumns({"at": F.col("last"), "to": F.col("first")}))
            best = both.groupBy("at").agg(F.max_by("to", F.struct("share", -F.col("first"), -F.col("last"))).alias("to"))
            back = best.select(F.col("at").alias("to"), F.col("to").alias("at"))
            across = materialize(best.join(back, ["at", "to"]), "across")
            discard(share)
        if across.isEmpty():
            for t in (pairs, across):
                discard(t)
            return part
        moved = connected(across.select(F.col("at").alias("entry"), F.col("to").alias("key")).unionByName(across.select(F.col("at").alias("entry"), F.col("at").alias("key"))))
        new = part.join(moved, part.cluster == moved.entry, "left").select("cell", F.coalesce("group", "cluster").alias("cluster"))
        new = materialize(new, "joined")
        for t in (pairs, across, part):
            discard(t)
        part = new
        if bridge == 0:
            return part


def cluster_reads(
    frame: DataFrame,
    id_col: str = "read_id",
    tolerance: dict[str, float] | None = None,
    logarithmic: tuple[str, ...] = ("total_variation",),
    typical: int = 3,
    bridge: float = BRIDGE,
) -> tuple[DataFrame, DataFrame]:
    """Cluster reads that agree in all features; returns (members, groups).

    members: (read_id, cluster_id, size, affinity), every read with all features in some cluster, alone
    or not; cluster_id is its smallest read_id. groups: (cluster_id, size, typical), clusters of two or
    more with their most typical reads, those of greatest affinity to the cluster.

    tolerance names the features and the scatter within a group; features in logarithmic agree in
    proportion to their value, and must be above 0. Reads in which a feature is null, NaN, infinite or
    (where logarithmic) not above 0 are left out, as are rows without read_id. A read delivered twice
    is one; if its deliveries differ, the smallest values count. Other columns aren't read. bridge: see join_linked.
    """
    tolerance = tolerance or TOLERANCE
    axes = []

    def value(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.log(F.when(x > 0, x)) if name in logarithmic else x

    points = frame.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("read_id"), *[(value(k) / t).alias(f"axis{i}") for i, (k, t) in enumerate(tolerance.items())])
    axes = [f"axis{i}" for i in range(len(tolerance))]
    ok = reduce(lambda a, b: a & b, [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")) for a in axes])
    points = materialize(points.where(ok).groupBy("read_id").agg(F.min(F.struct(*axes)).alias("p")).select("read_id", "p.*"), "points")
    members, cells = cluster(points, "read_id", axes, bridge=bridge)
    # A read's affinity to its cluster: that to the cluster's cells around it, with their sizes.
    names = members.groupBy("cluster").agg(F.min("read_id").alias("cluster_id"), F.count("*").alias("size"))
    centre = cells.groupBy("cluster").agg(
        *[(F.sum(F.col("n") * F.col("centre")[i]) / F.sum("n")).alias(f"m{i}") for i in range(len(axes))]
    )
    gap = sum((F.pow(F.col(f"x{i}") - F.col(f"m{i}"), 2) for i in range(len(axes))), F.lit(0.0))
    ranked = materialize(
        members.join(names.join(centre, "cluster"), "cluster").select("read_id", "cluster_id", "size", F.exp(-gap).alias("affinity")),
        "members",
    )
    top = W.partitionBy("cluster_id").orderBy(F.desc("affinity"), "read_id")
    groups = (
        ranked.where("size > 1")
        .withColumn("place", F.row_number().over(top))
        .where(F.col("place") <= typical)
        .groupBy("cluster_id")
        .agg(F.first("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("place", "read_id"))), lambda s: s["read_id"]).alias("typical"))
    )
    return ranked, groups
