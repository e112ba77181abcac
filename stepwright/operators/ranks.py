"""Ranks, running sums and exact quantiles within groups of any size.

A window over a whole group would be one task's work, and Spark's exact percentile one task's memory.
Here different values are counted first, a group's values are cut into blocks at approximate quantiles,
and sums run over the blocks (a few hundred rows per group) and, in parallel, within each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import materialize

#: Values that a block of a group should hold at most, about, and the bounds of the number of blocks.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 200_000, 16, 4096


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys where null is a value like others; the keys stay once."""
    cond = F.lit(True)
    for k in keys:
        right = right.withColumnRenamed(k, f"_key_{k}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(right, cond, how).drop(*[f"_key_{k}" for k in keys])


def sum_before(rows: DataFrame, by: list[str], value: str, weight: str, blocks: int | None = None, written: bool = False) -> DataFrame:
    """rows with before: the sum of weight over the rows of the same group with smaller values.

    rows has one row per group and value; groups may be null. value is a number without NaN. It is read
    several times, so it is written first, unless it is a written table already.
    """
    if not written:
        rows = materialize(rows, "counts")
    if not by:
        return sum_before(rows.withColumn("_all", F.lit(1)), ["_all"], value, weight, blocks, True).drop("_all")
    if blocks is None:  # the count of a written table comes from its footers
        blocks = min(max(-(-rows.count() // BLOCK_ROWS), LEAST_BLOCKS), MOST_BLOCKS)
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, cuts, 4 * blocks)).alias("_cuts"))
    placed = (
        join_groups(rows, bounds, by, "left")
        .select(*rows.columns, F.size(F.filter("_cuts", lambda b: b < F.col(value))).alias("_block"))
    )
    sums = placed.groupBy(*by, "_block").agg(F.sum(weight).alias("_sum"))
    run = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(run), F.lit(0)).alias("_offset"))
    inner = W.partitionBy(*by, "_block").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("_inner", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return join_groups(own, sums, [*by, "_block"]).select(*rows.columns, (F.col("_inner") + F.col("_offset")).alias("before"))


def group_quantiles(rows: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group: (by..., one column per name in probs).

    Null and NaN values don't count; groups without others have no row. Null groups are groups.
    """
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counts = materialize(counts, "counts")
    run = sum_before(counts, by, "_v", "_n", written=True)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total")) if by else counts.agg(F.sum("_n").alias("_total"))
    near = join_groups(run, total, by) if by else run.crossJoin(F.broadcast(total))
    aggs = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("_n"))
        a, b = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v")))
        part = F.max(at - low)
        aggs.append((a + (b - a) * part).alias(name))
    if not by:
        return near.agg(*aggs)
    return near.groupBy(*by).agg(*aggs)


def average_ranks(rows: DataFrame, by: list[str], value: str, rank: str) -> DataFrame:
    """rows with the rank of value in its group from 1, ties at their average."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = sum_before(counts, by, value, "_n").withColumn(rank, F.col("before") + (F.col("_n") + 1) / 2).select(*by, value, rank)
    return join_groups(rows, ranks, [*by, value])


def first_by_hash(rows: DataFrame, by: str, id_col: str, take: Column, seed: int = 0) -> DataFrame:
    """Of each group the first take entries in the order of a hash, marked: rows (by, id) with picked.

    take may use n, the size of the group. Entries are ranked within the 4,096 blocks of their hash's
    first digits, and blocks by their sums, so a large group is many tasks' work.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    placed = rows.select(by, id_col, h.alias("_h")).withColumn("_block", F.substring("_h", 1, 3))
    sizes = placed.groupBy(by, "_block").agg(F.count("*").alias("_c"))
    run = W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(by, "_block", F.coalesce(F.sum("_c").over(run), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(by)).alias("n"))
    own = placed.withColumn("_i", F.row_number().over(W.partitionBy(by, "_block").orderBy("_h", id_col)))
    joined = join_groups(own, sizes, [by, "_block"]).select(by, id_col, "n", (F.col("_before") + F.col("_i")).alias("_place"))
    return joined.select(by, id_col, (F.col("_place") <= take).alias("picked"))
