"""Per-key results although a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: Items the sketch tracks per heavy key that is possible: its error stays far below the least share.
TRACK = 64


def sketch_keys(rows: DataFrame, key: str, least_share: float = 0.05) -> DataFrame:
    """One row, written: the number of all rows, and the values of key that may hold least_share of them (all_rows, keys).

    One pass with a sketch of frequent items per partition, merged. A value with that share of all
    rows is always among the candidates: the sketch tracks TRACK values for each heavy one that is
    possible, so its error is below a sixty-fourth of the least share. At most 1 / least_share values
    can be heavy, and twice as many candidates are returned. Null is no value.
    """
    possible = int(1 / least_share) + 1
    tracked = 1 << (possible * TRACK - 1).bit_length()
    sketch = F.expr(f"approx_top_k({key}, {2 * possible + 1}, {tracked})")
    one = rows.agg(F.count("*").alias("all_rows"), sketch.alias("top"))
    return materialize(one.select("all_rows", F.array_compact(F.transform("top", lambda t: t["item"])).alias("keys")), "sketch")


def heavy_candidates(rows: DataFrame, key: str, least_share: float = 0.05, sketch: DataFrame | None = None) -> DataFrame:
    """The candidates of sketch_keys as rows (key_value), to be broadcast: they are few by construction."""
    sketch = sketch if sketch is not None else sketch_keys(rows, key, least_share)
    return F.broadcast(sketch.select(F.explode("keys").alias("key_value")))


def skew_aggregate(
    rows: DataFrame,
    key: str,
    aggs: list[Column],
    least_share: float = 0.05,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """Aggregates per key: (key_value, heavy, n_rows, row_share, aggs...), for keys of any imbalance.

    Candidates for heavy keys come from a sketch; they are few by construction and go to all tasks by
    a broadcast join, where their rows are aggregated in place, wherever they are, and only partial
    results travel. All other keys take an ordinary shuffle. Both results are put together.

    heavy is exact: n_rows of at least least_share of all rows, those with a null key included in all
    rows but no key of their own. aggs must be aggregates of the rows' columns that Spark evaluates in
    two steps; distinct counts belong in skew_distinct. Empty tables give no rows.
    """
    sketch = sketch if sketch is not None else sketch_keys(rows, key, least_share)
    heavy = heavy_candidates(rows, key, least_share, sketch)
    keyed = rows.where(F.col(key).isNotNull())
    on = F.col(key) == F.col("key_value")
    total = sketch.select("all_rows")
    named = [F.count("*").alias("n_rows"), *aggs]
    in_place = keyed.join(heavy, on).groupBy("key_value").agg(*named)
    shuffled = keyed.join(heavy, on, "left_anti").groupBy(F.col(key).alias("key_value")).agg(*named)
    names = in_place.columns[2:]
    return (
        in_place.unionByName(shuffled)
        .crossJoin(F.broadcast(total))
        .select(
            "key_value",
            (F.col("n_rows") >= F.lit(least_share) * F.col("all_rows")).alias("heavy"),
            "n_rows",
            (F.col("n_rows") / F.col("all_rows")).alias("row_share"),
            *names,
        )
    )


def skew_distinct(rows: DataFrame, key: str, value: str, salts: int = 64, least_share: float = 0.05, sketch: DataFrame | None = None) -> DataFrame:
    """Exact number of different values per key: (key_value, n_distinct); null values don't count.

    The values of heavy keys are dealt to salts by hash and counted there, so one key is many tasks'
    work; the other keys are counted after an ordinary shuffle.
    """
    heavy = heavy_candidates(rows, key, least_share, sketch)
    keyed = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where("k is not null")
    salted = (
        keyed.join(heavy, F.col("k") == F.col("key_value"))
        .withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
        .groupBy("key_value", "salt")
        .agg(F.countDistinct("v").alias("n"))
        .groupBy("key_value")
        .agg(F.sum("n").alias("n_distinct"))
    )
    rest = (
        keyed.join(heavy, F.col("k") == F.col("key_value"), "left_anti")
        .groupBy(F.col("k").alias("key_value"))
        .agg(F.countDistinct("v").alias("n_distinct"))
    )
    return salted.unionByName(rest)


def skew_join(rows: DataFrame, dim: DataFrame, key: str, least_share: float = 0.05, sketch: DataFrame | None = None) -> DataFrame:
    """rows joined with dim on key, inner, dim having at most one row per key.

    dim's rows of the heavy keys are few and are broadcast; the other keys join by a shuffle. Columns
    of the same name on both sides, but for the key, get the suffix _dim on dim's side. Null keys
    join nothing.
    """
    clash = set(rows.columns) & set(dim.columns) - {key}
    for c in clash:
        dim = dim.withColumnRenamed(c, f"{c}_dim")
    heavy = F.broadcast(heavy_candidates(rows, key, least_share, sketch).withColumnRenamed("key_value", "heavy_key"))
    on = F.col(key) == F.col("heavy_key")
    heavy_dim = dim.join(heavy, on, "left_semi")
    big = rows.join(heavy, on, "left_semi").join(F.broadcast(heavy_dim), key)
    small = rows.join(heavy, on, "left_anti").join(dim.join(heavy, on, "left_anti").hint("shuffle_merge"), key)
    return big.unionByName(small)
