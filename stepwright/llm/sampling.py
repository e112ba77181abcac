"""Samples with given category proportions by systematic sampling with unequal probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import dataset_key
from ..runtime import materialize
from .mixing import uniform

#: Rows of a category that are ordered together; larger categories are ordered in several blocks.
BLOCK_ROWS = 20_000


def category_quotas(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row of targets with the entries there are, the number of its category and whether it falls short.

    A row is short if its category has fewer entries than the greater of min_rows and target_share
    times sample_size.
    A target whose class or dataset is null or blank asks for the entries where it is missing. Rows
    of a plan that name one category, in two spellings of the dataset, have the same number cat.
    """
    counted = entries.groupBy("cat_class", "cat_dataset").agg(F.count("*").alias("available"))
    t = targets.select("plan_id", "sample_size", "class", "dataset", "target_share", "min_rows", dataset_key(F.col("dataset")).alias("d"))
    wanted = F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0))
    floor = F.coalesce("min_rows", F.lit(0))
    have = F.coalesce("available", F.lit(0))
    rows = t.join(counted, F.col("class").eqNullSafe(F.col("cat_class")) & F.col("d").eqNullSafe(F.col("cat_dataset")), "left")
    order = W.partitionBy("plan_id").orderBy("class", "d")
    return rows.select(
        F.dense_rank().over(order).alias("cat"),
        "plan_id",
        "sample_size",
        "class",
        "dataset",
        "d",
        "target_share",
        "min_rows",
        wanted.alias("wanted"),
        F.least(floor, have).alias("floor"),
        have.alias("available"),
        (have < F.greatest(floor.cast("double"), wanted)).alias("short"),
    )


def sample_plans(
    entries: DataFrame, targets: DataFrame, seed: int = 23, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Draw the sample of each plan of targets; returns (sample, report).

    sample: (plan_id, entry_id, class, dataset); report: one row per row of targets with wanted,
    available and selected entries, and short. class is compared as it stands, dataset without case
    and outer blanks.

    All entries of a plan stand in one line, by category and in random order within it. Their
    inclusion probabilities are summed along the line, first over blocks of the line and then within
    each block, and an entry is selected where the sum, begun at one random start, passes a whole
    number. Then categories below their floor (min_rows, or all there are) get the next entries of
    their order, and as many are taken, in proportion to what exceeds their floor, from the others.
    Rows of targets that name one category add up, and each reports the category's selected entries.
    An entry_id that occurs twice is two entries with neighbouring places. Empty tables give an empty
    sample, and a report in which every wanted row is short.
    """
    clean = entries.select("entry_id", F.col("class").alias("cat_class"), dataset_key(F.col("dataset")).alias("cat_dataset"), "dataset")
    rows = materialize(category_quotas(clean, targets), "rows")
    have, all_wanted = F.max("available"), F.sum(F.greatest("wanted", F.lit(0.0)))
    quotas = materialize(
        rows.groupBy("plan_id", "cat").agg(
            F.max("sample_size").alias("sample_size"), F.min("class").alias("class"), F.min("d").alias("d"), have.alias("available"), F.least(F.sum("floor"), have).alias("floor"),
            F.when(have > 0, F.least(all_wanted / have, F.lit(1.0))).otherwise(F.lit(0.0)).alias("p"),
        ),
        "quotas",
    )
    start = quotas.select("plan_id").distinct().select("plan_id", uniform("plan_id", F.lit("start"), seed=seed).alias("start"))
    match = F.col("class").eqNullSafe(F.col("cat_class")) & F.col("d").eqNullSafe(F.col("cat_dataset"))
    # targets don't grow with the entries, so Spark broadcasts the quotas by their size.
    line = (
        clean.join(quotas.select("plan_id", "cat", "class", "d", "p", "available"), match)
        .withColumn("u", uniform("plan_id", "entry_id", seed=seed))
        .withColumn("block", F.floor(F.col("u") * F.ceil(F.col("available") / block_rows)))
        .select("plan_id", "cat", "block", "u", "entry_id", "class", "dataset", "p")
    )
    line = materialize(line, "line")
    blocks = line.groupBy("plan_id", "cat", "block").agg(F.count("*").alias("n"), F.first("p").alias("p"))
    along = W.partitionBy("plan_id").orderBy("cat", "block").rowsBetween(W.unboundedPreceding, -1)
    in_cat = W.partitionBy("plan_id", "cat").orderBy("block")
    sums = (
        blocks.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("p")).over(along), F.lit(0.0)))
        .join(start, "plan_id")
        .withColumn("before", F.col("before") + F.col("start"))
        .select(
            "plan_id",
            "cat",
            "block",
            "before",
            F.floor(F.first("before").over(in_cat)).alias("cat_before"),
            F.coalesce(F.sum("n").over(in_cat.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rank_before"),
        )
    )
    inside = F.row_number().over(W.partitionBy("plan_id", "cat", "block").orderBy("u", "entry_id"))
    upto = F.floor(F.col("before") + F.col("place") * F.col("p"))
    crossed = upto > F.floor(F.col("before") + (F.col("place") - 1) * F.col("p"))
    # Of a category's entries up to this one, upto - cat_before were crossed and the rest not.
    placed = materialize(
        line.withColumn("place", inside)
        .join(sums, ["plan_id", "cat", "block"])
        .select("plan_id", "cat", "entry_id", "class", "dataset", crossed.alias("crossed"), (upto - F.col("cat_before")).alias("crossings"), (F.col("rank_before") + F.col("place")).alias("rank"))
        .withColumn("turn", F.when(F.col("crossed"), F.col("crossings")).otherwise(F.col("rank") - F.col("crossings"))),
        "placed",
    )
    # Repair, on one row per category. Kept are the crossings first, then the next of the order.
    drawn = placed.where("crossed").groupBy("plan_id", "cat").agg(F.count("*").alias("drawn"))
    plan = W.partitionBy("plan_id")
    steps = W.partitionBy("plan_id").orderBy("cat")
    need = (
        quotas.join(drawn, ["plan_id", "cat"], "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("raised", F.greatest("drawn", "floor"))
        .withColumn("spare", F.greatest(F.col("raised") - F.col("floor"), F.lit(0)))
        .withColumn("excess", F.greatest(F.sum("raised").over(plan) - F.greatest(F.col("sample_size"), F.lit(0)), F.lit(0)))
        .withColumn("excess", F.least("excess", F.sum("spare").over(plan)))
        .withColumn("part", F.try_divide(F.col("excess"), F.sum("spare").over(plan)))
        .withColumn("cut_to", F.round(F.coalesce(F.col("part") * F.sum("spare").over(steps), F.lit(0.0))))
        .withColumn("take", F.col("raised") - (F.col("cut_to") - F.coalesce(F.lag("cut_to").over(steps), F.lit(0.0))).cast("long"))
    )
    need = materialize(need, "need")
    wanted = placed.join(need.select("plan_id", "cat", "take", "drawn"), ["plan_id", "cat"])
    keep = F.when(F.col("crossed"), F.col("turn") <= F.col("take")).otherwise(F.col("turn") <= F.col("take") - F.col("drawn"))
    sample = wanted.where(keep).select("plan_id", "entry_id", "class", "dataset")
    report = rows.join(need.select("plan_id", "cat", "take"), ["plan_id", "cat"]).select(
        "plan_id", "class", "dataset", "target_share", "min_rows", "sample_size", "wanted", "available", F.col("take").alias("selected"), "short"
    )
    return sample, report
