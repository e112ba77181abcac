"""The run manifest: cleaning, labels, weights, splits and comparison with the reads at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import dataset_key, file_key, run_key
from .ranks import first_by_hash

# Labels of records without a peptide of their own, and how mixtures are named.
UNKNOWN = "^(unassigned|dna-blank)$"
MIXTURE = "^mix"


def clean_entries(rows: DataFrame) -> DataFrame:
    """(entry_id, run, file, class, dataset) in normal forms; blanks are null."""
    return rows.select(
        "entry_id",
        run_key(F.col("run_name")).alias("run"),
        file_key(F.col("file_path")).alias("file"),
        F.col("class"),
        dataset_key(F.col("dataset")).alias("dataset"),
    )


def first_entries(clean: DataFrame) -> DataFrame:
    """Of each run the entry that is listed first; entries without run are left out."""
    first = F.min(F.struct("entry_id", "file", "class", "dataset")).alias("f")
    return clean.where("run is not null").groupBy("run").agg(first).select("run", "f.*")


def class_by_dataset(clean: DataFrame) -> DataFrame:
    """Entries per class, and in train, test and neither; nulls are a class."""
    d = F.col("dataset")
    return clean.groupBy("class").agg(
        F.count("*").alias("n"),
        F.count_if(d == "train").alias("n_train"),
        F.count_if(d == "test").alias("n_test"),
        F.count_if(d.isNull() | ~d.isin("train", "test")).alias("n_other"),
    )


def replicate_labels(clean: DataFrame) -> DataFrame:
    """Runs of a class numbered in order of their names: (class, run, replicate), such as KORV7-rep2.

    Names of digits only are ordered as numbers, before the others. One window per class goes over its
    different runs, of which there are thousands at most, not over entries or reads.
    """
    runs = clean.where("run is not null and class is not null").select("class", "run").distinct()
    number = F.row_number().over(W.partitionBy("class").orderBy(F.when(F.col("run").rlike("^[0-9]{1,18}$"), F.col("run").cast("long")).asc_nulls_last(), "run"))
    return runs.select("class", "run", F.concat("class", F.lit("-rep"), number).alias("replicate"))


def class_weights(clean: DataFrame) -> DataFrame:
    """Balanced weights n / (k * n_class), for classes of at least two entries."""
    counts = clean.where("class is not null").groupBy("class").agg(F.count("*").alias("n")).where("n >= 2")
    total = counts.agg(F.sum("n").alias("all_n"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("class", "n", (F.col("all_n") / (F.col("k") * F.col("n"))).alias("weight"))


def imbalance(clean: DataFrame, limit: float = 2.0) -> DataFrame:
    """Ratio of the largest to the smallest class, and whether a weighted loss is due."""
    counts = clean.where("class is not null").groupBy("class").agg(F.count("*").alias("n"))
    ratio = F.try_divide(F.max("n"), F.min("n"))
    return counts.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), ratio.alias("ratio")).withColumn("weighted", F.coalesce(F.col("ratio") >= limit, F.lit(False)))


def stratified_split(clean: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Of each class round(share * n) entries for validation, drawn by a hash: (entry_id, class, part)."""
    picked = first_by_hash(clean, "class", "entry_id", F.round(F.col("n") * share), seed)
    return picked.select("entry_id", "class", F.when(F.col("picked"), "validation").otherwise("train").alias("part"))


def label_group(label: Column) -> Column:
    """unknown, mixture or known; null labels are unknown."""
    low = F.lower(label)
    return F.when(label.isNull() | low.rlike(UNKNOWN), "unknown").when(low.rlike(MIXTURE), "mixture").otherwise("known")


def unseen_runs(clean: DataFrame, reads: DataFrame) -> DataFrame:
    """Runs of the reads which the manifest lacks, and the other way round: (run, missing_in)."""
    listed = clean.select("run").where("run is not null").distinct()
    read = reads.select(run_key(F.col("run_name")).alias("run")).where("run is not null").distinct()
    a = read.join(listed, "run", "left_anti").withColumn("missing_in", F.lit("manifest"))
    return a.unionByName(listed.join(read, "run", "left_anti").withColumn("missing_in", F.lit("reads")))


def renamed_entries(clean: DataFrame) -> DataFrame:
    """Entries whose file lies in the folder of another run: (entry_id, run, folder)."""
    folder = F.split("file", "/")[0]
    return clean.where("run is not null and file is not null").withColumn("folder", folder).where("folder <> run").select("entry_id", "run", "folder")


def path_parts(clean: DataFrame) -> DataFrame:
    """Run folder and reference of each file, and files per reference."""
    parts = F.split("file", "/")
    return clean.where("file is not null").groupBy(F.get(parts, F.lit(1)).alias("reference")).agg(F.count("*").alias("n"), F.countDistinct(F.get(parts, F.lit(0))).alias("n_runs"))
