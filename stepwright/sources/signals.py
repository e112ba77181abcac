"""Reads with their signals: parsing, filters, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a signal table, in their order.
SIGNAL_SCHEMA = T.StructType(
    [T.StructField("read_id", T.StringType()), T.StructField("ref_start", T.IntegerType()), T.StructField("ref_end", T.IntegerType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("global_median", "global_mad", "global_median_excl_plr", "global_mad_excl_plr", "median_before_plr", "mad_before_plr")
    ]
    + [T.StructField("signal", T.StringType())]
)


def parse_signal(text: Column) -> Column:
    """The samples of a signal text as ARRAY<DOUBLE>: finite numbers only; null texts give an empty array."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    values = F.transform(words, lambda w: w.try_cast("double"))
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def format_signal(values: Column) -> Column:
    """Samples as text, apart by blanks."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


def reads_once(rows: DataFrame, signal: bool = True) -> DataFrame:
    """Each read once, as first received, with its signal parsed into x; rows without read_id are left out.

    Ties in the time of receipt go to the first run name, nulls first. Without signal its text isn't
    even read: what needs only a read's numbers should not shuffle its samples.
    """
    names = [f.name for f in SIGNAL_SCHEMA if f.name != "read_id" and (signal or f.name != "signal")]
    first = F.min(F.struct("received_at", "run_name", "class", *names, "acquired_at")).alias("r")
    once = rows.where("read_id is not null").groupBy("read_id").agg(first).select("read_id", "r.*")
    return once.withColumn("x", parse_signal(F.col("signal"))) if signal else once


def spanning(rows: DataFrame, start_by: int = 30, end_from: int = 110) -> DataFrame:
    """Reads whose aligned span covers the given positions, both ends included."""
    return rows.where((F.col("ref_start") <= start_by) & (F.col("ref_end") >= end_from))


def read_signal_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Signal tables in tab-separated text with a header; files with a header only give no rows."""
    return spark.read.schema(SIGNAL_SCHEMA).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_signal_tsv(rows: DataFrame, path: str) -> None:
    """Write rows in the fixed columns; x, if there, becomes the signal text."""
    out = rows.withColumn("signal", format_signal(F.col("x"))) if "x" in rows.columns else rows
    out.select([f.name for f in SIGNAL_SCHEMA]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Manifests in CSV; rows with fewer fields have nulls at the end, blank fields are null."""
    schema = "run_name string, file_path string, class string, dataset string"
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return rows.select(*[F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c) for c in rows.columns])


def read_metric_json(spark: SparkSession, path: str) -> DataFrame:
    """Metric documents, one JSON object per file, with a map of counts per reference."""
    schema = "run string, reference string, basecalled_reads bigint, aligned_reads_to_ref bigint, per_ref_idxstats map<string,bigint>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment text: name, flag, reference, position (from 1) and CIGAR; header lines are skipped."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where("value not like '@%' and value <> ''")
    return lines.select(f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("int").alias("pos"), f[5].alias("cigar"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Alignments as intervals from 0, end exclusive."""
    schema = "chrom string, start int, `end` int, name string, score int, strand string"
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def cigar_span(cigar: Column) -> Column:
    """Reference positions that a CIGAR covers: the lengths of its M, D, N, = and X."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(parts, F.lit(0), lambda a, p: a + p.cast("int"))
