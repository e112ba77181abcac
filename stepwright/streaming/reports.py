"""Alignment reports as a stream: late and repeated deliveries, counts by day of report, running state per run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import shared_dir

#: State is kept on the executors' disks, with so much memory of each, not in their heaps.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def report_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Reports as they arrive in files under path; the schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        # A stream watches folders: that of a single file, for this name only.
        return source.option("pathGlobFilter", where.getName()).option("recursiveFileLookup", "false").parquet(path.rsplit("/", 1)[0])
    return source.parquet(path)


def once(stream: DataFrame) -> DataFrame:
    """Each report once, however late and in whatever order of files it comes.

    There is no watermark: it would give up reports that are older than those of earlier files. The
    state is one row_id per report and is kept on disk (see drain).
    """
    return stream.dropDuplicates(["row_id"])


def daily_counts(stream: DataFrame) -> DataFrame:
    """Reports and reads per UTC day of report and reference; reports without a time are a day of their own (null)."""
    day = F.date_format("reported_at", "yyyy-MM-dd").alias("day")
    return once(stream).groupBy(day, "reference").agg(F.count("*").alias("n_reports"), F.sum("count").alias("n_reads"))


def running_totals(stream: DataFrame) -> DataFrame:
    """Per run its reports and reads so far; they are added up before the shuffle, so a large run is no single task's work."""
    rows = once(stream).where("run is not null")
    return rows.groupBy("run").agg(F.count("*").alias("n_reports"), F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("n_reads"))


def drain(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a stream over what there is now and return its last result per key, from a table in the shared folder."""
    spark = stream.sparkSession
    for k, v in STATE.items():
        spark.conf.set(k, v)
    root = f"{shared_dir(spark)}/stepwright/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: keep(b.drop("batch"), i)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{root}/out")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
