"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Local sessions without spark.checkpoint.dir share this folder; a cluster must name its own.
_LOCAL_SHARED: dict[str, str] = {}
_SHIPPED: set[str] = set()


def get_spark(app: str = "stepwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow transfer; conf keys use '_' for '.'."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that no node has to have it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stepwright-"), "stepwright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: spark.checkpoint.dir, or a temporary one in local sessions."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="stepwright-")
    return "file://" + _LOCAL_SHARED[app]


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage with data that survive the loss of executors, fixes non-deterministic
    values, and gives the planner the table's true size, so that it broadcasts only what is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stepwright/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by materialize; other frames are left alone."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stepwright/" in f:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
