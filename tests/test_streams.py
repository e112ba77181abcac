"""Streaming queries over many files in no order of time, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stepwright.plans import registry

from .conftest import DATA
from .test_queries import rows_of


@pytest.mark.parametrize("name", ["stream_daily_counts", "stream_running_totals"])
def test_shuffled_files_lose_nothing(spark, tmp_path, name):
    path = f"{tmp_path}/alignment_stats_summary.parquet"
    rows = spark.read.parquet(f"{DATA}/alignment_stats_summary.parquet")
    # One report without a time, and each file holds reports of all months.
    rows = rows.withColumn("reported_at", F.when(F.col("row_id") != rows.agg(F.min("row_id")).first()[0], F.col("reported_at")))
    rows.repartition(20, F.hash("row_id", "received_at")).write.parquet(path)
    got = registry.queries()[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute("set timezone='UTC'")
    duck.execute(f"create view alignment_stats_summary as from '{path}/*.parquet'")
    r = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert rows_of(cols, got.select(*cols).collect()) == rows_of(cols, [dict(zip(cols, x)) for x in r.fetchall()])


def test_running_totals_add_up_before_the_shuffle(spark):
    from stepwright.streaming import reports as R

    plan = R.running_totals(R.report_stream(spark, f"{DATA}/alignment_stats_summary.parquet"))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "FlatMapGroupsInPandas" not in plan
