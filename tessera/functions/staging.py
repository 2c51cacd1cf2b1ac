"""Intermediate tables that a job reads more than once, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task sorts, about.
ROWS_PER_TASK = 1 << 19


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names; a temporary one where it is unset on a local master (tests)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and written there; its lineage ends."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df computed once as Parquet files there, for tables of many rows: a fraction of what a checkpoint takes, but rows lose their partitioning."""
    checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_methods(value: Column) -> Column:
    """The value, by way of a lambda, for steps of many expressions.

    Spark compiles a step without lambdas into one method, and the JVM interprets methods of more than 8000 bytes for good; a step
    with a lambda becomes many small methods.  The value itself is interpreted, so it should be a cheap one.
    """
    return F.get(F.transform(F.array(value), lambda v: v), F.lit(0))


def dealt(df: DataFrame, *keys: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """df by keys in partitions whose number grows with its rows, so that what a task sorts doesn't; at least as many as other shuffles have.

    df is counted first and should be a table as it is read.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_per_task + 1)
    return df.repartition(tasks, *keys)


def in_ranges(rows: DataFrame, *cols: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """rows sorted by cols over all partitions and staged so; partitions grow in number with rows, and equal values of the first cols may span several.

    rows is counted first and should be a table as it is read, with few rows that are equal in all cols.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // rows_per_task + 1)
    return checkpointed(rows.repartitionByRange(tasks, *cols).sortWithinPartitions(*cols))


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with _place, from 1 in order within `by`, and _n, how many rows `by` has; rows with a null in `by` are left out.

    A row's place is that in its range after the rows of earlier ranges, so no task holds a group whole.
    """
    at = in_ranges(rows.dropna(subset=by), *by, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    counts = at.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "_range", (F.col("_first") - before).alias("_zero"), F.sum("_rows").over(w).alias("_n"))
    return at.join(starts, [*by, "_range"]).withColumn("_place", F.col("_at") - F.col("_zero") + 1).drop("_at", "_range", "_zero")
