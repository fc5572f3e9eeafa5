"""Session settings and the shared folder used for saved models and cut lineage."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture for every column call costs more than the planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "lotwise", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver remove an existing folder when it ends, whatever store it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
        delete_at_exit(spark, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write the rows to the shared folder once and go on from the written table, which goes when the driver ends."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LEAST_ROWS, MOST_ROWS = 10_000, 100_000  # of a task over rows that are read many times


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows that are read many times."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(math.ceil(rows / LEAST_ROWS), max(2 * cores, math.ceil(rows / MOST_ROWS))))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over twice as many tasks as there are cores, more where a task had over MOST_ROWS, fewer where it
    had below LEAST_ROWS. A small file of many rows is read by one or two tasks, and so is all that is derived from it.
    Rows that already lie about as evenly stay where they are; others come in the same order every time."""
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    lie = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    rows = lie["n"] or 0
    tasks = tasks_for(df.sparkSession, rows)
    if tasks == 1 or lie["most"] <= 2 * rows / tasks:
        return df
    hashed = [f"`{c}`" for c, kind in df.dtypes if "map<" not in kind]  # Spark gives maps no hash
    dealt = df.repartition(tasks)
    return dealt.sortWithinPartitions(F.xxhash64(*hashed)) if hashed else dealt
