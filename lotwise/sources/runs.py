"""Run log, model registry and saved models as plain tables and folders."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lotwise.schemas import REGISTRATIONS, RUNS


def log_run(
    spark: SparkSession,
    folder: str,
    experiment: str,
    run_name: str,
    params: dict,
    metrics: dict,
    baseline: dict | None = None,
    model_path: str | None = None,
    start_time: datetime | None = None,
) -> str:
    """Append one run; baseline metrics get the prefix 'baseline_'. Returns the run id."""
    run_id = uuid.uuid4().hex
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    values = {k: float(v) for k, v in metrics.items()}
    values.update({f"baseline_{k}": float(v) for k, v in (baseline or {}).items()})
    row = (
        run_id, experiment, run_name, start_time or now, now,
        {k: str(v) for k, v in params.items()}, values, model_path,
    )
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    return run_id


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(f"{folder}/runs")


def latest_run(runs: DataFrame, experiment: str) -> DataFrame:
    return runs.where(F.col("experiment") == experiment).orderBy(F.desc("start_time"), F.desc("run_id")).limit(1)


def latest_runs(runs: DataFrame) -> DataFrame:
    """(experiment, run_id) of every experiment's latest run, by one aggregate."""
    return runs.groupBy("experiment").agg(F.max_by("run_id", F.struct("start_time", "run_id")).alias("run_id"))


def register(spark: SparkSession, folder: str, name: str, run_id: str, source: str) -> None:
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    row = (name, run_id, now, source)
    spark.createDataFrame([row], REGISTRATIONS).coalesce(1).write.mode("append").parquet(f"{folder}/registry")


def versions(registrations: DataFrame) -> DataFrame:
    """Registrations numbered per model name in order of creation."""
    order = W.partitionBy("name").orderBy("created_at", "run_id")
    return registrations.withColumn("version", F.row_number().over(order))


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(
    spark: SparkSession,
    folder: str | None = None,
    experiment: str | None = None,
    run_id: str | None = None,
    model_path: str | None = None,
) -> PipelineModel:
    """Saved model by path, else by run id, else of the experiment's latest run."""
    if model_path:
        return PipelineModel.load(model_path)
    runs = read_runs(spark, folder)
    found = runs.where(F.col("run_id") == run_id) if run_id else latest_run(runs, experiment)
    row = found.select("model_path").first()
    if row is None or row["model_path"] is None:
        raise LookupError("no saved model for this run or experiment; train first")
    return PipelineModel.load(row["model_path"])
