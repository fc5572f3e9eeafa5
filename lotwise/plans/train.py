"""Tune, fit, evaluate, log and register a price model."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from lotwise.operators.metrics import metrics_dict
from lotwise.operators.models import linear, penalised_boosting, search
from lotwise.operators.sampling import hash_split
from lotwise.operators.transformers import preprocessor
from lotwise.plans.prepare import CAT_FEATURES, NUM_FEATURES, TARGET
from lotwise.session import spread
from lotwise.sources.runs import log_run, register, save_model


@dataclass
class TrainingResult:
    model: PipelineModel
    params: dict
    metrics: dict
    baseline: dict
    currency_metrics: dict
    run_id: str | None


def fit_full(train: DataFrame, estimator, label: str, numeric: list[str], text: list[str], scaler="standard"):
    """Preprocessing and model as one saved unit. Rows that have to be spread are kept for the passes of both."""
    needed = train.select(*dict.fromkeys([*numeric, *text, label]))
    rows = spread(needed)
    dealt = rows is not needed
    if dealt:
        rows.persist()
    try:
        # quantile sketches of all tasks meet in one, so there are no more of them than cores
        prep = preprocessor(numeric, text, scaler).fit(rows.coalesce(train.sparkSession.sparkContext.defaultParallelism))
        return PipelineModel([*prep.stages, estimator.fit(prep.transform(rows).select("features", label))])
    finally:
        if dealt:
            rows.unpersist()


def train(
    table: DataFrame,
    keys: list[str],
    folder: str | None = None,
    experiment: str = "prices",
    model_name: str = "price_model",
    label: str = TARGET,
    numeric: list[str] = NUM_FEATURES,
    text: list[str] = CAT_FEATURES,
    trials: list[dict] | None = None,
    build=penalised_boosting,
    test_size: float = 0.2,
    seed: int = 42,
) -> TrainingResult:
    """Search on the training part, fit the best setting and a linear baseline, report both on
    the held-out part (log scale, and the currency scale beside it), log and register."""
    spark = table.sparkSession
    rows = spread(table.select(*keys, *numeric, *text, label).where(F.col(label).isNotNull())).persist()
    fit_rows, held = hash_split(rows, keys, test_size, seed)
    params, _ = search(fit_rows, label, numeric, text, keys, trials, build)
    model = fit_full(fit_rows, build(fit_rows, label, **params), label, numeric, text)
    base = fit_full(fit_rows, linear(fit_rows, label), label, numeric, text)
    scored = model.transform(held)
    metrics = metrics_dict(scored, label)
    baseline = metrics_dict(base.transform(held), label)
    money = scored.select(F.exp(label).alias("y"), F.exp("prediction").alias("prediction"))
    run_id = None
    if folder is not None:
        path = save_model(model, f"{folder}/models/{model_name}-{uuid.uuid4().hex}")
        counts = {"n_train": fit_rows.count(), "n_test": held.count()}
        logged = {
            **params, **counts, "dataset_rows": counts["n_train"] + counts["n_test"],
            "dataset_cols": len(table.columns), "test_size": test_size, "random_state": seed,
            "num_features": numeric, "cat_features": text, "target": label,
            "n_trials": len(trials) if trials is not None else 50,
        }
        run_id = log_run(spark, folder, experiment, "tuned_final", logged, metrics, baseline, path)
        register(spark, folder, model_name, run_id, path)
    currency = metrics_dict(money, "y")
    rows.unpersist()
    return TrainingResult(model, params, metrics, baseline, currency, run_id)
