"""Regression metrics as one aggregate."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F


def metric_columns(label: str, prediction: str) -> list[Column]:
    y, e = F.col(label), F.col(label) - F.col(prediction)
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    floor = F.greatest(F.abs(y), F.lit(sys.float_info.epsilon))
    r2 = F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return [
        r2.alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / floor).alias("mape"),
        F.avg(e * e).alias("mse"),
    ]


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """r2, rmse, mae, mape, mse over rows that have both values, of all rows or a row for each group."""
    both = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return both.groupBy(*by).agg(*metric_columns(label, prediction))


def metrics_dict(df: DataFrame, label: str, prediction: str = "prediction") -> dict[str, float]:
    return regression_metrics(df, label, prediction).first().asDict()
