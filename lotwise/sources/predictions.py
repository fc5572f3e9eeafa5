"""Append-only prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotwise.schemas import PREDICTIONS


def prediction_rows(scored: DataFrame, model: str, version: str, price: str = "preco_estimado") -> DataFrame:
    """Scored listings in the layout of the prediction table.

    The id is a uuid, unique without a counter shared between tasks.
    """
    stamped = scored.withColumns(
        {
            "id": F.uuid(),
            "preco_predito": F.col(price),
            "modelo": F.lit(model),
            "versao_modelo": F.lit(version),
            "created_at": F.current_timestamp(),
        }
    )
    have = set(stamped.columns)
    return stamped.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in PREDICTIONS.fields
        ]
    )


def append_predictions(rows: DataFrame, folder: str) -> None:
    """Append, one folder per day. The city is required: a row without one fails the whole append."""
    missing = F.raise_error(F.lit("a prediction has no city")).cast("string")
    (
        rows.withColumn("cidade", F.coalesce("cidade", missing))
        .withColumn("dia", F.to_date("created_at"))
        .write.mode("append")
        .partitionBy("dia")
        .parquet(folder)
    )


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
