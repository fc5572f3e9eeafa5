"""Continuous scoring of arriving listings into the prediction table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def score_stream(
    stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], table: str, checkpoint: str
) -> None:
    """Each micro-batch is scored and written to its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{table}/lote={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
