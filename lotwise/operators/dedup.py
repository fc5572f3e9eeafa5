"""Keep-first deduplication and by-name unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of every key by the given order; null keys count as one key.

    An aggregate instead of a ranking window: copies of a hot key collapse before the shuffle.
    """
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    first = F.min_by(F.struct(*df.columns), F.struct(*ranks))
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(first.alias("_row")).select("_row.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
