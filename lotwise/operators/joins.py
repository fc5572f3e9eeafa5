"""Joins against lookup tables that hold each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotwise.session import cut_lineage


def lookup_join(left: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", written: bool = True) -> DataFrame:
    """Left or inner join to a table that holds each key once.

    One plan that reads the left side once, at any size: adaptive execution broadcasts the lookup where its measured
    bytes allow it, and splits the left rows of a frequent key, or of null, among tasks where they do not. For the
    latter both sides must come straight from a shuffle, so a computed lookup (`written=False`) is written first.
    """
    return left.join(lookup if written else cut_lineage(lookup, "lookup"), on, how)


def pending_keys(df: DataFrame, key: str, cache: DataFrame, cache_key: str | None = None) -> DataFrame:
    """Distinct non-null keys that the cache does not hold yet."""
    known = cache.select(F.col(cache_key or key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).select(key).distinct().join(known, key, "left_anti")
