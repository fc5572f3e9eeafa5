"""Reproducible samples and splits that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def key_hash(keys: list[str], seed: int = 42) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_split(df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = 42):
    """(train, test) by a hash of the row key."""
    cut = format(int(round((1 - test_size) * 2**32)), "08x")
    in_train = F.substring(key_hash(keys, seed), 1, 8) < F.lit(cut)
    return df.where(in_train), df.where(~in_train)


def stable_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """`n` rows without replacement: those with the smallest key hashes."""
    mark = key_hash(keys, seed)
    return df.orderBy(mark, *keys).limit(n)


def ranked(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Row numbers over a report that is small by construction (models, settings, versions)."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))
