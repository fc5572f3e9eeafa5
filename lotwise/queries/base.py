"""Registry of queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; a trailing underscore only avoids a name clash."""

    def register(fn):
        name = fn.__name__.rstrip("_")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(col: Column | str, digits: int) -> Column:
    """Rounded, with minus zero folded into zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


def with_place(df: DataFrame, key: str) -> DataFrame:
    """Coordinates by formula; the tables carry none."""
    k = F.col(key)
    return df.withColumns(
        {
            "lat": F.lit(-25.0) - ((k * 7919) % 2000) / F.lit(10000.0),
            "lon": F.lit(-50.0) - ((k * 104729) % 3000) / F.lit(10000.0),
        }
    )


def place_sql(key: str) -> str:
    return (
        f"-25.0::double - (({key} * 7919) % 2000) / 10000.0::double AS lat, "
        f"-50.0::double - (({key} * 104729) % 3000) / 10000.0::double AS lon"
    )


def ols2_sql(source: str, y: str, x1: str, x2: str) -> str:
    """CTEs t(y, x1, x2), m (moments) and b (b0, b1, b2) of a two-predictor regression."""
    return f"""
    t AS (SELECT *, CAST({y} AS DOUBLE) AS y, CAST({x1} AS DOUBLE) AS x1, CAST({x2} AS DOUBLE) AS x2 FROM {source}),
    m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22,
                 covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, var_pop(y) AS syy FROM t),
    c AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM m),
    s AS (SELECT *, (s22 * s1y - s12 * s2y) / det AS b1, (s11 * s2y - s12 * s1y) / det AS b2 FROM c),
    b AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (syy - b1 * s1y - b2 * s2y) AS sse FROM s)"""
