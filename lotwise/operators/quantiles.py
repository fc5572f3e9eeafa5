"""Exact interpolated quantiles without gathering a column or a group in one task.

A mergeable sketch brackets every wanted rank, one more pass counts what lies outside the
brackets and keeps the few values inside, and the ranks are read off those counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lotwise.functions.numeric import nan_to_null
from lotwise.operators.joins import lookup_join
from lotwise.session import cut_lineage

ACCURACY = 100_000


def melt(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Long form (keys, column, value) of numeric columns; nulls and NaN left out."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    keys = keys or []
    long = df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.column", "_cell.value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _brackets(probs: list[float], accuracy: int) -> tuple[list[float], list[float]]:
    """Sketch probabilities just below and just above each wanted one, in rising order."""
    margin = 2.0 / accuracy
    rising = sorted(probs)
    return [max(0.0, p - margin) for p in rising], [min(1.0, p + margin) for p in rising]


def _cell(x: Column, lows: list[Column], highs: list[Column]) -> tuple[Column, Column]:
    """(number of brackets that end below x, x itself if it lies in a bracket)."""
    inside = reduce(Column.__or__, [x.between(lo, hi) for lo, hi in zip(lows, highs)])
    part = reduce(Column.__add__, [(x > hi).cast("int") for hi in highs])
    return part, F.when(inside, x)


def _read_ranks(cells: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Quantiles from cell counts (keys, n, _part, _in, _c, _min, _max)."""
    running = W.partitionBy(*keys).orderBy("_part", F.col("_in").asc_nulls_first())
    cells = cells.withColumn("_end", F.sum("_c").over(running.rowsBetween(W.unboundedPreceding, 0)))

    def picked(rank: Column) -> Column:
        """Value at a zero-based rank, seen from the cell that holds it."""
        start = F.col("_end") - F.col("_c")
        found = (
            F.when(F.col("_in").isNotNull(), F.col("_in"))
            .when(rank == F.col("_end") - 1, F.col("_max"))
            .when(rank == start, F.col("_min"))
            .otherwise(F.raise_error(F.lit("quantile bracket missed a rank; raise accuracy")).cast("double"))
        )
        return F.max(F.when((rank >= start) & (rank < F.col("_end")), found))

    aggs, out = [], []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(rank)
        # The upper neighbour carries no weight when the rank is whole.
        high = F.when(rank == low, low).otherwise(F.least(low + 1, F.col("n") - 1))
        aggs += [picked(low).alias(f"_f{i}"), picked(high).alias(f"_c{i}")]
        lerp = F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * (rank - low)
        out.append(lerp.alias(f"q{i}"))
    return cells.groupBy(*keys, "n").agg(*aggs).select(*keys, "n", *out)


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    accuracy: int = ACCURACY,
    also: dict | None = None,
    min_rows: int = 1,
) -> DataFrame:
    """One row per group of at least `min_rows` values: keys, n, `also`, and q0..qk.

    Quantiles interpolate linearly. `also` maps names to aggregate functions of the value; they
    ride on the first pass, and groups too small are gone before the second.
    """
    also = also or {}
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & ~F.isnan("_x")
    )
    k = len(probs)
    lows, highs = _brackets(probs, accuracy)
    sketch = F.percentile_approx("_x", F.array(*[F.lit(p) for p in lows + highs]), accuracy)
    brackets = rows.groupBy(*keys).agg(
        F.count("_x").alias("n"), sketch.alias("_b"), *[f("_x").alias(name) for name, f in also.items()]
    )
    brackets = cut_lineage(brackets.where(F.col("n") >= min_rows), "brackets")
    marked = beside_groups(rows, brackets, keys)
    part, inside = _cell(
        F.col("_x"), [F.col("_b")[j] for j in range(k)], [F.col("_b")[k + j] for j in range(k)]
    )
    named = [*keys, *also]
    cells = (
        marked.select(*named, "n", part.alias("_part"), inside.alias("_in"), "_x")
        .groupBy(*named, "n", "_part", "_in")
        .agg(F.count("_x").alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    )
    return _read_ranks(cells, named, probs)


def collect_profile(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    measures: dict | None = None,
    accuracy: int = ACCURACY,
) -> dict[str, dict]:
    """Whole-column figures {column: {measure: value, ..., "q": [one per probability]}}.

    The first pass takes all measures, counts and sketches, the second counts around the sketched brackets.
    Without values a column's "q" is None.
    """
    measures = measures or {}
    lows, highs = _brackets(probs, accuracy)
    wanted = F.array(*[F.lit(p) for p in lows + highs])
    xs = [nan_to_null(F.col(c).cast("double")) for c in cols]
    first = df.agg(
        *[F.count(x).alias(f"_n{i}") for i, x in enumerate(xs)],
        *[F.percentile_approx(x, wanted, accuracy).alias(f"_b{i}") for i, x in enumerate(xs)],
        *[f(x).alias(f"{name}{i}") for i, x in enumerate(xs) for name, f in measures.items()],
    ).first()
    found = {c: {name: first[f"{name}{i}"] for name in measures} for i, c in enumerate(cols)}
    ranks = _second_pass(df, cols, xs, probs, first)
    return {c: {**found[c], "q": ranks.get(c)} for c in cols}


def collect_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    accuracy: int = ACCURACY,
) -> dict[str, list[float]]:
    """Quantiles of whole columns as {column: [one per probability]}; empty columns are absent."""
    found = collect_profile(df, cols, probs, None, accuracy)
    return {c: v["q"] for c, v in found.items() if v["q"] is not None}


def _second_pass(df: DataFrame, cols: list[str], xs: list[Column], probs, first) -> dict:
    counts = [first[f"_n{i}"] for i in range(len(cols))]
    if not any(counts):
        return {}
    k = len(probs)
    names = [f"_{side}{j}" for side in ("lo", "hi") for j in range(k)]
    ends = [(i, counts[i], *first[f"_b{i}"]) for i in range(len(cols)) if counts[i]]
    schema = ", ".join(["_i int", "n long", *[f"{name} double" for name in names]])
    brackets = F.broadcast(df.sparkSession.createDataFrame(ends, schema))
    part, inside = _cell(F.col("_x"), [F.col(c) for c in names[:k]], [F.col(c) for c in names[k:]])
    cells = (
        df.select(F.posexplode(F.array(*xs)).alias("_i", "_x"))
        .where(F.col("_x").isNotNull())
        .join(brackets, "_i")
        .select("_i", "n", part.alias("_part"), inside.alias("_in"), "_x")
        .groupBy("_i", "n", "_part", "_in")
        .agg(F.count("_x").alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    )
    rows = _read_ranks(cells, ["_i"], probs).collect()
    return {cols[r["_i"]]: [r[f"q{j}"] for j in range(k)] for r in rows}


def beside_groups(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with their group's figures; `stats` is a written table of one row per group."""
    return lookup_join(rows, stats, keys, how)


def _most_frequent(counts: DataFrame, key: str) -> DataFrame:
    """Per key the value with the highest `_n`, the smallest one on ties."""
    return counts.groupBy(key).agg(F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias("mode"))


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value per numeric column, the smallest one on ties."""
    xs = [nan_to_null(F.col(c).cast("double")) for c in cols]
    cells = df.select(F.posexplode(F.array(*xs)).alias("_i", "value")).where(F.col("value").isNotNull())
    modes = _most_frequent(cells.groupBy("_i", "value").agg(F.count(F.lit(1)).alias("_n")), "_i")
    names = F.array(*[F.lit(c) for c in cols])
    return modes.select(F.element_at(names, F.col("_i") + 1).alias("column"), "mode")


def text_modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent text per column, the smallest one on ties."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    counts = (
        df.select(F.explode(cells).alias("_cell"))
        .select("_cell.*")
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return {r["column"]: r["mode"] for r in _most_frequent(counts, "column").collect()}
