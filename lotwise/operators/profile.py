"""Descriptive statistics; each report shares scans over the table."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.functions.numeric import nan_to_null
from lotwise.operators.quantiles import (
    beside_groups,
    collect_profile,
    collect_quantiles,
    column_modes,
    grouped_quantiles,
    melt,
)
from lotwise.session import cut_lineage


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]


def columns_like(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def percent_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def describe(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std (n-1), min, quantiles, max: one row per column."""
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = collect_profile(df, cols, list(probs), measures)
    names = [percent_name(p) for p in probs]
    rows = [(c, *[v[m] for m in measures], *(v["q"] or [None] * len(names))) for c, v in found.items()]
    schema = "column string, count long, mean double, std double, min double, max double"
    return df.sparkSession.createDataFrame(rows, ", ".join([schema, *[f"{n} double" for n in names]]))


def corrected_skew(n: Column, g1: Column) -> Column:
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def detailed_statistics(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """mean, median, mode, std, variance, skewness, kurtosis, min, max, range per column."""
    cols = cols or numeric_columns(df)
    measures = {
        "n": lambda x: F.count(x).cast("double"), "mean": F.avg, "std": F.stddev_samp, "variance": F.var_samp,
        "g1": F.skewness, "g2": F.kurtosis, "min": F.min, "max": F.max,
    }
    found = collect_profile(df, cols, [0.5], measures)
    rows = [(c, *[v[m] for m in measures], v["q"][0] if v["q"] else None) for c, v in found.items()]
    schema = ", ".join(["column string", *[f"{m} double" for m in measures], "median double"])
    n, flat = F.col("n"), F.col("variance") == 0
    base = df.sparkSession.createDataFrame(rows, schema).withColumns(
        {
            "skewness": F.when(flat & (n >= 3), F.lit(0.0)).otherwise(corrected_skew(n, F.col("g1"))),
            "kurtosis": F.when(flat & (n >= 4), F.lit(0.0)).otherwise(corrected_kurtosis(n, F.col("g2"))),
            "range": F.col("max") - F.col("min"),
        }
    )
    return base.join(F.broadcast(column_modes(df, cols)), "column", "left").select(
        "column", "mean", "median", "mode", "std", "variance", "skewness", "kurtosis", "min", "max", "range"
    )


def value_counts(df: DataFrame, col: str, order: Column | None = None, top: int | None = None) -> DataFrame:
    """Counts and shares of the non-null values, most frequent first."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    shares = counts.withColumn("share", F.col("n") / total.scalar())
    ordered = shares.orderBy(order) if order is not None else shares.orderBy(F.desc("n"), F.asc(col))
    return ordered.limit(top) if top else ordered


def group_stats(df: DataFrame, key: str, value: str, min_rows: int = 30) -> DataFrame:
    """Median, mean and row count per group with at least `min_rows` rows, by median."""
    rows = df.where(F.col(key).isNotNull())
    stats = grouped_quantiles(rows, [key], value, [0.5], also={"mean": F.avg}, min_rows=min_rows)
    return stats.select(key, F.col("q0").alias("median"), "mean", "n").orderBy("median", key)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts of `bins` equal-width bins over [min, max]; the last bin is closed. NaN counts as null."""
    x = nan_to_null(F.col(col).cast("double"))
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    place = F.coalesce(F.try_divide((x - lo) * bins, hi - lo), F.lit(0.0))
    index = F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("low"),
        (lo + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


TERMS = 15  # moments of a cell
CELL = 0.5  # width of a cell in bandwidths
REACH = 9.0  # bandwidths beyond which the kernel, below 1e-17, is left out


def kernel_density(df: DataFrame, col: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian density on an even grid, Scott bandwidth, grid cut bandwidths past the ends.

    Values are added up as moments of cells half a bandwidth wide, in one aggregate; the kernel of a cell's values at a grid
    point is its Hermite series in those moments. So what is laid out are cells and grid points, not values. With |u| at
    most a quarter the terms left out are below sum(|u|^k / sqrt(k!), k >= 15), that is 1e-15 of a kernel's peak per value.
    Fewer than two different values have no bandwidth and are refused.
    """
    x = nan_to_null(F.col(col).cast("double"))
    s = (
        df.where(x.isNotNull())
        .agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        .first()
    )
    if not s["sd"]:
        raise ValueError(f"a density needs two different values in {col}")
    h = s["sd"] * s["n"] ** (-0.2)
    low, high = s["lo"] - cut * h, s["hi"] + cut * h
    step, width = (high - low) / (points - 1), CELL * h
    norm = 1.0 / (s["n"] * h * math.sqrt(2 * math.pi))
    cell = F.floor((x - F.lit(low)) / F.lit(width))
    centre = F.lit(low) + (F.col("_cell") + 0.5) * F.lit(width)
    u = (F.col("_x") - centre) / F.lit(h)
    cells = (
        df.where(x.isNotNull()).select(x.alias("_x"), cell.alias("_cell"))
        .select("_cell", u.alias("_u"))
        .groupBy("_cell")
        .agg(F.array(*[F.sum(F.pow("_u", F.lit(k)) / F.lit(float(math.factorial(k)))) for k in range(TERMS)]).alias("_m"))
    )
    first = F.ceil((centre - F.lit(REACH * h + low)) / F.lit(step))
    last = F.floor((centre + F.lit(REACH * h - low)) / F.lit(step))
    near = cells.withColumns({
        "_centre": centre, "_first": F.greatest(first, F.lit(0)).cast("int"), "_last": F.least(last, F.lit(points - 1)).cast("int")
    }).where("_first <= _last")
    met = near.select("_m", "_centre", F.explode(F.sequence("_first", "_last")).alias("point"))
    t = (F.lit(low) + F.col("point") * F.lit(step) - F.col("_centre")) / F.lit(h)
    # He(k + 1) = t He(k) - k He(k - 1), beside the sum of moment times He
    start = F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("here"), F.lit(0.0).alias("total"), F.lit(0.0).alias("k"))

    def term(state: Column, moment: Column) -> Column:
        return F.struct(
            state["here"].alias("before"), (F.col("_t") * state["here"] - state["k"] * state["before"]).alias("here"),
            (state["total"] + moment * state["here"]).alias("total"), (state["k"] + 1).alias("k"),
        )

    share = F.exp(-F.col("_t") * F.col("_t") / 2) * F.aggregate("_m", start, term)["total"]
    sums = met.withColumn("_t", t).groupBy("point").agg((F.sum(share) * F.lit(norm)).alias("density"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    return grid.join(sums, "point", "left").select(
        "point", F.coalesce("density", F.lit(0.0)).alias("density"), (F.lit(low) + F.col("point") * F.lit(step)).alias("x")
    )


def boxplot(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles and whiskers per group: the outermost values inside the 1.5 IQR fences."""
    x = nan_to_null(F.col(value).cast("double"))
    counts = (
        df.where(F.col(key).isNotNull() & x.isNotNull())
        .groupBy(key, x.alias("_x"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    q = grouped_quantiles(df.where(F.col(key).isNotNull()), [key], value, [0.25, 0.5, 0.75]).select(
        key, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    q = cut_lineage(q, "quartiles")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    within = F.col("_x").between(F.col("q1") - reach, F.col("q3") + reach)
    return beside_groups(counts, q, [key]).groupBy(key, "n", "q1", "median", "q3").agg(
        F.min(F.when(within, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(within, F.col("_x"))).alias("whisker_high"),
        F.sum(F.when(within, F.lit(0)).otherwise(F.col("_w"))).cast("long").alias("outliers"),
    )


def iqr_fences(df: DataFrame, col: str, factor: float = 1.5) -> dict[str, float | None]:
    """Quartiles and fences; all None for a column without values."""
    found = collect_quantiles(df, [col], [0.25, 0.75])
    if col not in found:
        return dict.fromkeys(("q1", "q3", "low", "high"))
    q1, q3 = found[col]
    return {"q1": q1, "q3": q3, "low": q1 - factor * (q3 - q1), "high": q3 + factor * (q3 - q1)}


def iqr_outliers(df: DataFrame, col: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the fences, with the fences beside them; null and NaN are not outside."""
    f = iqr_fences(df, col, factor)
    x = nan_to_null(F.col(col).cast("double"))
    low, high = (F.lit(f[k]).cast("double") for k in ("low", "high"))
    return df.where((x < low) | (x > high)).withColumns(
        {"fence_low": low, "fence_high": high}
    )


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair; a row is left out only for the pairs it lacks."""
    def num(c: str) -> Column:
        return nan_to_null(F.col(c).cast("double"))

    pairs = list(combinations(cols, 2))
    wide = df.agg(*[F.corr(num(a), num(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.explode(cells).alias("_r")).select("_r.*")


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Type, non-null, null and infinite counts per column in one pass."""
    cols = cols or df.columns
    kinds = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        if kinds[c] in ("double", "float"):
            missing, infinite = x.isNull() | F.isnan(x), F.abs(x) == float("inf")
        else:
            missing, infinite = x.isNull(), F.lit(False)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("type"),
                F.count_if(~missing).alias("non_null"),
                F.count_if(missing).alias("nulls"),
                F.count_if(F.coalesce(infinite, F.lit(False))).alias("infinite"),
            ).alias(f"_{i}")
        )
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[f"_{i}" for i in range(len(cols))])).alias("_r")).select("_r.*")


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact number of distinct non-null values per column, by two-step aggregates over one scan."""
    wide = df.agg(*[F.count_distinct(F.col(c)).alias(f"_{i}") for i, c in enumerate(cols)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("distinct")) for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*pairs)))


def grid_means(df: DataFrame, lat: str, lon: str, value: str, step: float) -> DataFrame:
    """Mean and count of a value per lat/lon cell (data behind a scatter map)."""
    return df.groupBy(
        F.floor(F.col(lat) / step).alias("lat_cell"), F.floor(F.col(lon) / step).alias("lon_cell")
    ).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def category_totals(df: DataFrame, category: str = "category") -> DataFrame:
    """Rows per category plus a total row."""
    per = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return per.unionByName(per.agg(F.sum("n").cast("long").alias("n")).select(F.lit("total").alias(category), "n"))


def int_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """How often every small integer occurs per column, in value order."""
    return (
        melt(df, cols)
        .groupBy("column", F.bround("value", 0).cast("long").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("column", "value")
    )
