import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


from lotwise.operators.profile import (
    boxplot, describe, detailed_statistics, histogram, iqr_fences, iqr_outliers, value_counts,
)
from lotwise.operators.quantiles import collect_quantiles, column_modes, grouped_quantiles, text_modes

PROBS = [0.5, 0.01, 0.25, 0.99, 0.75, 1.0, 0.0]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_counting_path_equals_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = collect_quantiles(df, ["x"], PROBS)["x"]
    assert np.allclose(got, np.quantile(values, PROBS), rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_counting_path_on_many_rows(spark, accuracy):
    """A coarse sketch brackets wide, the answer stays exact; a third of the rows share one value."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 7919 % 100_003) / 13).alias("x"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("y"),
    )
    pdf = df.toPandas()
    got = collect_quantiles(df, ["x", "y"], PROBS, accuracy=accuracy)
    for c in ("x", "y"):
        assert np.allclose(got[c], pdf[c].quantile(PROBS), rtol=1e-12)


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_grouped_with_hot_group(spark, request, limit):
    """Group figures broadcast, and attached with only the hot groups broadcast."""
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        (F.col("id") * 104729 % 9973).cast("double").alias("x"),
    )
    got = grouped_quantiles(df, ["g"], "x", [0.25, 0.5, 0.9], accuracy=200).toPandas().set_index("g").sort_index()
    want = df.toPandas().groupby("g")["x"].quantile([0.25, 0.5, 0.9]).unstack().sort_index()
    assert np.allclose(got[["q0", "q1", "q2"]].to_numpy(), want.to_numpy())


def test_moments_fixture(spark):
    row = detailed_statistics(spark.createDataFrame([(float(v),) for v in (1, 2, 2, 4, 4, 10)], "x double")).first()
    assert (row["median"], row["mode"], row["range"]) == (3.0, 2.0, 9.0)
    assert row["skewness"] == pytest.approx(1.7419520129, abs=1e-9)
    assert row["kurtosis"] == pytest.approx(3.3618605022, abs=1e-9)
    assert row["std"] == pytest.approx(3.2506409624, abs=1e-9)


def test_describe_ignores_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    row = describe(df, ["x"]).first()
    assert (row["count"], row["p50"], row["max"]) == (4, 2.5, 10.0)


def test_modes_take_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 4.0), ("a", 2.0), ("a", 2.0), ("b", 4.0)], "t string, x double")
    assert text_modes(df, ["t"]) == {"t": "a"}
    assert column_modes(df, ["x"]).first()["mode"] == 2.0


def test_shares_sum_to_one_and_bins_hold_all(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.sqrt("id").alias("x"))
    assert value_counts(df, "k").agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    h = histogram(df, "x", 20).toPandas().sort_values("bin")
    assert list(h["n"]) == list(np.histogram(np.sqrt(np.arange(1000)), bins=20)[0])


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_repartitioning_does_not_change_results(spark, request, limit):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    df = spark.range(5000).select((F.col("id") % 11).alias("g"), (F.col("id") * 31 % 997).cast("double").alias("x"))
    a = boxplot(df.repartition(7), "g", "x").toPandas().sort_values("g").reset_index(drop=True)
    b = boxplot(df.coalesce(1), "g", "x").toPandas().sort_values("g").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_nan_and_empty_columns(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, float("nan"), None]
    df = spark.createDataFrame([("g", v, None) for v in values], "g string, x double, y double")
    assert [r["x"] for r in iqr_outliers(df, "x").collect()] == [100.0]
    assert iqr_outliers(df, "y").collect() == [] and set(iqr_fences(df, "y").values()) == {None}
    assert [r["n"] for r in histogram(df, "x", 2).orderBy("bin").collect()] == [4, 1]
    box = boxplot(df, "g", "x").first()
    assert (box["n"], box["outliers"], box["whisker_high"]) == (5, 1, 4.0)
