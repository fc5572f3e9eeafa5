"""The model grid: passes over the rows and order of fits."""

import threading

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from test_models import coordinate_descent

from lotwise.operators import models
from lotwise.operators.metrics import metrics_dict
from lotwise.operators.sampling import hash_split
from lotwise.operators.transformers import preprocessor


def correlated(spark, n=400):
    """Features of unlike size that go with each other, so that an L1 fit takes many steps."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(n, 1))
    x = (base + 0.2 * rng.normal(size=(n, 6))) * [1, 30, 0.1, 5, 2, 1] + [0, 75, 1, 0, 3, 0]
    y = 9 + x @ [0.5, 0.02, -3.0, 0.1, 0.0, 0.2] + 0.3 * rng.normal(size=n)
    return x, y, spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, e double, f double, y double")


def vectors(rows):
    return VectorAssembler(inputCols=list("abcdef"), outputCol="features").transform(rows).select("features", "y")


@pytest.mark.parametrize("alpha,rho", [(0.001, 0.5), (0.001, 1.0), (0.1, 1.0)])
def test_l1_fits_read_the_rows_a_few_times(spark, alpha, rho):
    x, y, rows = correlated(spark)
    read = spark.sparkContext.accumulator(0)

    def same(v):
        read.add(1)
        return v

    counted = vectors(rows.withColumn("a", F.udf(same, "double")("a")))
    model = models.elastic_net(counted, "y", alpha, rho).fit(counted)
    assert read.value <= 6 * len(y)
    assert np.allclose(model.coefficients, coordinate_descent(x, y, alpha, rho, 20_000), atol=2e-6)


@pytest.mark.parametrize("alpha,rho", [(0.1, 0.5), (0.3, 0.0)])
def test_l1_fits_agree_on_either_side_of_the_bound(spark, monkeypatch, alpha, rho):
    df = vectors(correlated(spark)[2]).persist()
    near = models.elastic_net(df, "y", alpha, rho).fit(df)
    monkeypatch.setattr(models, "PRODUCT_FEATURES", 5)
    far = models.elastic_net(df, "y", alpha, rho).fit(df)
    assert np.allclose(near.coefficients, far.coefficients, atol=2e-6) and near.intercept == pytest.approx(far.intercept, abs=1e-4)
    df.unpersist()


def homes(spark):
    k = F.col("id")
    rows = spark.range(300).select(
        "id", (k * 37 % 50).cast("double").alias("a"), F.when(k % 7 != 0, (k % 5).cast("double")).alias("b"), (k % 3).cast("string").alias("t")
    )
    return hash_split(rows.withColumn("y", F.col("a") * 2 + F.col("id") % 3 + F.col("id") % 5), ["id"])


def test_grid_has_every_pair_and_frees_its_rows(spark):
    train, test = homes(spark)
    some = {k: models.GRID[k] for k in ("LinearRegression", "Lasso", "DecisionTree")}
    kept = spark.sparkContext._jsc.sc().getRDDStorageInfo().__len__()
    out = {(r["Model"], r["Scaler"]): r for r in models.compare_grid(train, test, "y", ["a", "b"], ["t"], some, ["robust", "none", "max_abs"]).collect()}
    assert set(out) == {(m, s) for m in some for s in ("robust", "none", "max_abs")}
    assert spark.sparkContext._jsc.sc().getRDDStorageInfo().__len__() <= kept
    prep = preprocessor(["a", "b"], ["t"], "max_abs").fit(train)
    seen, held = (prep.transform(part).select("features", "y") for part in (train, test))
    for name, build in some.items():
        want, got = metrics_dict(build(seen, "y").fit(seen).transform(held), "y"), out[name, "max_abs"]
        assert got["R2"] == pytest.approx(want["r2"], abs=1e-6) and got["MAE"] == pytest.approx(want["mae"], rel=1e-5)


def test_next_scaler_does_not_wait_for_the_longest_fit(spark):
    train, test = homes(spark)
    begun, lock, waited = [], threading.Lock(), []
    second = threading.Event()

    def slow(df, label):
        with lock:
            begun.append(1)
            first = len(begun) == 1
        if first:
            waited.append(second.wait(60))
        else:
            second.set()
        return models.linear(df, label)

    out = models.compare_grid(train, test, "y", ["a", "b"], ["t"], {"slow": slow, "linear": models.linear}, ["none", "standard"], parallelism=2)
    assert waited == [True] and out.count() == 4
